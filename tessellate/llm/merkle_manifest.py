"""Merkle manifest of a dataset, by slot pivots.

A row's leaf is the SHA-256 of its fields.  Leaves are ordered within their
group; every ``fanout`` consecutive nodes have one parent.  A level is made by
conditional aggregates that spread each parent's children over ``fanout``
columns (the slots): hashing the joined columns gives the parent, joining them
without a child's own slot gives that child's siblings.  The tops of the
groups, ordered by group, are the leaves of a second tree of the same kind,
whose top is the root of the dataset.

Going up, each level is a written table with an eighth of the nodes of the one
below.  Going down, a parent's slot row meets the path above that parent (one
join of a level with the nodes of the next, at most an eighth of the leaves)
and is dealt out to its children, so proofs of the leaves never move between
tasks.  A parent has at most ``fanout`` children, so no key is hot; the order
of leaves comes from a range sort that can split any group and any tie.

Nulls hash as ``-``, so a null differs from an empty text; null groups come
first and null ids first in their group.  Repeated rows are leaves each; rows
of one id are ordered by leaf.  A single leaf is the top of its group.  No rows
give no rows.  Other columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .ordered import numbered, same

FANOUT = 8
STEP = "array<struct<left:string,right:string>>"


def field_text(c: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field_text, fields)), 256)


@dataclass
class Tree:
    """Levels of slot rows over ordered leaves, one tree per group."""
    group: list[str]
    payload: list[str]
    fanout: int
    leaves: DataFrame        # group, pos, n, node, payload
    levels: list[DataFrame]  # group, pos, slot_0 ...: lowest first; slots of the lowest hold the payload
    tops: DataFrame          # group, depth, node

    @classmethod
    def over(cls, leaves: DataFrame, group: list[str], payload: list[str], fanout: int, name: str) -> Tree:
        """The tree over leaves (group, pos, n, node, payload) as ``numbered`` places them."""
        nodes, levels, tops = leaves, [], None
        most = leaves.agg(F.max("n")).first()[0] or 0
        while True:
            top = nodes.where("n = 1").select(*group, F.lit(len(levels)).alias("depth"), "node")
            tops = top if tops is None else tops.union(top)
            if most <= 1:
                return cls(group, payload, fanout, leaves, levels, tops)
            child = ", ".join(["node", *payload] if not levels else ["node"])
            slots = [F.expr(f"first(CASE WHEN pos % {fanout} = {s} THEN struct({child}) END, true) AS slot_{s}")
                     for s in range(fanout)]
            runs = written(nodes.where("n > 1").groupBy(*group, F.expr(f"pos div {fanout} AS pos"), "n").agg(*slots),
                           f"{name}-level{len(levels)}")
            levels.append(runs)
            nodes = runs.selectExpr(*group, "pos", f"(n + {fanout - 1}) div {fanout} AS n",
                                    f"sha2({cls.joined(range(fanout))}, 256) AS node")
            most = -(-most // fanout)

    @staticmethod
    def joined(slots: range) -> str:
        """SQL of the digests of some slots, joined (an empty slot adds nothing)."""
        return f"concat_ws('', {', '.join(f'slot_{s}.node' for s in slots)})" if slots else "''"

    def paths(self, above: DataFrame) -> DataFrame:
        """(payload, node, steps, further columns of ``above``) of every leaf.
        ``above`` has one row per group: group, depth, steps over the group's
        top.  Steps hold the digests to the left and right of the path, upwards."""
        g, f = self.group, self.fanout
        carried = [c for c in above.columns if c not in (*g, "depth", "steps")]
        path = None
        for l in reversed(range(len(self.levels))):
            top = above.where(F.col("depth") == l + 1).select(*g, F.lit(0).cast("long").alias("pos"), "steps", *carried)
            path = top if path is None else path.union(top)
            runs = self.levels[l]
            met = runs.join(path, same(runs, path, [*g, "pos"])).select(
                *(runs[c] for c in runs.columns), "steps", *carried)
            dealt = ", ".join(
                f"struct({s} AS at, slot_{s} AS child, struct({self.joined(range(s))} AS left, "
                f"{self.joined(range(s + 1, f))} AS right) AS step)" for s in range(f))
            path = (met.selectExpr(*g, "pos", "steps", *carried, f"explode(array({dealt})) AS dealt")
                    .where("dealt.child is not null")
                    .selectExpr(*g, f"pos * {f} + dealt.at AS pos", f"cast(concat(array(dealt.step), steps) AS {STEP}) AS steps",
                                *carried, "dealt.child"))
            if l:
                path = path.drop("child")
        alone = self.leaves.where("n = 1")
        alone = alone.join(above, same(alone, above, g)).select(
            *(alone[c] for c in (*self.payload, "node")), "steps", *carried)
        if path is None:
            return alone
        return path.select(*(F.col(f"child.{c}").alias(c) for c in (*self.payload, "node")), "steps", *carried).union(alone)


def manifest(docs: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "lang",
             carry: Mapping[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """One row per row of ``docs``: id, leaf, steps (its siblings to the left
    and right at each level up to the root), subroot (of its group), root, and
    the columns of ``carry`` (expressions over ``docs``; a few bytes each)."""
    carry = dict(carry or {})
    kept = {f"carried_{i}": c for i, c in enumerate(carry.values())}
    rows = written(docs.select(F.col(group_col).alias("group"), F.col(id_col).alias("id"),
                               leaf_digest([F.col(c) for c in fields]).alias("node"),
                               F.monotonically_increasing_id().alias("row"),
                               *(c.alias(name) for name, c in kept.items())), "merkle-leaves")
    leaves = numbered(rows, ["group"], ["id", "node", "row"], "merkle-order")
    tree = Tree.over(leaves, ["group"], ["id", *kept], fanout, "merkle")

    subroots = written(tree.tops.withColumn("all", F.lit(0)), "merkle-subroots")
    upper = Tree.over(numbered(subroots, ["all"], ["group"], "merkle-groups"), ["all"], ["group", "depth"], fanout, "merkle-upper")
    root = upper.tops.select("all", "depth", F.col("node").alias("root"), F.array().cast(STEP).alias("steps"))
    groups = written(upper.paths(root).withColumnRenamed("node", "subroot"), "merkle-above")
    found = tree.paths(groups)
    return found.select(F.col("id").alias(id_col), F.col("node").alias("leaf"), "steps", "subroot", "root",
                        *(F.col(k).alias(name) for k, name in zip(kept, carry)))


def siblings_digest(steps: str | Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s.left, s.right)), ""), 256)


def fold(leaf: Column, steps: str | Column) -> Column:
    """The root that a leaf and the siblings of its path lead to."""
    return F.aggregate(steps, leaf, lambda node, s: F.sha2(F.concat(s.left, node, s.right), 256))


#: CRC-32 of a bigint's decimal digits: the register takes each byte, then eight single bits.
CRC32_SQL = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
    range(1, strlen(doc_id::VARCHAR) + 1), lambda i: [ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))))"""


def oracle_sql(fields: list[str], text_col: str = "text", fanout: int = FANOUT) -> str:
    """DuckDB SQL of the registered query: both trees by recursion."""
    def digest(changed: bool) -> str:
        parts = []
        for f in fields:
            v = f"translate({f}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')" if changed and f == text_col else f
            parts.append(f"CASE WHEN {f} IS NULL THEN '-' ELSE strlen(CAST({f} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR) END")
        return f"sha256({' || '.join(parts)})"

    def up(name: str, key: str, source: str) -> str:
        return f"""{name} AS (
  SELECT {key}, 0 AS lvl, pos, n, h FROM {source}
  UNION ALL
  SELECT {key}, lvl + 1, pos // {fanout}, (any_value(n) + {fanout - 1}) // {fanout}, sha256(string_agg(h, '' ORDER BY pos))
  FROM {name} WHERE n > 1 GROUP BY {key}, lvl, pos // {fanout}),
{name}_runs AS (SELECT {key}, lvl, pos // {fanout} AS run, list(h ORDER BY pos) AS hs FROM {name} WHERE n > 1
  GROUP BY {key}, lvl, pos // {fanout})"""

    def walk(name: str, key: str, runs: str, start: str) -> str:
        left = f"coalesce(array_to_string(hs[1:(w.pos % {fanout})::INT], ''), '')"
        right = f"coalesce(array_to_string(hs[(w.pos % {fanout})::INT + 2:], ''), '')"
        return f"""{name} AS (
  {start}
  UNION ALL
  SELECT w.doc_id, w.{key}, w.lvl + 1, w.pos // {fanout}, w.proof || {left} || {right}, sha256({left} || w.folded || {right})
  FROM {name} w JOIN {runs} r ON r.{key} IS NOT DISTINCT FROM w.{key} AND r.lvl = w.lvl AND r.run = w.pos // {fanout}),
{name}_end AS (SELECT * FROM {name} QUALIFY lvl = max(lvl) OVER (PARTITION BY doc_id))"""

    return f"""WITH RECURSIVE docs AS (
  SELECT doc_id, lang, {digest(False)} AS leaf,
         CASE WHEN {CRC32_SQL} % 3 = 0 THEN {digest(True)} ELSE {digest(False)} END AS presented FROM documents),
placed AS (SELECT *, leaf AS h, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos,
                  count(*) OVER (PARTITION BY lang) AS n FROM docs),
{up("tree", "lang", "placed")},
subs AS (SELECT lang, h, 0 AS one, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
{up("upper_tree", "one", "subs")},
{walk("low", "lang", "tree_runs", "SELECT doc_id, lang, 0 AS lvl, pos, '' AS proof, presented AS folded FROM placed")},
{walk("high", "one", "upper_tree_runs", "SELECT l.doc_id, s.one, 0 AS lvl, s.pos, l.proof, l.folded FROM low_end l JOIN subs s ON s.lang IS NOT DISTINCT FROM l.lang")}
SELECT p.doc_id, p.leaf, s.h AS subroot, r.h AS root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root, e.folded = r.h AS verified
FROM placed p JOIN subs s ON s.lang IS NOT DISTINCT FROM p.lang JOIN high_end e ON e.doc_id = p.doc_id
CROSS JOIN (SELECT h FROM upper_tree WHERE n = 1) r"""
