import hashlib
import string
import zlib

import pytest
from pyspark.sql import functions as F

from tessellate.llm import merkle_manifest, queries
from tessellate.llm.common import table
from tests.conftest import SF_SMALL
from tests.llm import edge


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, fanout):
    """Top of the ordered nodes and every node's siblings (left, right), upwards."""
    steps, level, under = [[] for _ in nodes], nodes, [[i] for i in range(len(nodes))]
    while len(level) > 1:
        up, up_under = [], []
        for at in range(0, len(level), fanout):
            run = level[at:at + fanout]
            for k in range(len(run)):
                for i in under[at + k]:
                    steps[i].append(("".join(run[:k]), "".join(run[k + 1:])))
            up.append(H(*run))
            up_under.append(sum(under[at:at + fanout], []))
        level, under = up, up_under
    return level[0], steps


def plain_manifest(rows, fanout=8):
    """rows: (group, id, leaf) -> [(id, leaf, steps, subroot, root)], by nested loops."""
    groups = {}
    for g, i, leaf in rows:
        groups.setdefault(g, []).append((i, leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops = []
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        tops.append(climb([leaf for _, leaf in groups[g]], fanout))
    root, above = climb([t for t, _ in tops], fanout)
    return [(i, leaf, [*below, *up], top, root) for g, (top, steps), up in zip(names, tops, above)
            for (i, leaf), below in zip(groups[g], steps)]


def as_rows(found):
    return sorted((repr(r["doc_id"]), r["leaf"], [tuple(s) for s in r["steps"]], r["subroot"], r["root"])
                  for r in found.select("doc_id", "leaf", "steps", "subroot", "root").collect())


def plain_rows(rows, fanout=8):
    return sorted((repr(i), *rest) for i, *rest in plain_manifest(rows, fanout))


def test_query_against_nested_loops(spark):
    docs = {r["doc_id"]: r for r in table(spark, SF_SMALL, "documents").collect()}
    fields = queries.LEAF_FIELDS
    want = {i: rest for i, *rest in plain_manifest(
        [(r["lang"], i, leaf_of([r[f] for f in fields])) for i, r in docs.items()])}
    rows = queries.op11_merkle_manifest(spark, SF_SMALL).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    tampered = 0
    for r in rows:
        leaf, steps, subroot, root = want[r["doc_id"]]
        assert (r["leaf"], r["subroot"], r["root"]) == (leaf, subroot, root)
        assert r["proof_sha256"] == H(*(x for s in steps for x in s))
        values = [docs[r["doc_id"]][f] for f in fields]
        if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
            values[-1] = values[-1].translate(lower)
        node = leaf_of(values)
        tampered += node != leaf
        for left, right in steps:
            node = H(left, node, right)
        assert r["folded_root"] == node and r["verified"] == (leaf_of(values) == leaf)
    assert 0 < tampered < len(rows)


def test_edge_rows(spark):
    fields = queries.LEAF_FIELDS
    want = plain_rows([(lang, i, leaf_of([i, source, lang, n, text])) for i, text, lang, source, n, _ in edge.DOCS])
    found = merkle_manifest.manifest(edge.docs(spark), fields)
    assert as_rows(found) == want
    checked = found.select(merkle_manifest.fold(F.col("leaf"), "steps").alias("top"), "root").collect()
    assert len(checked) == len(edge.DOCS) and all(r["top"] == r["root"] for r in checked)
    assert merkle_manifest.manifest(edge.empty(spark), fields).count() == 0


@pytest.mark.parametrize("n, groups, fanout", [(1, 1, 8), (8, 1, 8), (9, 1, 8), (65, 1, 8), (30, 30, 8), (70, 3, 2), (513, 2, 8)])
def test_shapes(spark, n, groups, fanout):
    rows = [(i, f"T{i}", f"g{(i * i) % groups}") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    want = plain_rows([(g, i, leaf_of([i, t])) for i, t, g in rows], fanout)
    assert as_rows(merkle_manifest.manifest(docs, ["doc_id", "text"], fanout=fanout)) == want


def test_hot_group_of_repeated_rows_and_null_ids(spark):
    """A third of the rows are one row, a third have no id; string ids order by bytes."""
    rows = [("same", "x", "a")] * 60 + [(None, f"n{i % 7}", "a") for i in range(60)] + [(f"é{i}", "y", None) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string").repartition(6)
    plain = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode()))
    groups = {}
    for i, t, g in plain:
        groups.setdefault(g, []).append((i, leaf_of([i, t])))
    for g in groups:
        groups[g].sort(key=lambda x: (x[0] is not None, (x[0] or "").encode(), x[1]))
    tops = [climb([x[1] for x in groups[g]], 8) for g in (None, "a")]
    root, _ = climb([t for t, _ in tops], 8)
    found = merkle_manifest.manifest(docs, ["doc_id", "text"]).collect()
    assert len(found) == 180 and {r["root"] for r in found} == {root}
    assert {r["subroot"] for r in found} == {t for t, _ in tops}


def test_null_is_no_empty_text(spark):
    d = spark.createDataFrame([(None, ""), ("-", "1:a"), ("é", None)], "a string, b string")
    got = [r[0] for r in d.select(merkle_manifest.leaf_digest([F.col("a"), F.col("b")])).collect()]
    assert got == [H("-0:"), H("1:-3:1:a"), H("2:é-")]
