"""Resharding by minimum-cost flow.

Old shards are summed in blocks (a fixed number per shard, dealt by a hash of
the row), one small pre-aggregated table.  Bytes that stay cost nothing, bytes
that move cost one each; the minimum-cost flow from old shard sizes to new
capacities says how much each shard keeps and sends where.  Whole blocks are
transferred; a block that a boundary of the flow crosses is split by rows.
What rounding to rows leaves is settled in rounds: rows are counted by shard and
size class (an eighth of a power of two), the counts say how many rows of which
class go from shards above their target to shards below, and so many are taken
by their place in shard and class; rounds go on while they narrow the spread.  A
last few rows of every class are then exchanged one by one.  Only files of shards
that gain or lose rows are rewritten.

A row's size is the UTF-8 length of its text plus 1 (null: 1).  Null ids,
repeated rows and ties are rows like any others; every row gets one place.
"""

from __future__ import annotations

import bisect
import itertools
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, located, written
from .ordered import numbered, same

BLOCKS_PER_SHARD = 256
CLASS_ROWS = 4  # rows of each shard and size class that may be exchanged singly
CLASSES = 8      # per power of two
SLOT_BLOCKS = 64


def min_cost_flow(sizes: dict[int, int], capacities: dict[int, int]) -> dict[tuple[int, int], int]:
    """Bytes from each old to each new shard: all of ``sizes`` placed within
    ``capacities`` with the fewest bytes moved (successive shortest paths)."""
    nodes = ["s", *(("o", i) for i in sorted(sizes)), *(("n", j) for j in sorted(capacities)), "t"]
    room: dict = defaultdict(int)
    cost: dict = defaultdict(int)
    edges: list = []
    for i, size in sorted(sizes.items()):
        room["s", ("o", i)] = size
        edges.append(("s", ("o", i)))
        for j in sorted(capacities):
            room[("o", i), ("n", j)] = size
            cost[("o", i), ("n", j)], cost[("n", j), ("o", i)] = int(i != j), -int(i != j)
            edges.append((("o", i), ("n", j)))
    for j, most in sorted(capacities.items()):
        room[("n", j), "t"] = most
        edges.append((("n", j), "t"))
    both = edges + [(b, a) for a, b in edges]
    while True:
        far, back = {"s": 0}, {}
        for _ in nodes:
            changed = False
            for a, b in both:
                if a in far and room[a, b] > 0 and far[a] + cost[a, b] < far.get(b, 1 << 60):
                    far[b], back[b], changed = far[a] + cost[a, b], a, True
            if not changed:
                break
        if "t" not in far:
            break
        path, at = [], "t"
        while at != "s":
            path.append((back[at], at))
            at = back[at]
        push = min(room[e] for e in path)
        for a, b in path:
            room[a, b] -= push
            room[b, a] += push
    flow = {(i, j): room[("n", j), ("o", i)] for i in sizes for j in capacities}
    if sum(flow.values()) != sum(sizes.values()):
        raise ValueError("the capacities are smaller than the sizes")
    return {k: v for k, v in flow.items() if v}


def equal_capacities(total: int, shards: int) -> dict[int, int]:
    return {j: total // shards + (j < total % shards) for j in range(shards)}


def transfers(blocks: list[tuple[int, int, int]], flow: dict[tuple[int, int], int]):
    """(whole, split): whole[(old, block)] = new shard of blocks that lie inside
    one part of their shard's flow; split[(old, block)] = [(from byte of the
    block, new shard), ...] of those that a boundary crosses."""
    parts = defaultdict(list)  # the part that stays comes first
    for (i, j), amount in sorted(flow.items(), key=lambda x: (x[0][0], x[0][0] != x[0][1], x[0][1])):
        parts[i].append((j, amount))
    whole, split = {}, {}
    at = defaultdict(int)
    for old, block, size in sorted(blocks):
        lo, hi = at[old], at[old] + size
        at[old] = hi
        edge, inside = 0, []
        for j, amount in parts[old]:
            if edge < hi and edge + amount > lo:
                inside.append((max(0, edge - lo), j))
            edge += amount
        if len(inside) == 1:
            whole[old, block] = inside[0][1]
        else:
            split[old, block] = inside
    return whole, split


def settle(sizes: dict[int, int], targets: dict[int, int], pool: dict[int, list[tuple[int, int]]]) -> dict[int, int]:
    """Moves (row -> new shard) of pooled rows (size, row) that bring the shard
    sizes towards the targets.  Between the shard most above its target and the
    one most below, the row (or the exchange of two) that comes nearest to half
    their difference is taken, as long as it brings them closer."""
    over = {j: sizes.get(j, 0) - targets[j] for j in targets}
    pool = {j: sorted(pool.get(j, [])) for j in targets}
    moved: dict[int, int] = {}
    for _ in range(4 * sum(map(len, pool.values()))):
        a = max(over, key=lambda j: (over[j], j))
        b = min(over, key=lambda j: (over[j], j))
        half = (over[a] - over[b]) / 2
        best = None  # (distance from half, size, row, size back, row back)
        for size, row in pool[a]:
            k = bisect.bisect_left(pool[b], (size - half, -1))
            for back in [(0, None), *pool[b][max(0, k - 1):k + 1]]:
                trial = (abs(size - back[0] - half), size, row, *back)
                if best is None or trial[0] < best[0]:
                    best = trial
        if best is None or best[0] >= half:
            break
        _, size, row, size_back, row_back = best
        for x, y, s, r in ((a, b, size, row), (b, a, size_back, row_back)):
            if r is not None:
                pool[x].remove((s, r))
                bisect.insort(pool[y], (s, r))
                over[x] -= s
                over[y] += s
                moved[r] = y
    return moved


def class_moves(over: dict[int, int], counts: dict[tuple[int, int], tuple[int, int]]) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """(shard, class) -> [(rows, new shard)]: how many rows of which size class go
    where, by their mean size; ``over`` is each shard's size above its target and
    ``counts`` the rows and bytes of each shard and class.  Larger rows go first,
    never more than what either side is off by."""
    over, left = dict(over), {k: n for k, (n, _) in counts.items()}
    classes: dict[int, list[int]] = defaultdict(list)
    for shard, c in sorted(counts, reverse=True):
        classes[shard].append(c)
    moves: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for _ in range(4 * len(over)):
        a, b = max(over, key=lambda j: (over[j], j)), min(over, key=lambda j: (over[j], j))
        room = min(over[a], -over[b]) if over[a] > 0 > over[b] else 0
        sent = 0
        for c in classes[a]:
            n, size = counts[a, c]
            k = min(left[a, c], int((room - sent) * n // size))
            if k > 0:
                moves[a, c].append((k, b))
                left[a, c] -= k
                sent += k * size // n
        if not sent:
            break
        over[a] -= sent
        over[b] += sent
    return moves


def _settled(placed: DataFrame, targets: dict[int, int]) -> DataFrame:
    """``placed`` with the shards brought to their targets by rounds of class
    moves (a written table each), as long as a round narrows the spread."""
    spark = placed.sparkSession
    kind = F.floor(F.log2(F.col("size")) * CLASSES).cast("int")

    def state(rows):
        counts = {(r["shard"], r["kind"]): (r["n"], r["bytes"]) for r in rows.groupBy("shard", kind.alias("kind")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).collect()}  # shards x classes rows
        over = {j: -t for j, t in targets.items()}
        for (j, _), (_, size) in counts.items():
            over[j] += size
        return counts, over, max(over.values(), default=0) - min(over.values(), default=0)

    counts, over, spread = state(placed)
    while True:
        moves = class_moves(over, counts)
        if not moves:
            return placed
        ends = [(j, c, list(itertools.accumulate(n for n, _ in m)), [to for _, to in m]) for (j, c), m in moves.items()]
        plan = spark.createDataFrame(ends, "shard int, kind int, ends array<long>, to array<int>")
        rows = placed.withColumn("kind", kind)
        stay = rows.join(F.broadcast(plan), ["shard", "kind"], "left_anti").select(placed.columns)  # shards x classes rows
        place = F.row_number().over(Window.partitionBy("shard", "kind").orderBy("row"))
        picked = (rows.join(F.broadcast(plan), ["shard", "kind"]).withColumn("place", place)
                  .withColumn("part", F.size(F.filter("ends", lambda e: e < F.col("place"))))
                  .withColumn("shard", F.coalesce(F.get("to", F.col("part")), F.col("shard"))).select(placed.columns))
        after = written(stay.unionByName(picked), "reshard")
        counts, over, narrower = state(after)
        if narrower >= spread:
            discard(after)
            return placed
        discard(placed)
        placed, spread = after, narrower


def reshard(rows: DataFrame, shards: int, blocks_per_shard: int = BLOCKS_PER_SHARD, class_rows: int = CLASS_ROWS,
            slot_blocks: int = SLOT_BLOCKS) -> DataFrame:
    """``rows``: (row, size, old_shard, ...) with a distinct ``row`` per row.
    Returns ``rows`` with shard (0 .. shards-1) and slot (gapless from 0 in
    each shard).  What the driver sees are sums per block, counts per shard and
    size class and ``class_rows`` rows of each of these."""
    spark = rows.sparkSession
    rows = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks_per_shard)).cast("int"))
    sums = [(r["old_shard"], r["block"], r["bytes"]) for r in
            rows.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes")).collect()]
    old = defaultdict(int)
    for i, _, size in sums:
        old[i] += size
    targets = equal_capacities(sum(old.values()), shards)
    whole, split = transfers(sums, min_cost_flow(dict(old), targets) if old else {})

    plan = spark.createDataFrame([(i, b, j) for (i, b), j in whole.items()], "old_shard int, block int, shard int")
    bounds = spark.createDataFrame([(i, b, [e for e, _ in parts], [j for _, j in parts])
                                    for (i, b), parts in split.items()],
                                   "old_shard int, block int, edges array<long>, to array<int>")
    inside = rows.join(F.broadcast(plan), ["old_shard", "block"])  # blocks per shard x shards rows
    w = Window.partitionBy("old_shard", "block").orderBy(F.desc("size"), "row").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.sum("size").over(w) - F.col("size") / 2
    crossed = (rows.join(F.broadcast(bounds), ["old_shard", "block"]).withColumn("middle", middle)
               .withColumn("part", F.size(F.filter("edges", lambda e: e.cast("double") < F.col("middle"))))
               .withColumn("shard", F.element_at("to", F.greatest(F.col("part"), F.lit(1))))
               .drop("edges", "to", "middle", "part"))
    placed = written(inside.select(*rows.columns, "shard").unionByName(crossed.select(*rows.columns, "shard")), "reshard")

    placed = _settled(placed, targets)
    now = {r["shard"]: r["bytes"] for r in placed.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}
    kind = F.floor(F.log2(F.col("size")) * CLASSES)
    rank = F.row_number().over(Window.partitionBy("shard", kind).orderBy("row"))
    pool = defaultdict(list)
    for r in placed.select("shard", "size", "row", rank.alias("k")).where(F.col("k") <= class_rows).collect():
        pool[r["shard"]].append((r["size"], r["row"]))
    moves = spark.createDataFrame(list(settle(now, targets, pool).items()), "row long, to int")
    final = (placed.join(F.broadcast(moves), "row", "left")  # class_rows rows of each shard and class
             .withColumn("shard", F.coalesce("to", "shard")).drop("to", "block")
             .withColumn("block", F.pmod(F.xxhash64("row"), F.lit(slot_blocks)).cast("int")))
    ahead = F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    base = (final.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
            .select("shard", "block", F.coalesce(ahead, F.lit(0)).alias("base")))
    number = F.row_number().over(Window.partitionBy("shard", "block").orderBy("row"))
    return (final.withColumn("number", number).join(F.broadcast(base), ["shard", "block"])
            .withColumn("slot", (F.col("base") + F.col("number") - 1).cast("long"))
            .drop("block", "base", "number"))


def sized(text_col: str) -> list:
    """Size and checksum of a text."""
    text = F.col(text_col)
    return [(F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32")]


def sized_rows(docs: DataFrame, old_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, size, text_crc32, old_shard) of a table laid out in
    ``old_shards`` shards by a hash of the id; written once, so that row numbers hold."""
    return written(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), *sized(text_col),
        F.pmod(F.xxhash64(id_col), F.lit(old_shards)).cast("int").alias("old_shard")), "sized-rows")


def rewrite(old_root: str, placed: DataFrame, new_root: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rewrite the files of a table partitioned by ``shard`` under ``old_root``.

    Shards that gain or lose rows are written to ``new_root``; the others stay
    where they are.  Rows are told apart by id, size and checksum; of rows alike
    in these, as many go to each shard as ``placed`` says.  Returns the manifest
    (shard, path, rewritten) that together is the new table."""
    spark = placed.sparkSession
    pairs = [(r["old_shard"], r["shard"]) for r in placed.select("old_shard", "shard").distinct().collect()]  # shards squared
    touched = sorted({s for a, b in pairs if a != b for s in (a, b)})
    sources = sorted({a for a, _ in pairs if a in touched})
    if touched:
        old, names = located(spark.read.parquet(old_root).where(F.col("shard").isin(sources)))
        alike = ["old_shard", "id", "size", "text_crc32"]
        there = numbered(old.select(F.col("shard").alias("old_shard"), F.col(id_col).alias("id"), *sized(text_col), *names),
                         alike, names, "rewrite-old")
        goes = numbered(placed.where(F.col("old_shard").isin(sources)).select(*alike, "shard", "slot"),
                        alike, ["shard", "slot"], "rewrite-new")
        to = there.join(goes, same(there, goes, [*alike, "pos"])).select(*(there[n] for n in names), goes["shard"].alias("to_"))
        moved = old.join(to, names)
        (moved.withColumn("shard", F.col("to_")).drop("to_", *names)
         .write.partitionBy("shard").parquet(new_root))
    every = sorted({b for _, b in pairs} | set(touched))
    return spark.createDataFrame([(s, f"{new_root if s in touched else old_root}/shard={s}", s in touched) for s in every],
                                 "shard int, path string, rewritten boolean")
