import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessellate.llm import queries
from tessellate.llm.common import table
from tessellate.llm.reshard import class_moves, equal_capacities, min_cost_flow, reshard, rewrite, settle, sized_rows, transfers
from tests.conftest import SF_SMALL
from tests.llm import edge


def test_flow_moves_the_fewest_bytes():
    rng = random.Random(4)
    for _ in range(30):
        old = {i: rng.randint(0, 1000) for i in range(rng.randint(1, 8))}
        caps = equal_capacities(sum(old.values()), rng.randint(1, 10))
        flow = min_cost_flow(old, caps)
        for i, size in old.items():
            assert sum(v for (a, _), v in flow.items() if a == i) == size
        for j, cap in caps.items():
            assert sum(v for (_, b), v in flow.items() if b == j) == cap
        moved = sum(v for (a, b), v in flow.items() if a != b)
        assert moved == sum(max(0, size - caps.get(i, 0)) for i, size in old.items())
    with pytest.raises(ValueError):
        min_cost_flow({0: 5}, {0: 2, 1: 2})


def test_transfers_cover_every_block():
    whole, split = transfers([(0, 0, 10), (0, 1, 10), (0, 2, 10), (1, 0, 4)], {(0, 0): 15, (0, 2): 15, (1, 1): 4})
    assert whole == {(0, 0): 0, (0, 2): 2, (1, 0): 1}
    assert split == {(0, 1): [(0, 0), (5, 2)]}


def test_settle_balances():
    sizes, targets = {0: 100, 1: 80}, {0: 90, 1: 90}
    assert settle(sizes, targets, {0: [(3, 1), (7, 2), (50, 3)], 1: []}) == {1: 1, 2: 1}
    assert settle(sizes, targets, {0: [(30, 1)], 1: [(20, 2)]}) == {1: 1, 2: 0}
    assert settle({0: 5, 1: 5}, {0: 5, 1: 5}, {0: [(1, 1)], 1: [(1, 2)]}) == {}


def check(rows, sizes, shards):
    assert len(rows) == len(sizes)
    total, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        total[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(total) <= set(range(shards))
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return total


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF_SMALL, "documents").collect()}
    rows = queries.op5_flow_reshard(spark, SF_SMALL).collect()
    total = check(rows, docs, 16)
    mean = sum(total.values()) / 16
    largest = max(r["size"] for r in rows)
    assert max(total.values()) <= max(mean * 1.01, largest)
    for r in rows:
        raw = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)


def test_equal_sizes_over_many_rows(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', cast(1 + id % 97 as int))").alias("text"))
    rows = sized_rows(docs, 12)
    placed = reshard(rows, 16, blocks_per_shard=16, class_rows=2).collect()
    total = check(placed, range(20_000), 16)
    assert max(total.values()) - min(total.values()) <= 97
    moved = sum(r["size"] for r in placed if r["shard"] != r["old_shard"])
    old = defaultdict(int)
    for r in placed:
        old[r["old_shard"]] += r["size"]
    fewest = sum(max(0, s - sum(old.values()) / 16) for s in old.values())
    assert moved <= fewest + 16 * 200


def test_class_moves_go_from_large_to_small_rows():
    counts = {(0, 80): (2, 2000), (0, 40): (10, 320), (0, 0): (500, 500), (1, 40): (10, 320)}
    moves = class_moves({0: 1500, 1: -1500}, counts)
    assert moves == {(0, 80): [(1, 1)], (0, 40): [(10, 1)], (0, 0): [(180, 1)]}
    assert class_moves({0: 0, 1: 0}, counts) == {} and class_moves({}, {}) == {}
    assert class_moves({0: 10, 1: -10}, {(0, 80): (1, 1000)}) == {}


@pytest.mark.parametrize("old, new", [(12, 16), (3, 2), (1, 5)])
def test_equal_sizes_with_many_empty_and_a_few_huge_rows(spark, old, new):
    """A third of the rows are one byte, 33 are 1.5 MB: rows of every size level the shards."""
    rows = spark.range(120_000).select(
        F.col("id").alias("row"), F.expr("CAST(CASE WHEN id % 3 = 0 THEN 1 WHEN id % 3637 = 1 THEN 1500000 + id "
                                         "ELSE 200 + pmod(xxhash64(id), 2400) END AS BIGINT)").alias("size"),
        F.pmod(F.xxhash64("id", F.lit(7)), F.lit(old)).cast("int").alias("old_shard"))
    placed = reshard(rows, new)
    total = placed.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("slot").alias("last"),
                                        F.countDistinct("slot").alias("slots")).collect()
    assert len(total) == new and max(r["bytes"] for r in total) - min(r["bytes"] for r in total) <= 1
    assert all(r["n"] == r["slots"] == r["last"] + 1 for r in total) and sum(r["n"] for r in total) == 120_000
    assert placed.select("row", "size").exceptAll(rows.select("row", "size")).isEmpty()


def test_rewrite_of_repeated_ids_follows_the_placement(spark, tmp_path):
    """One id on forty rows, some alike, some of other texts; a null id; each row goes where it was placed."""
    rows = [(7, "same") for _ in range(20)] + [(7, "x" * (i % 5)) for i in range(20)] + [(None, "none")] * 6 + [(i, "y" * i) for i in range(100, 130)]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, extra int")
    sized = sized_rows(docs, 2)
    (docs.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")).write.partitionBy("shard").parquet(str(tmp_path / "old")))
    placed = reshard(sized, 5, blocks_per_shard=4)
    manifest = rewrite(str(tmp_path / "old"), placed, str(tmp_path / "new")).collect()
    found = [(m["shard"], r["doc_id"], r["text"], r["extra"]) for m in manifest for r in spark.read.parquet(m["path"]).collect()]
    assert sorted(f[3] for f in found) == list(range(len(rows)))
    assert Counter((s, i, len(t.encode()) + 1) for s, i, t, _ in found) == Counter((r["shard"], r["id"], r["size"]) for r in placed.collect())


def test_edge_rows(spark):
    rows = reshard(sized_rows(edge.docs(spark), 3), 4).collect()
    total = check(rows, edge.DOCS, 4)
    assert sum(total.values()) == sum(len((t[1] or "").encode()) + 1 for t in edge.DOCS)
    assert reshard(sized_rows(edge.empty(spark), 3), 4).count() == 0


def test_rewrite_touches_changed_shards_only(spark, tmp_path):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', cast(1 + id % 50 as int))").alias("text"))
    rows = sized_rows(docs, 3)
    (docs.join(rows.select(F.col("id").alias("doc_id"), F.col("old_shard").alias("shard")), "doc_id")
     .write.partitionBy("shard").parquet(str(tmp_path / "old")))
    placed = reshard(rows, 4, blocks_per_shard=8)
    manifest = rewrite(str(tmp_path / "old"), placed, str(tmp_path / "new")).collect()
    found = set()
    for m in manifest:
        for r in spark.read.parquet(m["path"]).collect():
            found.add((m["shard"], r["doc_id"]))
    assert found == {(r["shard"], r["id"]) for r in placed.collect()} and len(found) == 3000
    same = spark.createDataFrame([(i, 10, 0, i % 2, i % 2) for i in range(8)], "id long, size long, row long, old_shard int, shard int")
    assert not any(m["rewritten"] for m in rewrite(str(tmp_path / "old"), same, str(tmp_path / "none")).collect())
