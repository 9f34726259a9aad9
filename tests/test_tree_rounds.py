"""Rounds of joins stay plannable, and the spanning tree's records meet in many parts."""

import numpy as np
from pyspark.sql import functions as F

from tessellate.operators import dbscan as DB
from tessellate.operators import hierarchy as H
from tessellate.operators import metric as M
from tessellate.session import cut_lineage


def test_guessed_sizes_do_not_multiply_from_round_to_round(spark):
    left = spark.range(100).select("id", F.col("id").alias("v"))
    for _ in range(5):
        left = cut_lineage(left.join(left.select("id", F.col("v").alias("w")), "id").select("id", "v"))
    assert int(left._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 1 << 64  # its digits doubled
    assert sorted(r["v"] for r in left.collect()) == list(range(100))


def test_tree_of_many_parts_with_ties(spark, monkeypatch):
    monkeypatch.setattr(M, "CROSS_TILES", 2)
    monkeypatch.setattr(M, "CROSS_BYTES", 24 * 8 * 2)  # records of 16 rows, in pieces of 6
    monkeypatch.setattr(DB, "LOCAL_LINKS", 3)
    rng = np.random.default_rng(3)
    x = np.unique(np.vstack([rng.integers(0, 5, (50, 3)) * 0.5 + 100.0, rng.normal(0, 0.3, (30, 3)).round(2)]), axis=0)
    x = x[rng.permutation(len(x))]
    ids = [f"r{i:03d}" for i in range(len(x))]
    df = spark.createDataFrame([(i, *v) for i, v in zip(ids, x.tolist())], "id string, a double, b double, c double")
    got = {(r["a"], r["b"]): r["distance"] for r in H.spanning_tree(df, ["a", "b", "c"], "id", tile_rows=6).collect()}
    d2 = np.zeros((len(x), len(x)))
    for f in range(3):
        d2 += (x[:, f][:, None] - x[:, f][None]) ** 2
    edges = sorted((np.sqrt(d2[i, j]), ids[i], ids[j]) for i in range(len(x)) for j in range(i))
    edges = sorted((d, *sorted(e)) for d, *e in edges)
    comp, want = {i: i for i in ids}, {}
    for d, a, b in edges:
        if comp[a] != comp[b]:
            want[a, b] = d
            old, new = comp[a], comp[b]
            comp = {i: new if c == old else c for i, c in comp.items()}
    assert got == want
    assert H.spanning_tree(df.where("false"), ["a", "b", "c"], "id").count() == 0


def test_few_links_are_joined_at_once(spark, monkeypatch):
    v = spark.range(40).withColumnRenamed("id", "id")
    e = spark.createDataFrame([(i, i + 1) for i in range(0, 38) if i % 5] + [(3, 3)], "src long, dst long")
    got = {r["id"]: r["comp"] for r in DB.connected_components(v, e).collect()}
    monkeypatch.setattr(DB, "LOCAL_LINKS", 3)
    assert got == {r["id"]: r["comp"] for r in DB.connected_components(v, e).collect()} and len(set(got.values())) == 10
