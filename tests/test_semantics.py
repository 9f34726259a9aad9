"""Answers that must not depend on table size, width, types or NULLs."""

import pytest
from pyspark.sql import functions as F

from tessellate.operators import assign as A
from tessellate.operators import clean as CL
from tessellate.operators import dbscan as DB
from tessellate.operators import profile as PR
from tessellate.operators import quality as Q
from tessellate.operators import sample as SM
from tessellate.operators import search as SE
from tessellate.operators import stats as S


def test_silhouette_honours_its_sample_and_tiles(spark):
    df = spark.range(300).select(F.col("id"), (F.col("id") % 3).alias("c"),
                                 (F.col("id") % 3 * 5 + F.col("id") / 100).alias("x"), (F.col("id") % 7 / 10).alias("y"))
    whole = Q.silhouette_samples(df, "c", ["x", "y"], "id").orderBy("id").collect()
    assert len(whole) == 300 and Q.silhouette_samples(df, "c", ["x", "y"], "id", 120).count() == 120
    blocked = Q.silhouette_samples(df, "c", ["x", "y"], "id", tile_rows=23).orderBy("id").collect()
    assert [(r.id, r.cluster, round(r.silhouette, 9)) for r in blocked] == \
        [(r.id, r.cluster, round(r.silhouette, 9)) for r in whole]


def test_string_ids(spark):
    df = spark.range(60).select(F.concat(F.lit("row-"), "id").alias("id"), (F.col("id") % 2).alias("c"),
                                F.col("id").cast("double").alias("x"))
    assert SM.uniform_sample(df, 10, "id").count() == 10
    assert Q.silhouette_samples(df, "c", ["x"], "id", 20).count() == 20
    nn = A.propagate_nearest(df, df.where("x < 5"), ["x"], "id", "id", "c").where("id = 'row-9'").first()
    assert nn.nn_id == "row-4"


def test_samples_depend_on_the_seed_and_filter_before_the_top(spark):
    df = spark.range(5000)
    a, b = ({r.id for r in SM.uniform_sample(df, 500, "id", seed).collect()} for seed in (42, 4242))
    assert len(a) == len(b) == 500 and len(a & b) < 150
    assert "Filter" in SM.uniform_sample(df, 500, "id")._jdf.queryExecution().toString()
    same = spark.range(500).select(F.lit(7).alias("id"))  # repeated ids: the threshold widens
    assert SM.uniform_sample(same, 100, "id").count() == 100
    strata = SM.stratified_sample(spark.range(30000).withColumn("c", (F.col("id") % 3 == 0).cast("int")), "c", 3000, "id")
    assert {r["c"]: r["count"] for r in strata.groupBy("c").count().collect()} == {0: 2000, 1: 1000}


def test_wide_correlations_are_pairwise(spark):
    fs = [f"f{i}" for i in range(20)]
    df = spark.range(400).select(*[(F.sin(F.col("id") * (i + 1)) + F.col("id") / 200 * (i % 3)).alias(f) for i, f in enumerate(fs)])
    df = df.withColumn("f19", F.when(F.monotonically_increasing_id() % 2 == 0, F.col("f19")))
    few = {(r.feature_1, r.feature_2): r.r for r in S.correlation_matrix(df, fs[:3]).collect()}
    wide = {(r.feature_1, r.feature_2): r.r for r in S.correlation_matrix(df, fs).collect()}
    assert all(wide[k] == pytest.approx(v, abs=1e-6) for k, v in few.items()) and len(wide) == 400


def test_components_never_stop_early(spark):
    v = spark.range(6)
    e = spark.createDataFrame([(i, i + 1) for i in range(5)], "src long, dst long")
    assert {r.comp for r in DB.connected_components(v, e).collect()} == {0}
    with pytest.raises(RuntimeError):
        DB.connected_components(v, e, max_rounds=1)


def test_duplicates_agree_with_cleaning(spark):
    df = spark.sql("SELECT * FROM VALUES (timestamp_micros(1), 0.0D, 'a'), (timestamp_micros(2), 0.0D, 'a'), "
                   "(timestamp_micros(2), -0.0D, 'a'), (NULL, 1.0D, 'b') AS t(ts, x, s)")
    n = df.count() - CL.drop_duplicate_rows(df).count()
    assert S.duplicate_count(df).first()[0] == n == 1


def test_first_label_that_is_not_null(spark):
    df = spark.createDataFrame([(1, 0, None), (2, 0, "x"), (3, 1, None)], "id long, c int, l string")
    assert {r.cluster: r.cluster_label for r in PR.cluster_label_counts(df, "c", "l", "id").collect()} == {0: "x", 1: None}


def test_query_without_a_cluster_searches_all(spark):
    df = spark.createDataFrame([(1, None, 0.0), (2, 0, 1.0), (3, 1, 2.0)], "id long, c int, x double")
    one = SE.similar_items(df, 1, ["x"], "id", "c").collect()
    many = SE.similar_items_many(df, df.where("id = 1"), ["x"], "id", "c").orderBy("rank").collect()
    assert [r.id for r in one] == [r.id for r in many] == [2, 3]


def test_elbow_of_flat_and_short_curves(spark):
    flat = spark.createDataFrame([(k, 5.0) for k in range(2, 6)], "k int, inertia double")
    assert tuple(Q.elbow_k(flat).first()) == (None, 4)
    assert Q.elbow_k(flat.where("k = 2")).first().elbow_k == 2


def test_empty_sample_has_no_neighbours(spark):
    df = spark.createDataFrame([(1, 0.5, 1)], "id long, x double, l int")
    assert tuple(A.propagate_nearest(df, df.limit(0), ["x"], "id", "id", "l").first()) == (1, None, None, None)


def test_candidate_pairs_do_not_overflow(spark):
    df = spark.range(3).select("id", F.lit(0.0).alias("x"))
    assert DB.candidate_pairs(df, ["x"], 1.0) == (3, 3)
