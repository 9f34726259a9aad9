"""Readers, writers and the streaming form of the stateless scorer."""

import os
import tempfile

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tessellate.sources import files as IO
from tessellate.streaming.scoring import FittedScorer, score_stream


def test_csv_missing_tokens(spark):
    d = tempfile.mkdtemp(prefix="tess-csv-")
    path = os.path.join(d, "t.csv")
    with open(path, "w") as fh:
        fh.write("id,name,score\n1,NA,1.5\n2,None,n/a\n3,\"a, b\",2\n4,null,bad\n")
    schema = StructType([StructField("id", LongType()), StructField("name", StringType()),
                         StructField("score", DoubleType())])
    rows = IO.read_table(spark, path, schema, "csv").orderBy("id").collect()
    assert [r.name for r in rows] == [None, None, "a, b", None]
    assert [r.score for r in rows] == [1.5, None, 2.0, None]


def test_metrics_json_has_no_infinity(spark):
    d = tempfile.mkdtemp(prefix="tess-json-")
    df = spark.createDataFrame([("x", float("inf")), ("y", 1.0)], "k string, v double")
    path = IO.write_metrics(df, os.path.join(d, "m"))
    back = {r.k: r.v for r in spark.read.json(path).collect()}
    assert back == {"x": None, "y": 1.0}


def test_read_first_existing_and_reload(spark):
    d = tempfile.mkdtemp(prefix="tess-io-")
    df = spark.createDataFrame([(1, None), (2, "Pop")], "id long, family string")
    IO.write_table(df, os.path.join(d, "v1"))
    got = IO.read_first_existing(spark, [os.path.join(d, "v2"), os.path.join(d, "v1")], fill={"family": "Other"})
    assert sorted((r.id, r.family) for r in got.collect()) == [(1, "Other"), (2, "Pop")]
    calls = []
    IO.load_or_recompute(spark, os.path.join(d, "v1"), 3, lambda: calls.append(1) or df)
    assert calls == [1]


def test_streaming_scorer_matches_batch(spark):
    d = tempfile.mkdtemp(prefix="tess-stream-")
    src = os.path.join(d, "in")
    batch = spark.createDataFrame([(i, float(i), float(i % 7)) for i in range(50)], "id long, a double, b double")
    batch.write.parquet(src)
    scorer = FittedScorer(["a", "b"], [25.0, 3.0], [10.0, 2.0], [[-1.0, 0.0], [1.0, 0.0]], {0: "low", 1: "high"})
    stream = spark.readStream.schema(batch.schema).parquet(src)
    q = (score_stream(stream, scorer).writeStream.format("memory").queryName("scored_stream")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = {r.id: (r.cluster, r.cluster_label) for r in spark.table("scored_stream").collect()}
    want = {r.id: (r.cluster, r.cluster_label) for r in scorer.score(batch).collect()}
    assert got == want and len(got) == 50


def test_clustering_run_end_to_end(spark):
    from tessellate.plans.clustering_run import RunConfig, run
    from tessellate.plans.tables import ORDER_FEATURES, order_features
    out = tempfile.mkdtemp(prefix="tess-run-")
    cfg = RunConfig(features=ORDER_FEATURES, id_col="o_orderkey", date_col="o_orderdate",
                    family_source="o_orderpriority", family_keywords=(("urgent", "Urgent"), ("low", "Low")),
                    k_values=(2, 3, 4, 5), k_candidates=(2, 3), sweep_n_init=1, n_init=1,
                    dbscan_eps=0.8, dbscan_sample=500, hier_sample=500, silhouette_sample=500,
                    name_rules=())
    res = run(spark, order_features(spark, "/root/testdata/sf0.001"), cfg, out)
    m = {r.algorithm: r for r in res["metrics"].collect()}
    assert set(m) == {"K-Means", "DBSCAN", "Hierarchical"}
    n = order_features(spark, "/root/testdata/sf0.001").count()
    assert res["export"].count() == n
    assert sum(r["count"] for r in res["sizes"].collect()) == n
    assert res["report"].count() > 5
    for sub in ("clustered", "clustered_csv", "metrics", "results", "report", "labels"):
        assert os.path.isdir(os.path.join(out, sub))
