"""Driver tables and the feature tables derived from them.

Every feature table is a plain lazy DataFrame over the parquet scans, so
column pruning and filter pushdown reach the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import nan_to_null

ORDER_ID = "o_orderkey"
ORDER_FEATURES = ["o_totalprice", "n_lines", "sum_qty", "avg_disc", "avg_tax"]
LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order that has lines: price plus line aggregates.

    Lineitem is reduced to one row per order before the join (partial
    aggregation on the map side), and the aggregate's output partitioning on
    the order key is reused by the join, so each side is shuffled once."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).cast("double").alias("n_lines"),
        F.sum("l_quantity").alias("sum_qty"),
        F.avg("l_discount").alias("avg_disc"),
        F.avg("l_tax").alias("avg_tax"))
    o = table(spark, sf_dir, "orders").select(
        ORDER_ID, "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate",
        F.col("o_totalprice").cast("double").alias("o_totalprice"))
    return o.join(li, o[ORDER_ID] == li["l_orderkey"]).drop("l_orderkey")


def line_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return nan_to_null(li.select(*[F.col(c) for c in li.columns]))


def embedding_features(spark: SparkSession, sf_dir: str, dims: int = 64,
                       start: int = 0) -> tuple[DataFrame, list[str]]:
    """(vec_id, label, e{start}..e{start+dims-1}) as double scalar columns."""
    names = [f"e{i}" for i in range(start, start + dims)]
    e = table(spark, sf_dir, "embeddings")
    cols = [F.col("embedding")[i].cast("double").alias(n) for i, n in zip(range(start, start + dims), names)]
    return e.select("vec_id", "label", *cols), names


def documents_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents left-joined with labels (labels cover only some documents)."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id", "left")
