"""Flagship: "which orders are most like order X?"

orders + per-order line aggregates -> z-score (P7) -> k-means Lloyd rounds
from fixed seeds (C2) -> nearest centre (J2) -> top-10 nearest orders in the
same cluster (J6).

Plan shape at scale: lineitem is aggregated per order before its single
shuffle and joined with orders on the same key; the feature table is
persisted once and then only read; every Lloyd round is one scan plus a
k-row shuffle; centres, scaling parameters and the query vector are one-row
scalar subqueries; the final top-10 is a per-partition top-k.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.assign import nearest_centroid
from ..operators.kmeans import initial_centres_first_rows, kmeans_lloyd
from ..operators.search import similar_items
from ..operators.transform import scale
from .tables import ORDER_FEATURES, ORDER_ID, order_features

K = 3
N_ITER = 3
TOP = 10


META = ["o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate"]


def clustered_orders(spark: SparkSession, sf_dir: str, k: int = K, n_iter: int = N_ITER,
                     persist: bool = True) -> DataFrame:
    """(o_orderkey, z-scored features, raw_<feature>..., metadata, cluster)."""
    f = order_features(spark, sf_dir)
    feats = f.select(ORDER_ID, *ORDER_FEATURES, *[F.col(c).alias(f"raw_{c}") for c in ORDER_FEATURES],
                     *META)
    scaled, _ = scale(feats, ORDER_FEATURES, "standard")
    if persist:
        scaled = scaled.persist(StorageLevel.MEMORY_AND_DISK)
    init = initial_centres_first_rows(scaled, ORDER_FEATURES, ORDER_ID, k)
    cen = kmeans_lloyd(scaled, ORDER_FEATURES, init, k, n_iter)
    return nearest_centroid(scaled, cen, ORDER_FEATURES, k, out="cluster")


def clustered_orders_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clustered orders with the unscaled features under their own names
    (profiles describe the transformed, unscaled values)."""
    return with_raw_features(clustered_orders(spark, sf_dir))


def with_raw_features(c: DataFrame) -> DataFrame:
    return c.select(ORDER_ID, "cluster", *META,
                    *[F.col(f"raw_{f}").alias(f) for f in ORDER_FEATURES])


def most_expensive(lab: DataFrame):
    """Scalar: the most expensive clustered order (ties -> smallest key),
    read from the persisted clustered table (no second pass over lineitem)."""
    return lab.agg(F.min_by(ORDER_ID, F.struct(-F.col("raw_o_totalprice"), F.col(ORDER_ID)))
                   .alias("q")).scalar()


def similar_orders(spark: SparkSession, sf_dir: str, top: int = TOP) -> DataFrame:
    lab = clustered_orders(spark, sf_dir)
    return similar_items(lab, most_expensive(lab), ORDER_FEATURES, ORDER_ID,
                         cluster_col="cluster", k=top, extra_cols=["cluster"])
