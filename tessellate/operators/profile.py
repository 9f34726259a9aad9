"""Cluster profiles and cross-tabulations (SURVEY §2.4 A17-A27, §2.5 W1,
§2.7 X5, X7).

Every output has at most (#clusters x #categories) rows; the inputs are
reduced by grouped aggregation with map-side combining, so a cluster holding
a third of all rows costs one partial row per task, not a hot reducer.
Crosstabs are long-form: an absent cell is an absent row (0 %), and column
means divide by the number of clusters, so no cluster x category grid is
ever materialised.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bounded_broadcast, pct, present, rnd
from ..functions.scalar import CLUSTER_NAME_RULES, cluster_name, display_name
from .stats import box_stats


def cluster_profile(df: DataFrame, cluster_col: str, features: Sequence[str],
                    drop_noise: bool = True, noise: int = -1) -> DataFrame:
    """Mean of each feature per cluster (noise excluded by default)."""
    fs = present(df, features)
    src = df.where(F.col(cluster_col) != noise) if drop_noise else df
    return src.groupBy(F.col(cluster_col).alias("cluster")).agg(
        *[rnd(F.avg(F.col(f).cast("double"))).alias(f) for f in fs])


def profile_normalised(profile: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per-feature min-max across the clusters' means (constant -> 0)."""
    w = Window.partitionBy()  # k rows
    out = {}
    for f in present(profile, features):
        lo, hi = F.min(f).over(w), F.max(f).over(w)
        out[f] = rnd(F.when(hi == lo, F.lit(0.0)).otherwise((F.col(f) - lo) / (hi - lo)))
    return profile.withColumns(out)


def profile_long(profile: DataFrame, features: Sequence[str], normalise: bool = True,
                 close: bool = False) -> DataFrame:
    """V9: (cluster, axis, position, value) for heatmaps / radar / bars; with
    ``close`` the first axis is repeated at the end (radar closing point)."""
    fs = present(profile, features)
    p = profile_normalised(profile, fs) if normalise else profile
    pos = {f: i for i, f in enumerate(fs)}
    lv = p.unpivot(["cluster"], fs, "axis", "value")
    idx = F.create_map(*[x for f, i in pos.items() for x in (F.lit(f), F.lit(i))])
    lv = lv.withColumn("position", idx[F.col("axis")])
    if close:
        first = lv.where(F.col("position") == 0).withColumn("position", F.lit(len(fs)))
        lv = lv.unionByName(first)
    return lv.select("cluster", "axis", "position", "value")


def name_clusters(profile: DataFrame,
                  rules: Sequence[tuple[str, str, float, str]] = CLUSTER_NAME_RULES) -> DataFrame:
    """(cluster, cluster_label) from threshold rules on the profile."""
    return profile.select("cluster", cluster_name(profile.columns, rules).alias("cluster_label"))


def cluster_sizes(df: DataFrame, cluster_col: str) -> DataFrame:
    """Count and share per label (noise shown as its own label)."""
    g = df.groupBy(F.col(cluster_col).alias("cluster")).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy())
    return g.select("cluster", "count", rnd(pct(F.col("count"), total)).alias("pct"),
                    display_name(F.col("cluster")).alias("display"))


def crosstab_pct(df: DataFrame, row_col: str, col_col: str, drop_noise: bool = False,
                 noise: int = -1) -> DataFrame:
    """Row-normalised % (long form: row, value, count, pct).

    The row totals are one row per cluster, joined back after a size check:
    no task holds all values of a cluster."""
    src = df.where(F.col(row_col) != noise) if drop_noise else df
    g = src.groupBy(F.col(row_col).alias("row"), F.col(col_col).alias("value")) \
           .agg(F.count(F.lit(1)).alias("count"))
    tot = bounded_broadcast(src.groupBy(F.col(row_col).alias("_row")).agg(F.count(F.lit(1)).alias("_tot")))
    return g.join(tot, g["row"].eqNullSafe(tot["_row"])).select(
        "row", "value", "count", rnd(pct(F.col("count"), F.col("_tot"))).alias("pct"))


def top_columns(crosstab: DataFrame, n: int | None = None) -> DataFrame:
    """Columns by unweighted mean % over all rows (absent cell = 0)."""
    n_rows = crosstab.agg(F.count_distinct("row").alias("k")).scalar()
    m = crosstab.groupBy("value").agg((F.sum("pct") / n_rows).alias("_m"))
    w = Window.orderBy(F.desc("_m"), F.asc("value"))
    if n:  # each task's top n meet, not all values
        m = m.orderBy(F.desc("_m"), F.asc("value")).limit(n)
    ranked = m.select("value", rnd(F.col("_m")).alias("mean_pct"),
                      F.row_number().over(w).alias("rank"))
    return ranked.where(F.col("rank") <= n) if n else ranked


def decade_by_cluster(df: DataFrame, cluster_col: str, decade_col: str, min_count: int = 50,
                      noise: int = -1) -> DataFrame:
    """Drop NULL decades and noise, keep decades with >= min_count
    rows; % of each cluster within each decade (decade, cluster, count, pct)."""
    src = df.where(F.col(decade_col).isNotNull() & (F.col(cluster_col) != noise))
    g = src.groupBy(F.col(decade_col).alias("decade"), F.col(cluster_col).alias("cluster")) \
           .agg(F.count(F.lit(1)).alias("count"))
    tot = F.sum("count").over(Window.partitionBy("decade"))
    out = g.select("decade", "cluster", "count", tot.alias("_t"))
    return out.where(F.col("_t") >= min_count).select(
        "decade", "cluster", "count", rnd(pct(F.col("count"), F.col("_t"))).alias("pct"))


def dominant_per_row(crosstab: DataFrame, row_name: str = "row", col_name: str = "value",
                     pct_name: str = "pct") -> DataFrame:
    """The column with the largest % in each row (ties -> smallest)."""
    return crosstab.groupBy(F.col(row_name).alias("row")).agg(
        F.min_by(col_name, F.struct(-F.col(pct_name), F.col(col_name))).alias("dominant"),
        F.max(pct_name).alias("pct"))


def popularity_by_cluster(df: DataFrame, cluster_col: str, metric: str, noise: int = -1
                          ) -> DataFrame:
    """Box statistics of ``metric`` per cluster, noise excluded."""
    src = df.where(F.col(cluster_col) != noise).withColumnRenamed(cluster_col, "cluster")
    return box_stats(src, [metric], ["cluster"]).drop("feature")


def best_cluster(df: DataFrame, cluster_col: str, metric: str, noise: int = -1) -> DataFrame:
    """Cluster with the highest median of ``metric`` (ties -> lowest id)
    and a sentence stating it."""
    box = popularity_by_cluster(df, cluster_col, metric, noise)
    best = box.agg(F.min_by(F.struct("cluster", "median"),
                            F.struct(-F.col("median"), F.col("cluster"))).alias("b"))
    return best.select(F.col("b.cluster").alias("cluster"), F.col("b.median").alias("median"),
                       F.format_string("Cluster %d has the highest median %s (%.2f).",
                                       F.col("b.cluster"), F.lit(metric), F.col("b.median"))
                       .alias("sentence"))


def cluster_label_counts(df: DataFrame, cluster_col: str, label_col: str, id_col: str) -> DataFrame:
    """The label of each cluster (its first non-null one by id) and the size."""
    return df.groupBy(F.col(cluster_col).alias("cluster")).agg(
        F.min_by(label_col, F.when(F.col(label_col).isNotNull(), F.col(id_col))).alias("cluster_label"),
        F.count(F.lit(1)).alias("count"))


def overview_kpis(df: DataFrame, cluster_col: str, entity_col: str, family_col: str) -> DataFrame:
    """Items, clusters, distinct entities (artists) and families."""
    return df.agg(F.count(F.lit(1)).alias("n_items"),
                  F.count_distinct(cluster_col).alias("n_clusters"),
                  F.count_distinct(entity_col).alias("n_entities"),
                  F.count_distinct(family_col).alias("n_families"))


def head_per_group(df: DataFrame, cluster_col: str, id_col: str, n: int = 5) -> DataFrame:
    """First n rows (by id) of every cluster.  The literal bound lets
    Spark cut each partition to n rows per cluster before the shuffle."""
    w = Window.partitionBy(cluster_col).orderBy(id_col)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n) \
             .withColumnRenamed("_rn", "position")
