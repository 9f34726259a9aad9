"""Data behind the reference's charts; drawing is
not built.  V1-V3 live in ``stats``, V5/V8/V9/V11 in ``profile`` and
``quality``."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import present, rnd
from .profile import crosstab_pct, top_columns


WIDE = 16


def elbow_points(sweep: DataFrame, chosen_k) -> DataFrame:
    """V4: the sweep table with the chosen k flagged."""
    k = chosen_k if not isinstance(chosen_k, int) else F.lit(chosen_k)
    return sweep.withColumn("chosen", F.col("k") == k)


def silhouette_points(sweep: DataFrame) -> DataFrame:
    """V4: (k, silhouette) of a sweep, the best k flagged (first k on ties)."""
    best = sweep.agg(F.min_by("k", F.struct((-F.col("silhouette")).alias("neg"), F.col("k"))).alias("k")).scalar()
    return sweep.select("k", rnd(F.col("silhouette")).alias("silhouette"), (F.col("k") == best).alias("best"))


def pca_2d(df: DataFrame, features: Sequence[str], id_col: str, n_components: int = 2
           ) -> tuple[DataFrame, DataFrame]:
    """V7: projection on the leading principal components of the centred
    data, sign fixed so each component's largest-magnitude loading is
    positive.  Returns (rows (id, pc1, pc2), (component, variance_ratio)).

    The d x d covariance (pairwise-complete) comes from one aggregate job (a
    masked Gramian for wide tables); only that matrix is decomposed on the driver."""
    fs = present(df, features)
    d = len(fs)
    if d > WIDE:
        # wide tables: the same pairwise-complete covariances from masked pair sums
        from .stats import pair_sums
        mean = np.array([m or 0.0 for m in df.agg(*[F.avg(F.col(f).cast("double")) for f in fs]).first()])
        cov = np.zeros((d, d))
        for t in pair_sums(df, fs):
            if t["n"] > 1:
                c = (t["sxy"] - t["sx"] * t["sy"] / t["n"]) / (t["n"] - 1)
                cov[t["i"], t["j"]] = cov[t["j"], t["i"]] = c
    else:
        aggs = [F.avg(F.col(f).cast("double")).alias(f"m_{f}") for f in fs]
        for i in range(d):
            for j in range(i, d):
                aggs.append(F.covar_samp(F.col(fs[i]).cast("double"), F.col(fs[j]).cast("double"))
                            .alias(f"c_{i}_{j}"))
        row = df.agg(*aggs).first()
        mean = np.array([row[f"m_{f}"] for f in fs], dtype=float)
        cov = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                cov[i, j] = cov[j, i] = row[f"c_{i}_{j}"] or 0.0
    vals, vecs = np.linalg.eigh(cov)
    order = np.argsort(vals)[::-1][:n_components]
    comps = vecs[:, order]
    for c in range(comps.shape[1]):
        if comps[np.argmax(np.abs(comps[:, c])), c] < 0:
            comps[:, c] = -comps[:, c]
    total = vals.sum()
    proj = []
    for c in range(comps.shape[1]):
        e = None
        for i, f in enumerate(fs):
            term = (F.col(f).cast("double") - F.lit(float(mean[i]))) * F.lit(float(comps[i, c]))
            e = term if e is None else e + term
        proj.append(e.alias(f"pc{c + 1}"))
    rows = df.select(id_col, *proj)
    spark = df.sparkSession
    ratios = spark.createDataFrame(
        [(f"pc{c + 1}", float(vals[order[c]] / total) if total > 0 else None) for c in range(len(order))],
        "component string, variance_ratio double")
    return rows, ratios


def category_mix(df: DataFrame, row_col: str, category_col: str, top_n: int | None = None
                 ) -> DataFrame:
    """Stacked-bar data (all categories) or heatmap data (top-n
    categories by mean share across rows)."""
    ct = crosstab_pct(df, row_col, category_col)
    if not top_n:
        return ct
    top = top_columns(ct, top_n).select("value", "rank")
    return ct.join(F.broadcast(top), "value").select("row", "value", "rank", "count", "pct")


def decade_mix_sentence(decade_table: DataFrame) -> DataFrame:
    """V11 sentence: the number of decades shown."""
    n = decade_table.agg(F.count_distinct("decade").alias("n")).scalar()
    return decade_table.sparkSession.range(1).select(
        n.alias("n_decades"),
        F.format_string("Cluster mix across %d decades with enough rows.", n).alias("sentence"))


def projection_summary(rows: DataFrame, label_col: str) -> DataFrame:
    """Centre of each cluster in the 2-D projection (for chart labels)."""
    return rows.groupBy(label_col).agg(rnd(F.avg("pc1")).alias("pc1"), rnd(F.avg("pc2")).alias("pc2"))
