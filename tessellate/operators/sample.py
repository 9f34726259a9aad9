"""Reproducible samplers.

Samples are ordered by a portable hash of the row id (of any type) and the
seed, so the same rows are chosen on every run, after any executor loss, under
any partitioning, and by the SQL oracle:

    h(id, seed) = first 15 hex digits of md5(text of id || '#' || seed)

Ties on h are broken by the id.  A threshold on h, set from the row count with
slack, leaves about n rows before any of them meet in one task; a shortfall
(repeated ids) widens it.  The sample size is the operator's feature; fewer
rows than asked simply returns all rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_RANGE = 16 ** 15


def portable_hash(id_col: str | Column, seed: int = 42) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    digest = F.md5(F.concat(F.coalesce(c.cast("string"), F.lit("")), F.lit(f"#{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _cutoff(n: int, total: int, widen: int = 1) -> int:
    """Hash below which about n (and slack) of ``total`` rows lie."""
    want = (n + 6.0 * math.sqrt(n) + 20.0) * widen
    return HASH_RANGE if want >= total else int(HASH_RANGE * (want / total))


def uniform_sample(df: DataFrame, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """N rows without replacement, the lowest hashes."""
    h = portable_hash(id_col, seed)
    total, widen = df.count(), 1
    cut = _cutoff(n, total)
    while cut < HASH_RANGE and df.where(h < cut).count() < n:
        widen *= 4
        cut = _cutoff(n, total, widen)
    src = df if cut >= HASH_RANGE else df.where(h < cut)
    return src.orderBy(h, F.col(id_col)).limit(n)


def stratified_sample(df: DataFrame, label_col: str, n: int, id_col: str,
                      seed: int = 42) -> DataFrame:
    """Per label ``max(1, int(n * size / N))`` rows, chosen by hash order.

    Labels are few (a clustering's); their sizes are collected and give each
    label its threshold, so about its quota of rows reaches the ranking
    window, whatever n is and however many rows the label has."""
    h = portable_hash(id_col, seed)
    sizes = {r[0]: r[1] for r in df.where(F.col(label_col).isNotNull()).groupBy(label_col)
             .agg(F.count(F.lit(1))).collect()}
    if not sizes:
        return df.limit(0)
    total = df.count()
    quota = {k: max(1, int(math.floor(float(n) * v / total))) for k, v in sizes.items()}
    widen = dict.fromkeys(sizes, 1)
    kind = df.schema[label_col].dataType
    while True:
        cuts = {k: _cutoff(quota[k], sizes[k], widen[k]) for k in sizes}
        table = F.create_map(*[x for k, v in cuts.items() for x in (F.lit(k).cast(kind), F.lit(v))])
        near = df.where(h < table[F.col(label_col)])
        found = {r[0]: r[1] for r in near.groupBy(label_col).agg(F.count(F.lit(1))).collect()}
        short = [k for k in sizes if cuts[k] < HASH_RANGE and found.get(k, 0) < quota[k]]
        if not short:
            break
        widen.update({k: widen[k] * 4 for k in short})
    quotas = F.create_map(*[x for k, v in quota.items() for x in (F.lit(k).cast(kind), F.lit(v))])
    w = Window.partitionBy(label_col).orderBy(h, F.col(id_col))
    return (near.withColumn("_rn", F.row_number().over(w))
            .where(F.col("_rn") <= quotas[F.col(label_col)]).drop("_rn"))


def silhouette_order(samples: DataFrame, label_col: str = "cluster", value_col: str = "silhouette",
                     id_col: str = "row_id", gap: int = 10) -> DataFrame:
    """Rows of a silhouette diagram: within each cluster ascending value;
    clusters stacked bottom-up with ``gap`` rows between them, starting at gap.

    Input is a bounded silhouette sample (M1)."""
    sizes = samples.groupBy(label_col).agg(F.count(F.lit(1)).alias("_size"))
    wc = Window.orderBy(label_col).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(label_col, "_size",
                          (F.lit(gap) + F.coalesce(F.sum(F.col("_size") + gap).over(wc), F.lit(0)))
                          .alias("y_lower"))
    w = Window.partitionBy(label_col).orderBy(value_col, id_col)
    pos = samples.withColumn("_pos", F.row_number().over(w) - 1)
    return pos.join(F.broadcast(starts), label_col).select(
        label_col, id_col, value_col, (F.col("y_lower") + F.col("_pos")).cast("long").alias("y"),
        "y_lower", (F.col("y_lower") + F.col("_size")).cast("long").alias("y_upper"))
