"""Filter, search and similar-item queries (SURVEY §2.2 P11-P15, §2.3 J6-J7,
§2.5 W2-W3, §2.7 X6).

Similar items are a top-k: the query vector is a one-row scalar, candidates
are filtered by cluster (pushed to the scan when the table is partitioned by
cluster), and ``orderBy(distance, id).limit(k)`` runs as a per-partition
top-k followed by one bounded merge - nothing of size n is ever sorted or
collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import present, rnd
from ..functions.scalar import similarity_score
from .assign import _sq_dist
from .metric import k_nearest


def text_match(c: str | Column, query: str, literal: bool = False) -> Column:
    """Regex (default) or literal match on lower-cased text; NULL -> false."""
    text = F.lower(F.col(c) if isinstance(c, str) else c)
    m = text.contains(F.lit(query.lower())) if literal else text.rlike(query.lower())
    return F.coalesce(m, F.lit(False))


def explore(df: DataFrame, equals: dict | None = None, query: str | None = None,
            text_cols: Sequence[str] = (), literal: bool = False) -> DataFrame:
    """Conjunctive equality filters plus an OR text search."""
    out = df
    for c, v in (equals or {}).items():
        if v is not None and c in df.columns:
            out = out.where(F.col(c) == F.lit(v))
    if query:
        cols = present(df, text_cols)
        cond = F.lit(False)
        for c in cols:
            cond = cond | text_match(c, query, literal)
        out = out.where(cond)
    return out


def explore_display(filtered: DataFrame, display_cols: Sequence[str], id_col: str,
                    limit: int = 500) -> DataFrame:
    """Existing display columns of the first ``limit`` rows (by id)."""
    cols = present(filtered, display_cols)
    return filtered.orderBy(id_col).limit(limit).select(id_col, *[c for c in cols if c != id_col])


def explore_count(df: DataFrame, filtered: DataFrame) -> DataFrame:
    """P13: "showing x of y" - filtered and total counts."""
    total = df.agg(F.count(F.lit(1)).alias("t")).scalar()
    return filtered.agg(F.count(F.lit(1)).alias("n_matching")).select(
        "n_matching", total.alias("n_total"))


def find_items(df: DataFrame, name_col: str, query: str, id_col: str,
               second_col: str | None = None, limit: int = 20, literal: bool = False) -> DataFrame:
    """First ``limit`` name matches with a "name - second" display text."""
    m = df.where(text_match(name_col, query, literal)).orderBy(id_col).limit(limit)
    disp = F.concat_ws(" - ", F.col(name_col), F.col(second_col)) if second_col else F.col(name_col)
    return m.select(id_col, name_col, *([second_col] if second_col else []),
                    disp.alias("display"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct non-null values."""
    return df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def similar_items(df: DataFrame, query_id, features: Sequence[str], id_col: str,
                  cluster_col: str | None = None, k: int = 10,
                  extra_cols: Sequence[str] = ()) -> DataFrame:
    """The k nearest rows to ``query_id`` (Euclidean in the given, usually
    scaled, feature space) within its cluster, itself excluded.  Returns
    (rank, id, extra..., distance, similarity_score); ties by id.

    ``query_id`` is a value or a Column (e.g. a scalar subquery)."""
    fs = present(df, features)
    qid = query_id if isinstance(query_id, Column) else F.lit(query_id)
    qcols = [F.col(f).cast("double").alias(f) for f in fs]
    if cluster_col:
        qcols.append(F.col(cluster_col).alias("_qc"))
    q = df.where(F.col(id_col) == qid).select(F.struct(*qcols).alias("q")).scalar()
    d = df.withColumn("_q", q)
    cand = d.where(F.col(id_col) != qid)
    if cluster_col:
        # a query row without a cluster searches the whole table
        cand = cand.where(F.col("_q._qc").isNull() | (F.col(cluster_col) == F.col("_q._qc")))
    dist = F.sqrt(_sq_dist([F.col(f).cast("double") for f in fs], [F.col(f"_q.{f}") for f in fs]))
    cand = cand.withColumn("_dist", dist).where(F.col("_q").isNotNull())
    top = cand.orderBy(F.col("_dist"), F.col(id_col)).limit(k)
    w = Window.orderBy("_dist", id_col)
    return top.select(F.row_number().over(w).alias("rank"), id_col,
                      *present(top, extra_cols),
                      rnd(F.col("_dist")).alias("distance"),
                      similarity_score(F.col("_dist")).alias("similarity_score"))


def similar_items_many(df: DataFrame, queries: DataFrame, features: Sequence[str], id_col: str,
                       cluster_col: str, k: int = 10, tile_rows: int | None = None) -> DataFrame:
    """J6 for any number of query rows, as a k-nearest join.

    A query searches the cells (``metric``) of its own cluster: the nearest ones
    for a first bound, then those that may hold a nearer row.  A query row
    without a cluster searches the whole table, as in J6.  Neither side is
    collected or broadcast; a hot cluster is many tiles in many tasks.  A query
    with a null, NaN or infinite feature has no similar rows."""
    fs = present(df, features)
    found, asked = k_nearest(queries, df, fs, k, id_col, id_col, group_col=cluster_col, exclude_self=True, tile_rows=tile_rows)
    named = asked.select("row", F.col("id").alias("query_id"))
    return found.join(named, "row").select("query_id", "rank", F.col("id").alias(id_col), rnd(F.col("distance")).alias("distance"),
                                           similarity_score(F.col("distance")).alias("similarity_score"))


def item_profile(df: DataFrame, item_id, features: Sequence[str], id_col: str) -> DataFrame:
    """One row's features min-max scaled against the whole table
    (denominator + 1e-10), as (axis, value) rows."""
    fs = present(df, features)
    rng = df.agg(F.struct(*[F.min(F.col(f).cast("double")).alias(f"{f}__min") for f in fs],
                          *[F.max(F.col(f).cast("double")).alias(f"{f}__max") for f in fs])
                 .alias("r")).scalar()
    row = df.where(F.col(id_col) == F.lit(item_id)).withColumn("_r", rng)
    vals = {f: (F.col(f).cast("double") - F.col(f"_r.{f}__min")) /
               (F.col(f"_r.{f}__max") - F.col(f"_r.{f}__min") + F.lit(1e-10)) for f in fs}
    wide = row.select(*[v.alias(f) for f, v in vals.items()])
    return wide.unpivot([], fs, "axis", "value").select("axis", rnd(F.col("value")).alias("value"))
