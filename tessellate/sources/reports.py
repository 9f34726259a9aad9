"""Text reports as long-format tables.

A report is a DataFrame (section, position, key, value) assembled by
``unionByName`` from the small outputs of the operators; ``write_report``
renders it to one text file.  Sentences are computed from the tables - no
finding is hard-coded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import stats as S
from ..operators.profile import dominant_per_row, profile_long, top_columns
from ..operators.quality import recommend
from ..session import cut_lineage

_COLS = ("section", "position", "key", "value")


def _fmt(c: Column, nd: int = 4) -> Column:
    return F.when(c.isNull(), F.lit("n/a")).otherwise(F.format_number(c.cast("double"), nd))


def _rows(df: DataFrame, section: str, key: Column, value: Column, order: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), order.cast("long").alias("position"),
                     key.cast("string").alias("key"), value.cast("string").alias("value"))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def insights_report(df: DataFrame, features: Sequence[str], categorical: Sequence[str] = (),
                    flag: str | None = None, top_n: int = 15, id_col: str | None = None,
                    name_col: str | None = None, date_col: str | None = None) -> DataFrame:
    """The data-profile report over a raw (uncleaned) table, which is written
    once: every section reads it again, not what it was derived from."""
    df = cut_lineage(df)
    parts = []
    ov = S.table_overview(df)
    parts.append(union_all([
        _rows(ov, "1. overview", F.lit("rows"), F.col("n_rows"), F.lit(0)),
        _rows(ov, "1. overview", F.lit("columns"), F.col("n_columns"), F.lit(1))]))
    dt = S.dtypes_nonnull(df)
    parts.append(_rows(dt, "2. dtypes", F.col("column"),
                       F.concat_ws(" ", F.col("dtype"), F.col("non_null").cast("string")), F.col("position")))
    kinds = [(kind, name) for _, name, _, kind in S.column_kinds(df)]
    one = df.sparkSession.range(1)
    for at, (title, of) in enumerate((("numeric columns", ("numeric",)), ("text columns", ("text", "other")))):
        names = [n for k, n in kinds if k in of]
        parts.append(_rows(one, "2. dtypes", F.lit(title), F.lit(f"{len(names)}: {', '.join(names)}"),
                           F.lit(len(kinds) + 1 + at)))
    miss = S.missing_report(df)
    parts.append(_rows(miss, "3. missing", F.col("column"),
                       F.format_string("%d (%.2f%%)", F.col("n_missing"), F.col("pct_missing")),
                       F.lit(0)))
    dup = S.duplicate_count(df, None, "d")
    parts.append(_rows(dup, "4. duplicates", F.lit("duplicate rows"), F.col("d"), F.lit(0)))
    for at, (title, c) in enumerate((("duplicate ids", id_col), ("duplicate names", name_col)), 1):
        if c:
            parts.append(_rows(S.duplicate_count(df, [c], "d"), "4. duplicates", F.lit(title), F.col("d"), F.lit(at)))
    desc = S.describe(df, features)
    parts.append(_rows(desc, "5. describe", F.col("feature"),
                       F.concat_ws(" ", *[_fmt(F.col(c)) for c in
                                          ("mean", "std", "min", "p25", "p50", "p75", "max")]),
                       F.lit(0)))
    deep = S.feature_deepdive(df, features)
    parts.append(_rows(deep, "6. features", F.col("feature"),
                       F.format_string("median %s skew %s kurt %s iqr %s outliers %d (%.1f%%)",
                                       _fmt(F.col("median")), _fmt(F.col("skew")), _fmt(F.col("kurt")),
                                       _fmt(F.col("iqr")), F.col("n_outliers"), F.col("pct_outliers")),
                       F.lit(0)))
    pairs = S.correlated_pairs(df, features, 0.3)
    parts.append(_rows(pairs, "7. correlations", F.concat_ws(" ~ ", "feature_1", "feature_2"),
                       F.concat_ws(" ", F.format_string("%+.4f", F.col("r")), F.col("strength")),
                       F.lit(0)))
    if categorical:
        parts.append(_rows(S.distinct_count(df, list(categorical)), "8. distinct values", F.col("column"),
                           F.col("n_distinct"), F.lit(0)))
    if date_col:
        parts.append(_rows(S.min_max_text(df, date_col), "8. dates", F.lit(date_col),
                           F.format_string("%d distinct, %s to %s", F.col("n_distinct"), F.coalesce("earliest", F.lit("n/a")),
                                           F.coalesce("latest", F.lit("n/a"))), F.lit(0)))
    for c in categorical:
        vc = S.value_counts(df, c, top_n)
        parts.append(_rows(vc, f"8. {c}", F.col("value"),
                           F.format_string("%d (%.1f%%)", F.col("count"), F.col("pct")), F.lit(0)))
    if flag:
        fc = S.flag_counts(df, flag)
        parts.append(_rows(fc, f"8. {flag}", F.col("label"),
                           F.format_string("%d (%.1f%%)", F.col("count"), F.col("pct")), F.col("flag")))
    out = S.iqr_outliers(df, features)
    parts.append(_rows(out, "9. outliers", F.col("feature"),
                       F.format_string("%d (%.1f%%)", F.col("n_outliers"), F.col("pct_outliers")),
                       F.lit(0)))
    rows = S.rows_with_outlier(df, features)
    parts.append(_rows(rows, "9. outliers", F.lit("rows with >= 1 outlier"),
                       F.format_string("%d (%.1f%%)", F.col("n_rows_with_outlier"), F.col("pct_rows")),
                       F.lit(1)))
    q = S.quality_summary(df)
    n_numeric = sum(k == "numeric" for k, _ in kinds)
    parts.append(_rows(
        q.select("verdict", F.explode(F.array(*[
            F.struct(F.lit(i).alias("at"), F.lit(t).alias("title"), v.cast("string").alias("v")) for i, (t, v) in enumerate((
                ("missing values", F.col("total_missing")), ("duplicate rows", F.col("duplicate_rows")),
                ("rows", F.col("n_rows")), ("columns", F.col("n_columns")), ("numeric features", F.lit(n_numeric)),
                ("text features", F.lit(len(kinds) - n_numeric)), ("clustering features", F.lit(len(features))),
                ("data quality", F.col("verdict"))))])).alias("x")),
        "10. verdict", F.col("x.title"), F.col("x.v"), F.col("x.at")))
    return union_all(parts).select(*_COLS)


def summary_report(k_comparison: DataFrame, comparison: DataFrame, profile: DataFrame,
                   names: DataFrame, sizes: DataFrame, mix: DataFrame, top_n: int = 5,
                   popularity: DataFrame | None = None, decades: DataFrame | None = None) -> DataFrame:
    """K comparison, algorithm comparison, recommendation, cluster
    characteristics with their feature means, the top categories per cluster,
    the category that a cluster recovered best, and, where their tables are
    given (A25, A22), the most popular cluster and each decade's dominant one."""
    parts = [
        _rows(k_comparison, "1. k comparison", F.format_string("k=%d", F.col("k")),
              F.format_string("silhouette %s  davies-bouldin %s  inertia %s  sizes %s",
                              _fmt(F.col("silhouette")), _fmt(F.col("davies_bouldin")),
                              _fmt(F.col("inertia"), 1), F.col("sizes")), F.col("k")),
        _rows(comparison, "2. algorithms", F.col("algorithm"),
              F.format_string("silhouette %s  davies-bouldin %s  clusters %d  noise %d",
                              _fmt(F.col("silhouette_score")), _fmt(F.col("davies_bouldin_index")),
                              F.col("n_clusters"), F.coalesce(F.col("n_noise"), F.lit(0))), F.lit(0)),
        _rows(recommend(comparison), "3. recommendation", F.lit("algorithm"), F.col("recommended"),
              F.lit(0)),
    ]
    prof = profile.join(names, "cluster", "left").join(sizes.select("cluster", "count", "pct"), "cluster", "left")
    parts.append(_rows(prof, "4. clusters", F.format_string("cluster %d", F.col("cluster")),
                       F.format_string("%s - %d rows (%.1f%%)", F.col("cluster_label"), F.col("count"),
                                       F.col("pct")), F.col("cluster")))
    # the categories of the highest mean share over clusters, the same for every cluster
    top = mix.join(F.broadcast(top_columns(mix, top_n).select("value", F.col("rank").alias("_r"))), "value")  # top_n rows
    parts.append(_rows(top, "5. mix", F.format_string("cluster %s", F.col("row").cast("string")),
                       F.format_string("%s %.1f%%", F.col("value"), F.col("pct")),
                       F.col("_r")))
    features = [c for c in profile.columns if c != "cluster"]
    parts.append(_rows(profile_long(profile, features, normalise=False), "4. feature means",
                       F.format_string("cluster %d %s", F.col("cluster"), F.col("axis")),
                       F.format_string("%.4f", F.col("value").cast("double")),
                       F.col("cluster") * len(features) + F.col("position")))
    best = mix.agg(F.min_by(F.struct("row", "value", "pct"), F.struct(-F.col("pct"), F.col("row"), F.col("value"))).alias("b"))
    parts.append(_rows(best, "6. validation", F.lit("category recovered best"),
                       F.format_string("Cluster %s holds %.1f%% %s; the fit used no such label.",
                                       F.col("b.row").cast("string"), F.col("b.pct"), F.col("b.value")), F.lit(0)))
    if popularity is not None:
        parts.append(_rows(popularity, "7. popularity", F.lit("most popular cluster"), F.col("sentence"), F.lit(0)))
    if decades is not None:
        top_of = dominant_per_row(decades, "decade", "cluster")
        parts.append(_rows(top_of, "8. decades", F.col("row").cast("string"),
                           F.format_string("dominated by cluster %s", F.col("dominant").cast("string")), F.col("row")))
    return union_all(parts).select(*_COLS)


def write_report(report: DataFrame, path: str) -> str:
    """Render a report table to a single text file, ordered by section."""
    lines = report.orderBy("section", "position", "key").select(
        F.format_string("%-20s %-30s %s", F.col("section"), F.col("key"), F.col("value")).alias("value"))
    lines.coalesce(1).write.mode("overwrite").text(path)
    return path
