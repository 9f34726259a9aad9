"""Descriptive statistics and data-quality profiles.

Conventions
* every result is a small long-format DataFrame (one row per feature, pair,
  value or bin);
* per-feature moments for *all* features are computed by one aggregate job;
  quantiles by one distributed job (``quantiles.feature_quantiles``), whose
  rank selection takes a handful of counting passes;
* those per-feature results (#features rows) are collected once and thresholds
  reach the next pass as literals - no join, no re-computation;
* NaN counts as missing (as in pandas): callers clean with ``nan_to_null``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import numeric_fields, pct, present, rnd, safe_div
from ..functions.scalar import correlation_strength
from .quantiles import feature_quantiles

ND = 6  # output rounding for doubles


def _explode_structs(df_one_row: DataFrame, col: str) -> DataFrame:
    return df_one_row.select(F.inline(col))


# ---------------------------------------------------------------- A1, A2, P3
def table_overview(df: DataFrame) -> DataFrame:
    """A1: rows, columns and the column list."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        F.lit(len(df.columns)).cast("long").alias("n_columns"),
        F.lit(",".join(df.columns)).alias("columns"))


def column_kinds(df: DataFrame) -> list[tuple[int, str, str, str]]:
    """(position, column, dtype, kind) from the schema."""
    num = set(numeric_fields(df))
    out = []
    for i, f in enumerate(df.schema.fields, 1):
        kind = "numeric" if f.name in num else (
            "text" if f.dataType.typeName() == "string" else "other")
        out.append((i, f.name, f.dataType.simpleString(), kind))
    return out


def dtypes_nonnull(df: DataFrame) -> DataFrame:
    """A2 + P3: dtype, kind and non-null count per column (one aggregate)."""
    kinds = column_kinds(df)
    structs = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                        F.lit(t).alias("dtype"), F.lit(k).alias("kind"),
                        F.count(F.col(f"`{c}`")).alias("non_null"))
               for i, c, t, k in kinds]
    return _explode_structs(df.agg(F.array(*structs).alias("s")), "s")


# ---------------------------------------------------------------- A3
def _is_missing(df: DataFrame, c: str):
    dt = df.schema[c].dataType.typeName()
    e = F.col(f"`{c}`")
    if dt in ("double", "float"):
        return e.isNull() | F.isnan(e)
    return e.isNull()


def missing_report(df: DataFrame, only_positive: bool = True) -> DataFrame:
    """A3: nulls (NaN included) and their share per column."""
    n = F.count(F.lit(1))
    structs = [F.struct(F.lit(c).alias("column"),
                        F.coalesce(F.sum(F.when(_is_missing(df, c), 1).otherwise(0)), F.lit(0))
                        .cast("long").alias("n_missing"), n.alias("_n"))
               for c in df.columns]
    long = _explode_structs(df.agg(F.array(*structs).alias("s")), "s")
    out = long.select("column", "n_missing",
                      rnd(pct(F.col("n_missing"), F.col("_n")), ND).alias("pct_missing"))
    return out.where(F.col("n_missing") > 0) if only_positive else out


def total_missing(df: DataFrame) -> DataFrame:
    expr = sum((F.when(_is_missing(df, c), 1).otherwise(0) for c in df.columns), F.lit(0))
    return df.agg(F.coalesce(F.sum(expr), F.lit(0)).cast("long").alias("total_missing"))


# ---------------------------------------------------------------- A4
def row_key(df: DataFrame, cols: Sequence[str] | None = None):
    """Null-safe, fixed-width identity of a row (or of ``cols``), the one that
    ``dropDuplicates`` uses: timestamps to the microsecond, both zeros alike.

    A SHA-256 of the JSON form keeps shuffles small for long text rows and
    distinguishes (NULL, 'x') from ('x', NULL)."""
    cols = list(cols or df.columns)
    if len(cols) == 1:
        return F.col(f"`{cols[0]}`")
    kinds = dict(df.dtypes)

    def exact(c):
        x = F.col(f"`{c}`")
        if kinds[c] == "timestamp":
            x = F.unix_micros(x)
        elif kinds[c] == "timestamp_ntz":
            x = F.unix_micros(F.to_timestamp_ltz(x))
        elif kinds[c] in ("double", "float"):
            x = x + F.lit(0.0)
        return x.alias(c)
    return F.sha2(F.to_json(F.struct(*[exact(c) for c in cols])), 256)


def duplicate_count(df: DataFrame, cols: Sequence[str] | None = None,
                    name: str = "duplicates") -> DataFrame:
    """A4: rows beyond the first per key (full row by default).

    A NULL single-column key counts as a value, like pandas ``duplicated``."""
    k = df.select(row_key(df, cols).alias("_k"))
    grp = k.groupBy("_k").agg(F.count(F.lit(1)).alias("_c"))
    return grp.agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("long").alias(name))


def duplicate_profile(df: DataFrame, key_sets: dict[str, Sequence[str] | None]
                      ) -> DataFrame:
    """A4 for several keys: (key, duplicates)."""
    parts = [duplicate_count(df, cols, "duplicates").select(F.lit(name).alias("key"), "duplicates")
             for name, cols in key_sets.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- moments
def _g1_g2(n, g1, g2):
    """Bias-corrected skewness G1 and excess kurtosis G2 (pandas / DuckDB)."""
    nd = n.cast("double")
    G1 = F.when(nd >= 3, g1 * F.sqrt(nd * (nd - 1)) / (nd - 2))
    G2 = F.when(nd >= 4, (nd - 1) / ((nd - 2) * (nd - 3)) * ((nd + 1) * g2 + 6))
    return G1, G2


def feature_moments(df: DataFrame, features: Sequence[str], with_ndv: bool = False) -> DataFrame:
    """(feature, n, mean, std, std_pop, min, max, skew, kurt[, ndv]) for all
    features in one aggregate job; skew/kurt are the bias-corrected G1/G2,
    ndv an approximate distinct count."""
    fs = present(df, features)
    structs = []
    for f in fs:
        x = F.col(f).cast("double")
        extra = [F.approx_count_distinct(x, 0.02).alias("ndv")] if with_ndv else []
        structs.append(F.struct(
            F.lit(f).alias("feature"), F.count(x).alias("n"), F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("std"), F.stddev_pop(x).alias("std_pop"),
            F.min(x).alias("min"), F.max(x).alias("max"),
            F.skewness(x).alias("_g1"), F.kurtosis(x).alias("_g2"), *extra))
    long = _explode_structs(df.agg(F.array(*structs).alias("s")), "s")
    G1, G2 = _g1_g2(F.col("n"), F.col("_g1"), F.col("_g2"))
    return long.select("feature", "n", "mean", "std", "std_pop", "min", "max",
                       G1.alias("skew"), G2.alias("kurt"), *(["ndv"] if with_ndv else []))


MOMENT_SCHEMA = ("feature string, n long, mean double, std double, std_pop double, min double, "
                 "max double, skew double, kurt double")


def collected_moments(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Moments of every feature as a small in-memory table (one row per
    feature, collected once)."""
    rows = feature_moments(df, features).collect()                     # #features rows
    return df.sparkSession.createDataFrame([tuple(r) for r in rows], MOMENT_SCHEMA)


def collected_quantiles(df: DataFrame, features: Sequence[str], probs: Sequence[float],
                        approx: bool = False) -> dict[tuple[str, float], float]:
    """{(feature, p): q} - #features x #probs values."""
    q = feature_quantiles(df, features, probs, approx=approx).collect()
    return {(r["feature"], float(r["prob"])): r["q"] for r in q}


# ---------------------------------------------------------------- A5, A6, A7
def describe(df: DataFrame, features: Sequence[str] | None = None,
             approx: bool = False) -> DataFrame:
    """A5: count, mean, std, min, 25/50/75 %, max per numeric column."""
    fs = present(df, features) if features else numeric_fields(df)
    m = collected_moments(df, fs)
    q = collected_quantiles(df, fs, [0.25, 0.5, 0.75], approx)
    j = m.withColumns({nm: F.create_map(*[x for f in fs for x in (F.lit(f), F.lit(q.get((f, p))))])
                       [F.col("feature")].cast("double")
                       for p, nm in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))})
    return j.select("feature", F.col("n").alias("count"),
                    *[rnd(F.col(c), ND).alias(c) for c in
                      ("mean", "std", "min", "p25", "p50", "p75", "max")])


def feature_summary(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean, std, min, max, range per feature."""
    m = feature_moments(df, features)
    return m.select("feature", rnd(F.col("mean")).alias("mean"), rnd(F.col("std")).alias("std"),
                    rnd(F.col("min")).alias("min"), rnd(F.col("max")).alias("max"),
                    rnd(F.col("max") - F.col("min")).alias("range"))


def _bounds(df: DataFrame, fs: Sequence[str], approx: bool, whisker: float = 1.5) -> dict[str, tuple[float, float, float, float, float]]:
    """feature -> (q1, median, q3, lower, upper) from one quantile job."""
    q = collected_quantiles(df, fs, [0.25, 0.5, 0.75], approx)
    out = {}
    for f in fs:
        q1, med, q3 = q.get((f, 0.25)), q.get((f, 0.5)), q.get((f, 0.75))
        if q1 is None:
            out[f] = (None, None, None, None, None)
        else:
            out[f] = (q1, med, q3, q1 - whisker * (q3 - q1), q3 + whisker * (q3 - q1))
    return out


def iqr_bounds(df: DataFrame, features: Sequence[str], approx: bool = False,
               whisker: float = 1.5) -> DataFrame:
    """(feature, q1, median, q3, iqr, lower, upper), one row per feature."""
    fs = present(df, features)
    b = _bounds(df, fs, approx, whisker=whisker)
    rows = [(f, *v, None if v[0] is None else v[2] - v[0]) for f, v in b.items()]
    t = df.sparkSession.createDataFrame(
        rows, "feature string, q1 double, median double, q3 double, lower double, upper double, iqr double")
    return t.select("feature", "q1", "median", "q3", "iqr", "lower", "upper")


def _outlier_flag(f: str, lo, hi):
    if lo is None:
        return F.lit(False)
    return F.coalesce((F.col(f) < F.lit(lo)) | (F.col(f) > F.lit(hi)), F.lit(False))


def _outlier_counts(df: DataFrame, fs: Sequence[str], bounds) -> DataFrame:
    structs = [F.struct(F.lit(f).alias("feature"),
                        F.coalesce(F.sum(_outlier_flag(f, bounds[f][3], bounds[f][4]).cast("long")),
                                   F.lit(0)).cast("long").alias("n_outliers"),
                        F.count(F.lit(1)).alias("_n")) for f in fs]
    long = _explode_structs(df.agg(F.array(*structs).alias("s")), "s")
    return long.select("feature", "n_outliers",
                       rnd(pct(F.col("n_outliers"), F.col("_n"))).alias("pct_outliers"))


def iqr_outliers(df: DataFrame, features: Sequence[str], approx: bool = False) -> DataFrame:
    """Count and share of values outside [Q1-1.5 IQR, Q3+1.5 IQR].

    Two passes: the quantiles (a #features-row result), then one counting
    pass with the bounds as literals."""
    fs = present(df, features)
    return _outlier_counts(df, fs, _bounds(df, fs, approx))


def rows_with_outlier(df: DataFrame, features: Sequence[str], approx: bool = False) -> DataFrame:
    """Rows with at least one outlying feature, and their share."""
    fs = present(df, features)
    b = _bounds(df, fs, approx)
    any_o = F.lit(False)
    for f in fs:
        any_o = any_o | _outlier_flag(f, b[f][3], b[f][4])
    return df.agg(F.coalesce(F.sum(any_o.cast("long")), F.lit(0)).cast("long").alias("n_rows_with_outlier"),
                  F.count(F.lit(1)).alias("_n")) \
             .select("n_rows_with_outlier",
                     rnd(pct(F.col("n_rows_with_outlier"), F.col("_n"))).alias("pct_rows"))


def feature_deepdive(df: DataFrame, features: Sequence[str], approx: bool = False) -> DataFrame:
    """Range, mean, median, std, skew, kurtosis, IQR and outliers per
    feature: moments (one pass), quantiles (one pass), outlier counts (one
    pass)."""
    fs = present(df, features)
    m = collected_moments(df, fs)
    b = _bounds(df, fs, approx)
    o = _outlier_counts(df, fs, b)

    def lut(i):
        return F.create_map(*[x for f in fs for x in (F.lit(f), F.lit(b[f][i]))])[F.col("feature")] \
            .cast("double")
    j = m.withColumns({"median": lut(1), "iqr": lut(2) - lut(0)}).join(F.broadcast(o), "feature")
    return j.select("feature", rnd(F.col("min")).alias("min"), rnd(F.col("max")).alias("max"),
                    rnd(F.col("max") - F.col("min")).alias("range"),
                    rnd(F.col("mean")).alias("mean"), rnd(F.col("median")).alias("median"),
                    rnd(F.col("std")).alias("std"), rnd(F.col("skew")).alias("skew"),
                    rnd(F.col("kurt")).alias("kurt"), rnd(F.col("iqr")).alias("iqr"),
                    "n_outliers", "pct_outliers")


# ---------------------------------------------------------------- A10, A11, V2
MAX_PAIRWISE_FEATURES = 16


def pair_sums(df: DataFrame, fs: Sequence[str]) -> list:
    """Per feature pair (i <= j) the sums over the rows where both are present:
    (i, j, n, sx, sy, sxx, syy, sxy), of values less their column mean.  Each
    task sends its d(d+1)/2 partial sums once, whatever its rows."""
    import numpy as np
    import pandas as pd
    d = len(fs)
    src = df.select(*[F.col(f).cast("double").alias(f) for f in fs])
    means = [m or 0.0 for m in src.agg(*[F.avg(f) for f in fs]).first()]
    upper = np.triu_indices(d)

    def run(batches):
        total = np.zeros((6, d, d))
        for pdf in batches:
            x = pdf.to_numpy(dtype=np.float64, na_value=np.nan) - np.array(means)
            there = (~np.isnan(x)).astype(np.float64)
            x = np.where(there > 0, x, 0.0)
            sq = x * x
            total += np.stack([there.T @ there, x.T @ there, there.T @ x, sq.T @ there, there.T @ sq, x.T @ x])
        yield pd.DataFrame({"i": upper[0].astype(np.int64), "j": upper[1].astype(np.int64),
                            **{c: t[upper] for c, t in zip(PAIR_SUMS, total)}})

    parts = src.mapInPandas(run, "i long, j long, " + ", ".join(f"{c} double" for c in PAIR_SUMS))
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in PAIR_SUMS]).collect()  # d(d+1)/2 rows


PAIR_SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def _correlation_gramian(df: DataFrame, fs: Sequence[str]) -> DataFrame:
    """Wide tables: pairwise-complete Pearson r from masked Gramian sums,
    instead of d^2 aggregate expressions."""
    rows = []
    for t in pair_sums(df, fs):
        r = None
        if t["n"] > 0:
            va, vb = t["sxx"] - t["sx"] ** 2 / t["n"], t["syy"] - t["sy"] ** 2 / t["n"]
            if va > 1e-12 * t["sxx"] and vb > 1e-12 * t["syy"]:
                r = 1.0 if t["i"] == t["j"] else float((t["sxy"] - t["sx"] * t["sy"] / t["n"]) / (va * vb) ** 0.5)
        rows.append((fs[t["i"]], fs[t["j"]], r))
        if t["i"] != t["j"]:
            rows.append((fs[t["j"]], fs[t["i"]], r))
    out = df.sparkSession.createDataFrame(rows, "feature_1 string, feature_2 string, r double")
    return out.select("feature_1", "feature_2", rnd(F.col("r")).alias("r"))


def correlation_matrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """A10: Pearson r of every feature pair (pairwise-complete rows) in one job.

    Built from population co-moments with a guarded divide: a constant column
    gives NULL instead of raising under ANSI mode.  Above
    ``MAX_PAIRWISE_FEATURES`` features the d^2 expressions would defeat
    code generation, so the same pair sums come from a masked Gramian."""
    fs = present(df, features)
    if len(fs) > MAX_PAIRWISE_FEATURES:
        return _correlation_gramian(df, fs)
    structs = []
    for i, a in enumerate(fs):
        for j, b in enumerate(fs):
            if j < i:
                continue
            xa, xb = F.col(a).cast("double"), F.col(b).cast("double")
            both = xa.isNotNull() & xb.isNotNull()
            va = F.var_pop(F.when(both, xa))
            vb = F.var_pop(F.when(both, xb))
            r = safe_div(F.covar_pop(xa, xb), F.sqrt(va * vb))
            structs.append(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"),
                                    F.lit(a).alias("feature_1"), F.lit(b).alias("feature_2"),
                                    r.alias("r")))
    upper = _explode_structs(df.agg(F.array(*structs).alias("s")), "s")
    lower = upper.where(F.col("i") != F.col("j")).select(
        F.col("j").alias("i"), F.col("i").alias("j"),
        F.col("feature_2").alias("feature_1"), F.col("feature_1").alias("feature_2"), "r")
    full = upper.unionByName(lower)
    # a feature with itself is 1 unless it has no variance
    r = F.when((F.col("i") == F.col("j")) & F.col("r").isNotNull(), F.lit(1.0)).otherwise(F.col("r"))
    return full.select("feature_1", "feature_2", rnd(r).alias("r"))


def correlation_lower(corr: DataFrame, features: Sequence[str]) -> DataFrame:
    """V2: cells strictly below the diagonal of A10."""
    pos = {f: i for i, f in enumerate(features)}
    idx = F.create_map(*[x for f, i in pos.items() for x in (F.lit(f), F.lit(i))])
    return corr.where(idx[F.col("feature_1")] > idx[F.col("feature_2")])


def correlated_pairs(df: DataFrame, features: Sequence[str], threshold: float = 0.3,
                     strong: float = 0.5) -> DataFrame:
    """Upper-triangle pairs with |r| > threshold, strength label."""
    fs = present(df, features)
    corr = correlation_matrix(df, fs)
    pos = {f: i for i, f in enumerate(fs)}
    idx = F.create_map(*[x for f, i in pos.items() for x in (F.lit(f), F.lit(i))])
    up = corr.where(idx[F.col("feature_1")] < idx[F.col("feature_2")]) \
             .where(F.abs(F.col("r")) > threshold)
    return up.select("feature_1", "feature_2", "r",
                     correlation_strength(F.col("r"), strong).alias("strength"))


# ---------------------------------------------------------------- A12-A15, A28
def value_counts(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """Top-n values by count (ties by value), share of all rows."""
    total = df.agg(F.count(F.lit(1)).alias("t")).scalar()
    vc = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    vc = vc.select(F.col(column).alias("value"), "count", rnd(pct(F.col("count"), total)).alias("pct"))
    if n is not None:
        vc = vc.orderBy(F.desc("count"), F.asc("value")).limit(n)
    return vc


def distinct_count(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """Distinct non-null values per column.  Long values are counted by
    their 256-bit digest, so that whole texts are not expanded and shuffled."""
    fn = F.approx_count_distinct if approx else F.count_distinct
    kinds = dict(df.dtypes)

    def value(c):
        return F.sha2(F.col(c).cast("binary"), 256) if kinds[c] == "string" and not approx else F.col(c)
    structs = [F.struct(F.lit(c).alias("column"), fn(value(c)).alias("n_distinct"))
               for c in columns]
    return _explode_structs(df.agg(F.array(*structs).alias("s")), "s")


def min_max_text(df: DataFrame, column: str) -> DataFrame:
    """Distinct count, lexicographic earliest and latest."""
    c = F.col(column).cast("string")
    return df.agg(F.count_distinct(c).alias("n_distinct"), F.min(c).alias("earliest"),
                  F.max(c).alias("latest"))


def flag_counts(df: DataFrame, column: str, one_label: str = "Explicit",
                other_label: str = "Clean") -> DataFrame:
    """Counts and shares of a 0/1 flag, 1 -> one_label, else other_label.

    NULL flags are not counted (pandas ``value_counts`` drops them) but stay in
    the denominator."""
    total = df.agg(F.count(F.lit(1)).alias("t")).scalar()
    g = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("flag")) \
          .agg(F.count(F.lit(1)).alias("count"))
    return g.select(F.col("flag").cast("long").alias("flag"),
                    F.when(F.col("flag") == 1, F.lit(one_label)).otherwise(F.lit(other_label))
                    .alias("label"),
                    "count", rnd(pct(F.col("count"), total)).alias("pct"))


def quality_summary(df: DataFrame) -> DataFrame:
    """Total missing cells, duplicate rows, shape and a GOOD/REVIEW verdict."""
    miss = total_missing(df).scalar()
    dup = duplicate_count(df, None, "duplicate_rows").scalar()
    one = df.agg(F.count(F.lit(1)).alias("n_rows")) \
            .withColumns({"total_missing": miss, "duplicate_rows": dup})
    good = (F.col("total_missing") == 0) & (F.col("duplicate_rows") == 0)
    return one.select("total_missing", "duplicate_rows", "n_rows",
                      F.lit(len(df.columns)).cast("long").alias("n_columns"),
                      F.when(good, F.lit("GOOD")).otherwise(F.lit("NEEDS CLEANING")).alias("verdict"))


def decade_summary(df: DataFrame, decade_col: str = "decade") -> DataFrame:
    """Number of rows with a valid decade and the sorted distinct decades."""
    d = F.col(decade_col)
    return df.agg(F.count(d).alias("n_valid"),
                  F.array_join(F.sort_array(F.collect_set(d.cast("string"))), ",").alias("decades"))


# ---------------------------------------------------------------- V1, V3
def histogram(df: DataFrame, features: Sequence[str], bins: int = 50) -> DataFrame:
    """V1: equal-width histogram on [min, max] (last bin closed); a constant
    column spans [v-0.5, v+0.5].  Empty bins are present with count 0."""
    fs = present(df, features)
    lv = df.select(*[F.col(f).cast("double").alias(f) for f in fs]) \
           .unpivot([], fs, "feature", "value").where(F.col("value").isNotNull())
    rng = lv.groupBy("feature").agg(F.min("value").alias("mn"), F.max("value").alias("mx"))
    lo = F.when(F.col("mn") == F.col("mx"), F.col("mn") - 0.5).otherwise(F.col("mn"))
    hi = F.when(F.col("mn") == F.col("mx"), F.col("mx") + 0.5).otherwise(F.col("mx"))
    rng = rng.select("feature", lo.alias("lo"), hi.alias("hi"))
    b = F.least(F.floor((F.col("value") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))),
                F.lit(bins - 1)).cast("int")
    counted = lv.join(F.broadcast(rng), "feature") \
                .groupBy("feature", b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = rng.select("feature", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    w = (F.col("hi") - F.col("lo")) / bins
    return grid.join(counted, ["feature", "bin"], "left").select(
        "feature", "bin", rnd(F.col("lo") + F.col("bin") * w).alias("bin_lo"),
        rnd(F.col("lo") + (F.col("bin") + 1) * w).alias("bin_hi"),
        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))


def box_stats(df: DataFrame, features: Sequence[str], group_cols: Sequence[str] = (),
              approx: bool = False) -> DataFrame:
    """V3 / V5: quartiles, whiskers (most extreme values inside 1.5 IQR) and
    the number of fliers, per feature (and per group)."""
    fs = present(df, features)
    g = list(group_cols)
    q = feature_quantiles(df, fs, [0.25, 0.5, 0.75], group_cols=g, approx=approx)
    qs = q.groupBy(*g, "feature").agg(
        F.max(F.when(F.col("prob") == 0.25, F.col("q"))).alias("q1"),
        F.max(F.when(F.col("prob") == 0.5, F.col("q"))).alias("median"),
        F.max(F.when(F.col("prob") == 0.75, F.col("q"))).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    qs = qs.select(*g, "feature", "q1", "median", "q3",
                   (F.col("q1") - 1.5 * iqr).alias("_lo"), (F.col("q3") + 1.5 * iqr).alias("_hi"))
    lv = df.select(*[F.col(c) for c in g], *[F.col(f).cast("double").alias(f) for f in fs]) \
           .unpivot(g, fs, "feature", "value").where(F.col("value").isNotNull())
    # one row per (group, feature): broadcast only when there are no groups
    qj = F.broadcast(qs) if not g else qs
    j = lv.join(qj, [*g, "feature"])
    inside = (F.col("value") >= F.col("_lo")) & (F.col("value") <= F.col("_hi"))
    agg = j.groupBy(*g, "feature").agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(inside, F.col("value"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_hi"),
        F.sum(F.when(inside, 0).otherwise(1)).cast("long").alias("n_fliers"),
        F.count(F.lit(1)).alias("n"))
    return agg.select(*g, "feature", "n", *[rnd(F.col(c)).alias(c) for c in
                                            ("q1", "median", "q3", "whisker_lo", "whisker_hi")],
                      "n_fliers")
