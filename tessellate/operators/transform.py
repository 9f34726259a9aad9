"""Feature transforms.

Fitted parameters are a one-row DataFrame; they are applied through a scalar
subquery column (evaluated once, shipped to every task as a literal), so the
transform is a narrow projection over the data: no join, no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import present, rnd
from .quantiles import feature_quantiles

_P = "_params"


def fit_standard(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row: ``{f}__mean`` and population ``{f}__std`` per feature."""
    fs = present(df, features)
    aggs = []
    for f in fs:
        x = F.col(f).cast("double")
        aggs += [F.avg(x).alias(f"{f}__mean"), F.stddev_pop(x).alias(f"{f}__std")]
    return df.agg(*aggs)


def fit_minmax(df: DataFrame, features: Sequence[str]) -> DataFrame:
    fs = present(df, features)
    aggs = []
    for f in fs:
        x = F.col(f).cast("double")
        aggs += [F.min(x).alias(f"{f}__min"), F.max(x).alias(f"{f}__max")]
    return df.agg(*aggs)


def _as_scalar(params: DataFrame) -> Column:
    return params.select(F.struct(*[F.col(c) for c in params.columns]).alias("p")).scalar()


def apply_standard(df: DataFrame, features: Sequence[str], params: DataFrame) -> DataFrame:
    fs = present(df, features)
    d = df.withColumn(_P, _as_scalar(params))
    out = {}
    for f in fs:
        mu, sd = F.col(f"{_P}.{f}__mean"), F.col(f"{_P}.{f}__std")
        out[f] = F.when(sd == 0, F.lit(0.0)).otherwise((F.col(f).cast("double") - mu) / sd)
    return d.withColumns(out).drop(_P)


def apply_minmax(df: DataFrame, features: Sequence[str], params: DataFrame) -> DataFrame:
    fs = present(df, features)
    d = df.withColumn(_P, _as_scalar(params))
    out = {}
    for f in fs:
        lo, hi = F.col(f"{_P}.{f}__min"), F.col(f"{_P}.{f}__max")
        out[f] = F.when(hi == lo, F.lit(0.0)).otherwise((F.col(f).cast("double") - lo) / (hi - lo))
    return d.withColumns(out).drop(_P)


def scale(df: DataFrame, features: Sequence[str], method: str = "standard"
          ) -> tuple[DataFrame, DataFrame]:
    """Z-score (population std, constant column -> 0) or min-max
    (constant column -> 0).  Returns (scaled frame, one-row parameters)."""
    if method == "standard":
        params = fit_standard(df, features)
        return apply_standard(df, features, params), params
    if method == "minmax":
        params = fit_minmax(df, features)
        return apply_minmax(df, features, params), params
    raise ValueError(f"Unknown scaling method: '{method}'. Use 'standard' or 'minmax'.")


def inverse_scale(df: DataFrame, features: Sequence[str], params: DataFrame,
                  method: str = "standard") -> DataFrame:
    """Undo :func:`scale` with its fitted parameters (why they are returned)."""
    fs = present(df, features)
    d = df.withColumn(_P, _as_scalar(params))
    out = {}
    for f in fs:
        if method == "standard":
            out[f] = F.col(f) * F.col(f"{_P}.{f}__std") + F.col(f"{_P}.{f}__mean")
        elif method == "minmax":
            lo, hi = F.col(f"{_P}.{f}__min"), F.col(f"{_P}.{f}__max")
            out[f] = F.col(f) * (hi - lo) + lo
        else:
            raise ValueError(f"Unknown scaling method: '{method}'.")
    return d.withColumns(out).drop(_P)


def log_transform(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """ln(1 + x) in place; report (column, max_before, max_after).

    x <= -1 gives NULL (Spark) where NumPy gives -inf / NaN."""
    if column not in df.columns:
        return df, df.sparkSession.createDataFrame([], "column string, max_before double, max_after double")
    out = df.withColumn(column, F.log1p(F.col(column).cast("double")))
    report = df.agg(F.max(F.col(column).cast("double")).alias("m")).select(
        F.lit(column).alias("column"), rnd(F.col("m")).alias("max_before"),
        rnd(F.log1p(F.col("m"))).alias("max_after"))
    return out, report


def winsorize(df: DataFrame, columns: Sequence[str], upper_percentile: float = 0.95,
              approx: bool = False) -> tuple[DataFrame, DataFrame]:
    """P10: clip columns at their upper percentile (exact, interpolated).

    Returns (clipped frame, report (column, threshold, n_clipped)).  NULL stays
    NULL (``when``, not ``least``, which would skip the NULL)."""
    cs = present(df, columns)
    if not cs:
        return df, df.sparkSession.createDataFrame([], "column string, threshold double, n_clipped long")
    q = {r["feature"]: r["q"] for r in
         feature_quantiles(df, cs, [upper_percentile], approx=approx).collect()}  # one per column
    t = {c: F.lit(q.get(c)).cast("double") for c in cs}
    clipped = df.withColumns({c: F.when(F.col(c) > t[c], t[c]).otherwise(F.col(c).cast("double"))
                              for c in cs})
    counts = df.agg(*[F.coalesce(F.sum(F.when(F.col(c) > t[c], 1).otherwise(0)), F.lit(0))
                      .cast("long").alias(c) for c in cs])
    report = counts.unpivot([], cs, "column", "n_clipped").withColumn(
        "threshold", rnd(F.create_map(*[x for c in cs for x in (F.lit(c), t[c])])[F.col("column")]))
    return clipped, report.select("column", "threshold", "n_clipped")
