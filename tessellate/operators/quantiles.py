"""Exact, linearly interpolated quantiles by rank selection in counting passes.

A quantile of n values lies between the values of two ranks.  Each pass counts
the values of every group in bins, a monotone function of the value computed in
the plan: first by sign and logarithm, then by equal parts of the bins that hold
a wanted rank.  A pass leaves, for each wanted rank, one bin with its least and
largest value and the rank within it; a bin of one value is the answer.  Bins
narrow some 4,000-fold a pass, so a handful of passes end at a single double
whatever the data; groups and features share the passes, and every size takes
the same path.

What crosses a shuffle are counts by group and bin (combined map-side), so a
group or value that holds a third of the rows costs one row a task.  What is
joined to the rows is one row per group, the bins still open; it is broadcast
only if its checked size allows.  Each pass's open bins are checkpointed.

Same result as pandas ``quantile`` / DuckDB ``quantile_cont`` / Spark
``percentile``.  ``approx=True`` switches to ``percentile_approx`` (mergeable
sketch, one pass) for callers that accept bounded rank error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bounded_broadcast
from ..session import cut_lineage

BINS = 4096
LOG_BINS = 64  # per power of two, in the first pass

_V = "_qv"


def _first_bin(v: str) -> str:
    """SQL of a monotone bin of any double: by sign and logarithm, NaN last."""
    size = f"cast(floor(log2(abs({v})) * {LOG_BINS}) as int) + 100000"
    return (f"CASE WHEN isnan({v}) THEN 900000 WHEN {v} = 0 THEN 0 WHEN abs({v}) = double('Infinity') THEN cast(signum({v}) as int) * 800000 "
            f"ELSE cast(signum({v}) as int) * ({size}) END")


def _inner_bin(v: str, low: str, high: str) -> str:
    """SQL of a monotone bin of a value between two bounds (halved, so that the
    difference of finite bounds is finite); the bounds fall into different bins."""
    part = f"floor(({v} / 2 - {low} / 2) / ({high} / 2 - {low} / 2) * {BINS - 1})"
    return f"CASE WHEN {v} >= {high} THEN {BINS - 1} WHEN {v} <= {low} THEN 0 ELSE least(greatest(cast({part} as int), 0), {BINS - 2}) END"


def grouped_quantiles(df: DataFrame, value: str, probs: Sequence[float],
                      group_cols: Sequence[str] = (), approx: bool = False,
                      accuracy: int = 10000) -> DataFrame:
    """Long table (*group_cols, prob, q) of exact linear-interpolated quantiles.

    NULL values are ignored; groups without values produce no rows.  Null groups
    are groups like any other.  NaN counts as the largest value."""
    names = list(group_cols)
    probs = [float(p) for p in probs]
    if approx:
        base = df.select(*names, F.col(value).cast("double").alias(_V)).where(F.col(_V).isNotNull())
        qs = base.groupBy(*names).agg(F.percentile_approx(_V, probs, accuracy).alias("_qs"))
        return qs.select(*names, F.posexplode("_qs").alias("_i", "q")) \
                 .select(*names, F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("_i") + 1).alias("prob"), "q")
    g = [f"_g{i}" for i in range(len(names))] or ["_g"]
    keys = [F.col(c).alias(k) for c, k in zip(names, g)] or [F.lit(0).alias("_g")]
    base = df.select(*keys, (F.col(value).cast("double") + F.lit(0.0)).alias(_V)).where(F.col(_V).isNotNull())

    counted = _counts(base.withColumn("_bin", F.expr(_first_bin(_V))), g, [])
    n = F.sum("n").over(Window.partitionBy(*g))
    ranks = F.explode(F.array(*(F.struct(F.lit(p).alias("prob"), F.lit(up).alias("up")) for p in probs for up in (0, 1))))
    at = F.col("n_all") - 1
    wanted = (counted.select(*g, n.alias("n_all")).distinct().select(*g, "n_all", ranks.alias("r"))
              .select(*g, "n_all", "r.prob", "r.up",
                      F.least(F.floor(at * F.col("r.prob")) + F.col("r.up"), at).cast("long").alias("rank")))
    open_ = cut_lineage(_chosen(counted, wanted, g, []))
    done = open_.where("low <=> high")
    while True:
        still = open_.where("NOT (low <=> high)")
        bins = bounded_broadcast(still.groupBy(*g).agg(F.collect_set(F.struct("low", "high")).alias("_bins")))
        if still.isEmpty():
            break
        near = base.join(bins, [base[k].eqNullSafe(bins[k]) for k in g]).select(
            *(base[k] for k in g), _V, F.explode(F.filter("_bins", lambda b: (b.low <= F.col(_V)) & (F.col(_V) <= b.high))).alias("_in"))
        near = near.select(*g, _V, F.col("_in.low").alias("low"), F.col("_in.high").alias("high"))
        counted = _counts(near.withColumn("_bin", F.expr(_inner_bin(_V, "low", "high"))), g, ["low", "high"])
        open_ = cut_lineage(_chosen(counted, still, g, ["low", "high"]))
        done = done.union(open_.where("low <=> high"))
    frac = F.max((F.col("n_all") - 1) * F.col("prob") - F.floor((F.col("n_all") - 1) * F.col("prob"))).alias("frac")
    ends = [F.max(F.when(F.col("up") == up, F.col("low"))).alias(name) for up, name in ((0, "a"), (1, "b"))]
    q = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("frac"))
    return done.groupBy(*g, "prob").agg(frac, *ends).select(*(F.col(k).alias(c) for k, c in zip(g, names)), "prob", q.alias("q"))


def _counts(rows: DataFrame, g: list[str], within: list[str]) -> DataFrame:
    """Per group, outer bin and bin: values, the least and the largest, and the
    values of the outer bin's bins before."""
    counted = rows.groupBy(*g, *within, "_bin").agg(F.count(F.lit(1)).alias("n"), F.min(_V).alias("new_low"), F.max(_V).alias("new_high"))
    before = Window.partitionBy(*g, *within).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))


def _chosen(counted: DataFrame, wanted: DataFrame, g: list[str], within: list[str]) -> DataFrame:
    """The wanted ranks with the bin that holds each: its bounds, and the rank in it."""
    w = wanted.select(*(F.col(c).alias(f"w_{c}") for c in wanted.columns))
    same = [F.col(k).eqNullSafe(F.col(f"w_{k}")) for k in (*g, *within)]
    held = (F.col("before") <= F.col("w_rank")) & (F.col("w_rank") < F.col("before") + F.col("n"))
    on = held
    for s in same:
        on = on & s
    return counted.join(w, on).select(*g, F.col("w_n_all").alias("n_all"), F.col("w_prob").alias("prob"), F.col("w_up").alias("up"),
                                      (F.col("w_rank") - F.col("before")).alias("rank"),
                                      F.col("new_low").alias("low"), F.col("new_high").alias("high"))


def long_values(df: DataFrame, features: Sequence[str], name: str = "feature",
                value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Unpivot feature columns into (keep..., feature, value) as doubles."""
    cols = [F.col(f).cast("double").alias(f) for f in features]
    wide = df.select(*[F.col(k) for k in keep], *cols)
    return wide.unpivot(list(keep), list(features), name, value)


def feature_quantiles(df: DataFrame, features: Sequence[str], probs: Sequence[float],
                      group_cols: Sequence[str] = (), approx: bool = False) -> DataFrame:
    """(*group_cols, feature, prob, q) for many features in the same passes."""
    return grouped_quantiles(long_values(df, features, keep=group_cols), "value", probs, [*group_cols, "feature"], approx=approx)
