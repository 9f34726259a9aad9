"""Places of rows in a global order, without a single sorting task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bounded_broadcast
from .common import written

ROW_BITS = 33  # of monotonically_increasing_id


def same(left: DataFrame, right: DataFrame, columns: list[str]):
    """Null-safe equality of the named columns, as a join condition."""
    on = left[columns[0]].eqNullSafe(right[columns[0]])
    for c in columns[1:]:
        on = on & left[c].eqNullSafe(right[c])
    return on


def numbered(df: DataFrame, group: list[str], order: list, name: str) -> DataFrame:
    """``df`` with ``pos``, the place of a row within its group (from 0), and
    ``n``, the rows of the group.

    ``order`` (names or sort columns) must tell rows apart, so that a range
    sort can split any group and any tie.  The sorted rows are written once; a
    row's place is its place in its partition plus the group's rows in the
    partitions before, a table of one row per partition and group in it."""
    keys = [*(F.col(c).asc_nulls_first() for c in group),
            *(F.col(c).asc_nulls_first() if isinstance(c, str) else c for c in order)]
    run = written(df.repartitionByRange(*keys).sortWithinPartitions(*keys)
                  .withColumn("seq_", F.monotonically_increasing_id())
                  .withColumn("part_", F.shiftright("seq_", ROW_BITS)), name)
    by_group = Window.partitionBy(*group)
    spans = (run.groupBy("part_", *group).agg(F.min("seq_").alias("first_"), F.count("*").alias("rows_"))
             .withColumn("before_", F.coalesce(F.sum("rows_").over(
                 by_group.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
             .withColumn("n", F.sum("rows_").over(by_group)))
    spans = bounded_broadcast(spans)
    return (run.join(spans, same(run, spans, ["part_", *group]))
            .select(*(run[c] for c in df.columns), (F.col("before_") + F.col("seq_") - F.col("first_")).alias("pos"), "n"))
