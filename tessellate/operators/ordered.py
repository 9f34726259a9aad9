"""Places of rows in a global order, without a single sorting task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bounded_broadcast
from ..session import cut_lineage

ROW_BITS = 33  # of monotonically_increasing_id


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """``df`` with ``out``, its place (from 0) in the order of the named columns.

    The rows are range-sorted and written once; a row's place is its place in
    its partition plus the rows of the partitions before, one row per partition.
    Rows equal in ``order`` stay in one partition."""
    run = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order)
                      .withColumn("_seq", F.monotonically_increasing_id())
                      .withColumn("_part", F.shiftright("_seq", ROW_BITS)))
    spans = run.groupBy(F.col("_part").alias("_span")).agg(F.min("_seq").alias("_first"), F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))
    spans = bounded_broadcast(spans.withColumn("_before", F.coalesce(before, F.lit(0))))
    return (run.join(spans, F.col("_part") == F.col("_span"))
            .select(*df.columns, (F.col("_before") + F.col("_seq") - F.col("_first")).alias(out)))
