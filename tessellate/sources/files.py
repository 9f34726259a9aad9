"""Readers and writers.

* CSV input is read with an explicit schema (no inference pass) and the
  missing-value tokens pandas recognises are turned into NULL before numeric
  casts, so a string column holding "NA" or "null" behaves like in the
  reference.  Convert CSV to parquet once: CSV cannot push filters down and a
  multi-line CSV file is read by one task.
* Results are written as parquet by default (optionally partitioned by the
  cluster column, so a later filter on the cluster prunes files), CSV when
  asked; JSON metrics carry no infinities (JSON has none) - they become NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.columns import nan_to_null

# The strings pandas' CSV reader treats as missing by default.
NA_TOKENS: tuple[str, ...] = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)


def as_string_schema(schema: StructType) -> StructType:
    return StructType([StructField(f.name, StringType(), True) for f in schema.fields])


def normalise_missing(df: DataFrame, tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """String cells equal to a missing token -> NULL."""
    strings = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    toks = list(tokens)
    return df.withColumns({c: F.when(F.col(c).isin(toks), F.lit(None)).otherwise(F.col(c))
                           for c in strings})


def read_table(spark: SparkSession, path: str, schema: StructType | None = None,
               fmt: str | None = None, multiline: bool = False) -> DataFrame:
    """Read a table.  CSV: header, quoted fields, every column read as
    text, missing tokens -> NULL, then cast to ``schema`` (try_cast: a bad
    number becomes NULL, as pandas' coercion does); NaN -> NULL."""
    kind = fmt or ("csv" if path.rstrip("/").endswith(".csv") else "parquet")
    if kind == "parquet":
        df = spark.read.parquet(path)
        return nan_to_null(df) if schema is None else nan_to_null(
            df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]))
    if kind != "csv":
        return spark.read.format(kind).load(path)
    if schema is None:
        raise ValueError("CSV input needs an explicit schema (no inference pass at scale)")
    raw = (spark.read.option("header", True).option("escape", '"').option("multiLine", multiline)
           .schema(as_string_schema(schema)).csv(path))
    raw = normalise_missing(raw)
    typed = raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name)
                         if f.dataType.typeName() != "string" else F.col(f.name)
                         for f in schema.fields])
    return nan_to_null(typed)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def read_first_existing(spark: SparkSession, paths: Sequence[str], schema: StructType | None = None,
                        fill: dict | None = None) -> DataFrame | None:
    """Read the first path that exists; fill NULLs (``{'family': 'Other'}``)."""
    for p in paths:
        if path_exists(spark, p):
            df = read_table(spark, p, schema)
            return df.na.fill(fill) if fill else df
    return None


def write_table(df: DataFrame, path: str, fmt: str = "parquet",
                partition_by: Sequence[str] | None = None, mode: str = "overwrite") -> str:
    """Write a whole result (header row for CSV, no index)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)
    return path


def export_filtered(df: DataFrame, condition, path: str, columns: Sequence[str] | None = None,
                    fmt: str = "csv") -> str:
    """Write the rows that satisfy ``condition`` (all of them, the chosen
    columns), as a serving page offers its filtered table for download."""
    rows = df.where(condition)
    return write_table(rows.select(*columns) if columns else rows, path, fmt)


def write_metrics(df: DataFrame, path: str) -> str:
    """Metrics as JSON lines; +/-inf and NaN become NULL."""
    fixed = df.withColumns({f.name: F.when(F.col(f.name).isin(float("inf"), float("-inf")) |
                                           F.isnan(F.col(f.name)), F.lit(None))
                            .otherwise(F.col(f.name))
                            for f in df.schema.fields if f.dataType.typeName() in ("double", "float")})
    return write_table(fixed.coalesce(1), path, "json")


def save_results(tables: dict[str, DataFrame], base: str) -> dict[str, str]:
    """One parquet table per result, keyed by row id."""
    return {name: write_table(df, f"{base.rstrip('/')}/{name}") for name, df in tables.items()}


def load_or_recompute(spark: SparkSession, path: str, expected_rows: int,
                      recompute: Callable[[], DataFrame]) -> DataFrame:
    """Reuse a stored table if it exists and has the expected row count,
    else recompute it."""
    if path_exists(spark, path):
        df = spark.read.parquet(path)
        if df.count() == expected_rows:
            return df
    return recompute()
