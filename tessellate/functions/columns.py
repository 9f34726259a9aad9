"""Small column-expression helpers shared by every operator."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def present(df: DataFrame, cols: Iterable[str]) -> list[str]:
    """Columns of ``cols`` that exist in ``df`` (missing ones are skipped)."""
    have = set(df.columns)
    return [c for c in cols if c in have]


def missing(df: DataFrame, cols: Iterable[str]) -> list[str]:
    have = set(df.columns)
    return [c for c in cols if c not in have]


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num: Column, den: Column) -> Column:
    """Division that yields NULL for a zero divisor (ANSI mode would raise)."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def clean_zero(c: Column) -> Column:
    """Fold -0.0 into 0.0 so both signs of zero compare and hash alike."""
    return c + F.lit(0.0)


def rnd(c: Column, nd: int = 6) -> Column:
    """Round a double for output (and fold -0.0)."""
    return F.round(c.cast("double"), nd) + F.lit(0.0)


def pct(part: Column, whole: Column) -> Column:
    """100 * part / whole as double, NULL when whole is zero."""
    return F.try_divide(F.lit(100.0) * part.cast("double"), whole.cast("double"))


def nan_to_null(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Turn NaN into NULL in floating columns (pandas skips NaN like NULL)."""
    floats = {f.name for f in df.schema.fields
              if f.dataType.typeName() in ("double", "float")}
    targets = [c for c in (cols or df.columns) if c in floats]
    if not targets:
        return df
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double"))
                           for c in targets})


def numeric_fields(df: DataFrame) -> list[str]:
    numeric = ("byte", "short", "integer", "long", "float", "double", "decimal")
    return [f.name for f in df.schema.fields if f.dataType.typeName() in numeric]


def text_fields(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]


MAX_BROADCAST_ROWS = 10_000
MAX_BROADCAST_BYTES = 32 << 20


def bounded_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast a table whose size has been checked, in rows and in bytes.

    The check takes at most ``max_rows + 1`` rows; a table that fits is
    broadcast from them (computed once, nothing stays cached).  Beyond either
    bound the plain join lets AQE pick the strategy and split skewed keys."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows or sum(len(str(v)) for r in rows for v in r) > max_bytes:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
