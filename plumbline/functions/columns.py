"""Column classes, decided once from the schema (no job)."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame, columns: Iterable[str] | None = None) -> list[str]:
    """Columns that take part in outlier and correlation measures."""
    wanted = set(df.columns if columns is None else columns)
    return [f.name for f in df.schema if f.name in wanted and isinstance(f.dataType, NUMERIC)]


def categorical_columns(df: DataFrame, columns: Iterable[str] | None = None) -> list[str]:
    """Every column that is not numeric, booleans and timestamps included."""
    wanted = set(df.columns if columns is None else columns)
    return [f.name for f in df.schema if f.name in wanted and not isinstance(f.dataType, NUMERIC)]


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing; Spark aggregates treat it as a value, so it becomes NULL on entry."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floats:
        return df
    return df.select(*[
        F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) if c in floats else F.col(f"`{c}`")
        for c in df.columns
    ])


def as_double(name: str) -> Column:
    return F.col(f"`{name}`").cast("double")
