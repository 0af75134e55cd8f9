"""Small helpers on columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row: filters and columns above read it, and are not moved below it with a copy of it."""
    kept = [c for c in df.columns if c != name]
    return df.withColumn(name, value).select(*kept, F.explode(F.array(name)).alias(name))


def half_up(value: Column) -> Column:
    """The nearest whole number, halves upwards."""
    return F.floor(value + 0.5).cast("long")


def clamped_share(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))
