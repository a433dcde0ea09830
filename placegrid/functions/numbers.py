"""Numeric helpers that stay in code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def number(text: Column) -> Column:
    """The text as a double, NULL unless it is a plain decimal number (no nan, inf, suffixes or underscores)."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(NUMBER), trimmed.try_cast("double"))


def clamp(x: Column, low: float, high: float) -> Column:
    """x limited to [low, high]; NaN and NULL give NULL (least and greatest would skip NULL and treat NaN as largest)."""
    return F.when(x.isNotNull() & ~F.isnan(x), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def fenced(df: DataFrame) -> DataFrame:
    """The same rows; the optimizer moves no filter or expression across, where it would copy long expressions for each use."""
    return df.mapInArrow(lambda batches: batches, df.schema)


def kept_once(df: DataFrame, *names: str) -> DataFrame:
    """The same rows; the named columns are made as one value that the optimizer does not copy into filters and later uses.

    A condition on the partition's number, always true, is what keeps it from it (one on a random number would be optimized
    away): nothing leaves the JVM, other columns are pruned and filtered as ever.
    """
    rest = [c for c in df.columns if c not in names]
    whole = F.when(F.spark_partition_id() >= 0, F.struct(*names))
    return df.select(*rest, whole.alias("_once")).select(*[F.col(f"_once.{c}").alias(c) if c in names else F.col(c) for c in df.columns])


def human_duration(seconds: Column) -> Column:
    """Seconds below a minute, minutes below an hour, else hours; one decimal."""
    return F.when(seconds < 60, F.format_string("%.1fs", seconds)).when(seconds < 3600, F.format_string("%.1fm", seconds / 60)).otherwise(F.format_string("%.1fh", seconds / 3600))
