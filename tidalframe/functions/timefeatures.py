"""Cyclic month and normalised year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def month_sin(month: Column) -> Column:
    return F.sin(2 * F.pi() * month / 12)


def month_cos(month: Column) -> Column:
    return F.cos(2 * F.pi() * month / 12)


def year_norm(df: DataFrame, year: str) -> Column:
    """(year - mean) / sample deviation of the table, as a scalar subquery read by every row."""
    stats = df.agg(F.struct(F.avg(year).alias("mean"), F.stddev_samp(year).alias("std")).alias("s")).scalar()
    return F.try_divide(F.col(year) - stats["mean"], stats["std"])
