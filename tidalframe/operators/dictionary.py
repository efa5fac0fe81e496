"""Dictionaries of category values: numbered tables of any size, never a list on the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidalframe.session import default_buckets, scratch_path


# A column of so few values meets the rows where they are, whatever other columns its dictionary has.
FEW_VALUES = 10_000


def category_key(value: Column) -> Column:
    """A category as a text that is never null: ``=`` before a value, ``~`` for null, which sorts behind all values."""
    return F.when(value.isNull(), "~").otherwise(F.concat(F.lit("="), value.cast("string")))


def number_categories(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, key, index): the distinct values of each column in alphabetical order from 0, null last when there is one.

    Values are made distinct before the shuffle, dealt out by ranges and counted by range, so neither a busy value nor a
    column of many values is one task's work. The table is written to the shared folder.
    """
    spark = df.sparkSession
    entries = F.array(*[F.struct(F.lit(c).alias("column"), category_key(F.col(c)).alias("key")) for c in cols])
    distinct = df.select(F.inline(entries)).distinct()
    path = scratch_path(spark, "categories")
    placed = distinct.repartitionByRange(default_buckets(spark), "column", "key").sortWithinPartitions("column", "key")
    placed.withColumn("at", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.parquet(path).withColumn("range", F.shiftright("at", 33))
    counts = placed.groupBy("column", "range").agg(F.count("*").alias("n"), F.min("at").alias("least"))
    before = F.sum("n").over(Window.partitionBy("column").orderBy("range")) - F.col("n")
    shifts = counts.select("column", "range", (before - F.col("least")).alias("shift"))
    path = scratch_path(spark, "dictionary")
    numbered = placed.join(shifts, ["column", "range"]).select("column", "key", (F.col("at") + F.col("shift")).alias("index"))
    numbered.write.partitionBy("column").parquet(path)
    return spark.read.schema("key STRING, index BIGINT, column STRING").parquet(path).select("column", "key", "index")


def category_widths(dictionary: DataFrame, cols: Sequence[str]) -> list[int]:
    """Number of values of each column."""
    found = {r["column"]: r["n"] for r in dictionary.groupBy("column").agg(F.count("*").alias("n")).collect()}
    return [found.get(c, 0) for c in cols]


def add_category_index(df: DataFrame, dictionary: DataFrame, col: str, out: str, width: int | None = None) -> DataFrame:
    """``df`` with the index of a column's value, null for a value the dictionary does not have.

    Spark plans with the size of the whole dictionary, so a column of few values beside one of many needs its ``width``, the
    number of its values, to stay clear of a shuffle of all rows. A large column meets them in one whose busy values Spark can split.
    """
    side = dictionary.where(F.col("column") == col).select(F.col("key").alias(f"_key_{out}"), F.col("index").alias(out))
    if width is not None and width <= FEW_VALUES:
        side = F.broadcast(side)
    return df.join(side, category_key(F.col(col)) == F.col(f"_key_{out}"), "left").drop(f"_key_{out}")
