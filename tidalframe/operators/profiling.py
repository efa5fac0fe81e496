"""Row and column counts, missingness, frequencies and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidalframe.operators.cleaning import number_columns, string_columns


def _is_missing(name: str) -> Column:
    return F.col(name).isNull().cast("int")


def _unpivot(one_row: DataFrame, names: Sequence[str], fields: dict[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows (column, field...) from aggregate columns called ``<name>#<suffix>``."""
    records = [
        F.struct(F.lit(n).alias("column"), *[F.col(f"`{n}#{suffix}`").alias(field) for field, suffix in fields.items()])
        for n in names
    ]
    return one_row.select(*keep, F.inline(F.array(*records)))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("bigint"))


def null_percent_total(df: DataFrame) -> DataFrame:
    """Missing cells of the whole table, in percent."""
    missing = sum((F.sum(_is_missing(c)) for c in df.columns), F.lit(0))
    cells = F.count(F.lit(1)) * len(df.columns)
    return df.agg(F.try_divide(missing * 100.0, cells).alias("null_percent"))


def null_summary(df: DataFrame) -> DataFrame:
    """Missing count and percent of every column, from one pass."""
    counts = df.agg(
        *[F.coalesce(F.sum(_is_missing(c)), F.lit(0)).alias(f"{c}#k") for c in df.columns],
        *[(F.avg(_is_missing(c)) * 100).alias(f"{c}#p") for c in df.columns],
    )
    return _unpivot(counts, df.columns, {"null_count": "k", "null_percent": "p"})


def columns_over(df: DataFrame, threshold: float) -> DataFrame:
    """Columns with a missing share above the threshold."""
    return null_summary(df).select("column", (F.col("null_percent") / 100).alias("missing_fraction")).where(
        F.col("missing_fraction") > threshold
    )


def missing_flags(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Add a 0/1 column ``<name>_missing`` for each numeric column."""
    return df.withColumns({f"{c}_missing": _is_missing(c) for c in (cols or number_columns(df))})


def missing_by_group(df: DataFrame, groups: Sequence[str], cols: Sequence[str] | None = None) -> DataFrame:
    """Missing share of every column within every value of every grouping column.

    All grouping columns are counted in one pass: each row is offered to its group of
    every grouping column and combined before the shuffle, so a group that holds most
    rows costs one record per task.
    """
    names = list(cols or number_columns(df))
    memberships = F.array(
        *[F.struct(F.lit(g).alias("group_column"), F.col(g).cast("string").alias("group_value")) for g in groups]
    )
    flags = [_is_missing(c).alias(f"{c}#f") for c in names]
    shares = (
        df.select(F.inline(memberships), *flags)
        .where(F.col("group_value").isNotNull())
        .groupBy("group_column", "group_value")
        .agg(F.count(F.lit(1)).alias("n_rows"), *[F.avg(f"`{c}#f`").alias(f"{c}#s") for c in names])
    )
    return _unpivot(shares, names, {"missing_share": "s"}, keep=("group_column", "group_value", "n_rows"))


def years_per_site(df: DataFrame, site: str, year: str, more_than: int = 1) -> DataFrame:
    """Sites observed in more than one year; rows without a site are none. Site and year pairs collapse before the shuffle."""
    pairs = df.where(F.col(year).isNotNull() & F.col(site).isNotNull()).select(site, year).distinct()
    return pairs.groupBy(site).agg(F.count(F.lit(1)).alias("n_years")).where(F.col("n_years") > more_than)


def multi_year_rows(df: DataFrame, site: str, year: str) -> DataFrame:
    """Rows of the sites observed in more than one year."""
    return df.join(years_per_site(df, site, year), site, "left_semi")


def site_year_distribution(df: DataFrame, site: str, year: str) -> DataFrame:
    """How many sites have 2, 3, ... years."""
    return years_per_site(df, site, year).groupBy("n_years").agg(F.count(F.lit(1)).alias("n_sites"))


def distinct_counts(df: DataFrame, cols: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Distinct known values of every text column."""
    names = list(cols or string_columns(df))
    if approximate:
        one_row = df.agg(*[F.approx_count_distinct(c).alias(f"{c}#d") for c in names])
        return _unpivot(one_row, names, {"n_distinct": "d"})
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in names])
    return (
        df.select(F.inline(entries))
        .distinct()
        .groupBy("column")
        .agg(F.count("value").alias("n_distinct"))
    )


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Frequency of every known value."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width bins from the smallest to the largest value, the last bin closed on the right.

    A column with one value only gets the half-unit range on each side that plotting libraries use.
    """
    spark = df.sparkSession
    limits = df.agg(F.struct(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi")).alias("r"))
    r = limits.select(
        F.when(
            F.col("r.lo") == F.col("r.hi"),
            F.struct((F.col("r.lo") - 0.5).alias("lo"), (F.col("r.hi") + 0.5).alias("hi")),
        ).otherwise(F.col("r")).alias("r")
    ).scalar()
    place = F.floor((F.col(col) - r["lo"]) / (r["hi"] - r["lo"]) * bins)
    filled = (
        df.where(F.col(col).isNotNull())
        .select(F.least(place, F.lit(bins - 1)).cast("bigint").alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    width = (r["hi"] - r["lo"]) / bins
    return (
        spark.range(bins).withColumnRenamed("id", "bin")
        .join(filled, "bin", "left")
        .select(
            "bin",
            (r["lo"] + F.col("bin") * width).alias("bin_start"),
            (r["lo"] + (F.col("bin") + 1) * width).alias("bin_end"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
    )


def healthy_share(df: DataFrame, target: str = "percent_bleaching", *by: str) -> DataFrame:
    """Percent of rows at zero, over all rows and over rows with a target."""
    healthy = F.coalesce(F.col(target) == 0, F.lit(False)).cast("int")
    return df.groupBy(*by).agg(
        (F.avg(healthy) * 100).alias("percent_of_rows"),
        (F.avg(F.when(F.col(target).isNotNull(), healthy)) * 100).alias("percent_of_known"),
    )


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Share of every class in percent."""
    counts = value_counts(df, label)
    return counts.withColumn("percent", F.col("n") * 100.0 / counts.agg(F.sum("n")).scalar())


def class_counts(df: DataFrame, col: str, classes: Sequence[str] | DataFrame) -> DataFrame:
    """Items of every class of a list or of a table of different classes, zero for a class with none."""
    if isinstance(classes, DataFrame):
        spine = classes.select(col)
    else:
        spine = df.sparkSession.createDataFrame([(c,) for c in classes], schema=df.select(col).schema)
    counted = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return spine.join(counted, col, "left").select(col, F.coalesce("n", F.lit(0)).alias("n"))


def balance_report(df: DataFrame, target: str = "percent_bleaching", bins: int = 30) -> DataFrame:
    """Is the target skewed: its histogram, the share at zero and the class shares, as (part, item, value)."""
    from tidalframe.functions.labels import bleach_class

    def rows(part: str, source: DataFrame, item: Column, value: Column) -> DataFrame:
        return source.select(F.lit(part).alias("part"), item.cast("string").alias("item"), value.cast("double").alias("value"))

    shares = healthy_share(df, target)
    classes = class_balance(df.select(bleach_class(F.col(target)).alias("class")), "class")
    return (
        rows("histogram", histogram(df, target, bins), F.col("bin"), F.col("n"))
        .unionByName(rows("healthy_percent", shares, F.lit("all rows"), F.col("percent_of_rows")))
        .unionByName(rows("healthy_percent", shares, F.lit("known target"), F.col("percent_of_known")))
        .unionByName(rows("class_percent", classes, F.col("class"), F.col("percent")))
    )
