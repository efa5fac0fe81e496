"""Cleaning, typing, column and row selection of observation tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidalframe.functions.missing import looks_numeric, nan_to_null, null_if_token, to_numeric


def columns_of_type(df: DataFrame, *kinds: type) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def string_columns(df: DataFrame) -> list[str]:
    return columns_of_type(df, T.StringType)


def number_columns(df: DataFrame) -> list[str]:
    return columns_of_type(df, T.NumericType)


def require_columns(df: DataFrame, cols: Sequence[str]) -> None:
    absent = [c for c in cols if c not in df.columns]
    if absent:
        raise ValueError(f"columns not in the table: {absent}")


def clean_missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing tokens in text columns and NaN in floating columns become null."""
    texts = set(string_columns(df) if cols is None else cols)
    floats = set(columns_of_type(df, T.DoubleType, T.FloatType)) - texts

    def cleaned(name: str) -> Column:
        if name in texts:
            return null_if_token(F.col(name)).alias(name)
        return nan_to_null(F.col(name)).alias(name) if name in floats else F.col(name)

    return df.select(*[cleaned(c) for c in df.columns])


def numeric_text_columns(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    """Text columns whose every known value is a number. One pass over the table."""
    texts = list(cols) if cols is not None else string_columns(df)
    if not texts:
        return []
    flags = df.agg(*[F.bool_and(looks_numeric(F.col(c))).alias(c) for c in texts]).first()
    return [c for c in texts if flags[c] is not False]


def to_numeric_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Given columns as numbers, value by value."""
    return df.withColumns({c: to_numeric(F.col(c)) for c in cols}) if cols else df


def infer_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Type text columns as numbers where every known value is one; the rest stay text."""
    return to_numeric_columns(df, numeric_text_columns(df, cols))


def select_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    require_columns(df, cols)
    return df.select(*cols)


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop columns; a name that is not there is an error."""
    require_columns(df, cols)
    return df.drop(*cols)


def sparse_columns(df: DataFrame, max_missing: float = 0.30) -> list[str]:
    """Columns with a missing share strictly above the limit. One pass over the table."""
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if shares[c] is not None and shares[c] > max_missing]


def drop_sparse_columns(df: DataFrame, max_missing: float = 0.30) -> DataFrame:
    return df.drop(*sparse_columns(df, max_missing))


def drop_missing_target(df: DataFrame, target: str = "percent_bleaching") -> DataFrame:
    return df.na.drop(subset=[target])


def region_filter(
    df: DataFrame, country: str, text: str, country_col: str = "country_name", region_col: str = "ecoregion_name",
    pattern: bool = False,
) -> DataFrame:
    """Rows of one country whose region contains the text, any case; ``pattern`` takes a regular expression."""
    region = F.col(region_col)
    found = region.rlike(f"(?i){text}") if pattern else F.lower(region).contains(text.lower())
    return df.where((F.col(country_col) == country) & F.coalesce(found, F.lit(False)))


def healthy_sites(df: DataFrame, target: str = "percent_bleaching") -> DataFrame:
    return df.where(F.col(target) == 0)


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Whole-row dedup; nulls equal nulls, NaN equals NaN."""
    return df.dropDuplicates()


def union_rows(first: DataFrame, second: DataFrame) -> DataFrame:
    """Append by column name; a column only one side has is null on the other."""
    return first.unionByName(second, allowMissingColumns=True)


def sort_desc(df: DataFrame, by: str, *tiebreak: str) -> DataFrame:
    return df.orderBy(F.desc(by), *tiebreak)


def head(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """First n rows of a stated order."""
    return df.orderBy(*order).limit(n)


def combine_columns(left: DataFrame, right: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Put two column sets of the same rows side by side, matched by a row key."""
    return left.join(right, key, "inner")
