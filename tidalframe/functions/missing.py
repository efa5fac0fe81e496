"""Missing-value tokens, numeric text and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text that means "no value" in an observation file.
# The survey's own markers, then the usual CSV null spellings.
NULL_TOKENS = (
    "nd", "ND", "Nd", "nD",
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# What counts as a number in text.
NUMBER_PATTERN = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"

# Date layouts tried in order.
DATE_LAYOUTS = ("yyyy-MM-dd", "M/d/yyyy", "d-MMM-yy", "yyyy-MM-dd HH:mm:ss")


def null_if_token(c: Column) -> Column:
    """Text that is one of the missing tokens becomes null."""
    return F.when(~c.isin(*NULL_TOKENS), c)


def nan_to_null(c: Column) -> Column:
    """NaN of a floating column becomes null."""
    return F.when(~F.isnan(c), c)


def looks_numeric(c: Column) -> Column:
    """Guard before a cast: Spark alone would read ``1d`` as a number."""
    return c.rlike(NUMBER_PATTERN)


def to_numeric(c: Column) -> Column:
    """Number per value, null when the text is not one."""
    return F.when(looks_numeric(c), F.trim(c).try_cast("double"))


def parse_date(c: Column, layouts: tuple[str, ...] = DATE_LAYOUTS) -> Column:
    """Date of a text column in any of the layouts, else null. Two-digit years are 1969 to 2068."""

    def one(layout: str) -> Column:
        date = F.try_to_timestamp(c, F.lit(layout)).cast("date")
        if "yyyy" in layout or "yy" not in layout:
            return date
        return F.when(F.year(date) > 2068, F.add_months(date, -1200)).otherwise(date)

    return F.coalesce(*[one(layout) for layout in layouts])


def obs_year(c: Column) -> Column:
    """Year of an observation date given as text."""
    return F.year(parse_date(c))
