"""Environmental values for requests: grid cells, defaults and overrides."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fallback of every environmental feature.
DEFAULT_FEATURES = {
    "Distance_to_Shore": 10.0,
    "Turbidity": 2.5,
    "Cyclone_Frequency": 0.1,
    "Depth_m": 15.0,
    "ClimSST": 26.0,
    "Temperature_Kelvin": 300.0,
    "Temperature_Kelvin_Standard_Deviation": 1.5,
    "Windspeed": 5.0,
}

# The grid's cell size in degrees and the centre of its first cell.
CELL = 0.05
FIRST_LAT = -89.975
FIRST_LON = -179.975


def default_features(spark: SparkSession) -> DataFrame:
    """One row with the fallback of every feature."""
    return spark.range(1).select(*[F.lit(v).alias(name) for name, v in DEFAULT_FEATURES.items()])


def cell_index(degrees: Column, first: float) -> Column:
    """Index of the nearest cell centre along one axis."""
    return F.round((degrees - first) / CELL).cast("bigint")


def last_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key; further order columns break ties."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(newest.alias("_row")).select(*keys, "_row.*")


def grid_cells(grid: DataFrame, lat: str = "latitude", lon: str = "longitude", time: str = "time", day: str = "grid_date") -> DataFrame:
    """Rows of a grid file with the day and the cell they belong to, in place of time and coordinates."""
    placed = {day: F.to_date(time), "iy": cell_index(F.col(lat), FIRST_LAT), "ix": cell_index(F.col(lon), FIRST_LON)}
    return grid.withColumns(placed).drop(lat, lon, time)


def grid_lookup(
    points: DataFrame, grid: DataFrame, unit: str = "K", lat: str = "lat", lon: str = "lon", day: str = "grid_date",
    order: Sequence[str] = (),
) -> DataFrame:
    """Grid values of the nearest cell on the observation day, null where the grid has none.

    ``order`` names grid columns that decide which of several rows of a cell counts: the last one.
    ``unit="C"`` turns a Celsius ``sst`` into Kelvin.
    """
    cells = last_row(grid, [day, "iy", "ix"], order) if order else grid
    if unit == "C":
        cells = cells.withColumn("sst", F.col("sst") + 273.15)
    placed = points.withColumns({"iy": cell_index(F.col(lat), FIRST_LAT), "ix": cell_index(F.col(lon), FIRST_LON)})
    return placed.join(cells, [day, "iy", "ix"], "left")


def apply_overrides(
    requests: DataFrame, fetched: DataFrame, overrides: DataFrame, key: str,
    defaults: dict[str, float] = DEFAULT_FEATURES,
) -> DataFrame:
    """Per feature the user's value, else the fetched one, else the default."""

    def side(df: DataFrame, prefix: str) -> DataFrame:
        present = [c for c in defaults if c in df.columns]
        return df.select(key, *[F.col(c).alias(f"{prefix}{c}") for c in present])

    joined = reduce(
        lambda left, right: left.join(right, key, "left"), (side(fetched, "f#"), side(overrides, "o#")), requests
    )

    def value(name: str, fallback: float) -> Column:
        known = [F.col(f"`{p}{name}`") for p in ("o#", "f#") if f"{p}{name}" in joined.columns]
        return F.coalesce(*known, F.lit(fallback)).alias(name)

    return joined.select(*requests.columns, *[value(c, v) for c, v in defaults.items()])
