"""Colour and contrast work on pixel arrays.

An image is one row with interleaved channel values, so array expressions finish it inside
its task: no shuffle, whatever the number of images. Local contrast works on long rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidalframe.functions.pixels import (
    CHANNELS, array_mean, channel, map_channels, sorted_percentile, to_byte_range,
)
from tidalframe.session import pin_small

TINY = 1e-8


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it inside ``body``, also within array lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _stats(px: Column, of: Callable[[Column], Column]) -> Column:
    return F.array(*[of(channel(px, c)) for c in range(CHANNELS)])


def channel_means(df: DataFrame, px: str = "px") -> DataFrame:
    """Add ``mean_0..2``."""
    return df.withColumns({f"mean_{c}": array_mean(channel(F.col(px), c)) for c in range(CHANNELS)})


def gray_world_pixels(px: Column) -> Column:
    """Scale each channel to the mean of the channel means; bytes out."""

    def balanced(means: Column) -> Column:
        target = (means[0] + means[1] + means[2]) / 3
        gains = F.transform(means, lambda m: target / (m + TINY))
        return bind(gains, lambda g: map_channels(px, [g[0], g[1], g[2]], lambda x, gain: to_byte_range(x * gain)))

    return bind(_stats(px, array_mean), balanced)


def stretch_pixels(px: Column, low: float = 0.01, high: float = 0.99) -> Column:
    """Spread each channel between its low and high percentile over 0..255; bytes out."""

    def limits(values: Column) -> Column:
        return bind(F.sort_array(values), lambda s: F.struct(sorted_percentile(s, low).alias("lo"), sorted_percentile(s, high).alias("hi")))

    def stretched(stats: Column) -> Column:
        return map_channels(
            px, [stats[0], stats[1], stats[2]],
            lambda x, r: to_byte_range((x - r["lo"]) * 255.0 / (r["hi"] - r["lo"] + TINY)),
        )

    return bind(_stats(px, limits), stretched)


def gray_world(df: DataFrame, px: str = "px") -> DataFrame:
    return df.withColumn(px, gray_world_pixels(F.col(px)))


def percentile_stretch(df: DataFrame, px: str = "px", low: float = 0.01, high: float = 0.99) -> DataFrame:
    return df.withColumn(px, stretch_pixels(F.col(px), low, high))


def gray_world_then_stretch(df: DataFrame, px: str = "px") -> DataFrame:
    return df.withColumn(px, bind(gray_world_pixels(F.col(px)), lambda balanced: stretch_pixels(balanced)))


def equalize_by_group(
    df: DataFrame, value: str, group: Sequence[str], bins: int = 256, clip: float = 2.0, out: str = "equalized",
    few_groups: bool = False,
) -> DataFrame:
    """Histogram equalisation of integer values 0..bins-1 within each group, bin counts clipped.

    A bin keeps at most ``clip * size / bins`` values (one at least); what is cut off is spread evenly over all bins.
    Values are counted per (group, bin) before any shuffle, and a group's table has ``bins`` rows at most.
    Rows with a null group are a group of their own; a null value stays null.
    ``few_groups`` checks that all tables together are small and then broadcasts them instead of shuffling the rows.
    """
    keys = list(group)
    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    sized = hist.withColumn("_size", F.sum("_n").over(whole))
    limit = F.greatest(F.floor(F.lit(clip) * F.col("_size") / bins), F.lit(1))
    clipped = sized.withColumn("_kept", F.least(F.col("_n"), limit))
    excess = F.col("_size") - F.sum("_kept").over(whole)
    below = F.sum("_kept").over(upto) + excess * (F.col(value) + 1) / bins
    table = clipped.select(*[F.col(c).alias(f"_at_{c}") for c in [*keys, value]], F.round((bins - 1) * below / F.col("_size")).alias(out))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in keys], F.col(value) == F.col(f"_at_{value}"))
    return df.join(pin_small(table) if few_groups else table, same, "left").drop(*[f"_at_{c}" for c in [*keys, value]])


def tile_of(pixel: Column, width: int, height: int, tiles: int = 8) -> Column:
    """Number of the tile a pixel lies in, tiles counted row by row."""
    row, col = F.floor(pixel / width), pixel % width
    return F.floor(row * tiles / height) * tiles + F.floor(col * tiles / width)


def local_contrast(
    df: DataFrame, width: int, height: int, tiles: int = 8, clip: float = 2.0, key: str = "image_id", px: str = "px"
) -> DataFrame:
    """Gray world, then equalised intensity per tile: (key, pixel, tile, intensity, equalized).

    Intensity is the mean of a pixel's channels.
    """
    pixels = F.transform(
        F.sequence(F.lit(0), F.ceil(F.size("_g") / CHANNELS).cast("int") - 1),
        lambda p: F.floor(array_mean(F.slice("_g", p * CHANNELS + 1, CHANNELS))).cast("int"),
    )
    balanced = df.select(key, gray_world_pixels(F.col(px)).alias("_g"))
    long = balanced.select(key, F.posexplode(pixels).alias("pixel", "intensity"))
    tiled = long.withColumn("tile", tile_of(F.col("pixel"), width, height, tiles).cast("int"))
    return equalize_by_group(tiled, "intensity", [key, "tile"], 256, clip).select(key, "pixel", "tile", "intensity", "equalized")


def draw(seed: int, *parts: Column) -> Column:
    """Repeatable number in [0, 1) from a seed and keys."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def flip_rows(px: Column, width: int) -> Column:
    """Mirror every full image row; values after the last full row stay."""
    per_row = width * CHANNELS
    whole = F.size(px) - F.size(px) % per_row

    def source(x: Column, i: Column) -> Column:
        in_row = i % per_row
        mirrored = i - in_row + per_row - CHANNELS - (in_row - in_row % CHANNELS) + in_row % CHANNELS
        return F.when(i < whole, F.get(px, mirrored)).otherwise(x)

    return F.transform(px, source)


def change_contrast(px: Column, factor: Column) -> Column:
    """Move values away from or towards their channel mean, within 0..255."""
    return bind(
        F.struct(_stats(px, array_mean).alias("m"), factor.alias("f")),
        lambda s: map_channels(
            px, [s["m"][0], s["m"][1], s["m"][2]],
            lambda x, m: F.least(F.greatest((x - m) * s["f"] + m, F.lit(0.0)), F.lit(255.0)),
        ),
    )


def augment(df: DataFrame, copies: int, width: int, seed: int = 42, contrast: float = 0.1, key: str = "image_id", px: str = "px") -> DataFrame:
    """Seeded extra copies of every image, numbered from 1: half of them mirrored, contrast changed by up to the given share."""
    each = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    flipped = draw(seed, F.lit("flip"), F.col(key), F.col("copy")) < 0.5
    factor = 1 + (draw(seed, F.lit("contrast"), F.col(key), F.col("copy")) * 2 - 1) * contrast
    turned = F.when(flipped, flip_rows(F.col(px), width)).otherwise(F.col(px))
    return each.withColumn(px, bind(turned, lambda p: change_contrast(p, factor)))
