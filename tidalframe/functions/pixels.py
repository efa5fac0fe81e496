"""Pixel arrays: channels are interleaved, value ``i`` belongs to channel ``i % 3``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHANNELS = 3

# Channel means the pretrained network input is centred by, in B, G, R order.
BGR_MEANS = (103.939, 116.779, 123.68)


def per_channel(values: list[Column], i: Column) -> Column:
    """The entry of ``values`` for the channel of position ``i``."""
    return F.when(i % CHANNELS == 0, values[0]).when(i % CHANNELS == 1, values[1]).otherwise(values[2])


def channel(px: Column, c: int) -> Column:
    """Values of one channel."""
    return F.filter(px, lambda _, i: i % CHANNELS == c)


def rescale_255(px: Column) -> Column:
    """0..255 to 0..1."""
    return F.transform(px, lambda x: x / 255)


def imagenet_center(px: Column) -> Column:
    """Subtract the channel means from B, G, R data."""
    return F.transform(px, lambda x, i: x - per_channel([F.lit(m) for m in BGR_MEANS], i))


def rgb_to_bgr(px: Column) -> Column:
    """Swap the first and third channel; an incomplete last pixel keeps its order."""
    whole = F.size(px) - F.size(px) % CHANNELS

    def moved(x: Column, i: Column) -> Column:
        return F.when((i < whole) & (i % CHANNELS == 0), F.get(px, i + 2)).when(
            (i < whole) & (i % CHANNELS == 2), F.get(px, i - 2)
        ).otherwise(x)

    return F.transform(px, moved)


def to_byte_range(x: Column) -> Column:
    """Clip to 0..255 and cut the fraction off."""
    return F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(255.0))).cast("double")


def array_mean(values: Column) -> Column:
    """Mean of a numeric array, null when empty."""
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    return F.try_divide(total, F.size(values))


def sorted_percentile(ordered: Column, q: float) -> Column:
    """Linear-interpolated percentile of an ascending array."""
    h = (F.size(ordered) - 1) * F.lit(q)
    lo = F.floor(h).cast("int")
    low = F.get(ordered, lo)
    high = F.coalesce(F.get(ordered, lo + 1), low)
    return low + (high - low) * (h - lo)


def map_channels(px: Column, stats: list[Column], fn: Callable[[Column, Column], Column]) -> Column:
    """Apply ``fn(value, channel statistic)`` to every value."""
    return F.transform(px, lambda x, i: fn(x, per_channel(stats, i)))
