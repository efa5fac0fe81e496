"""Class-aware and random splits by key hash.

Rows of a class are ordered by (hash of key, key). A split needs only the few keys at which
the order is cut, so the table is never sorted or shuffled as a whole: hashes are counted
per (class, hash range), the one range that holds each cut is numbered, and the rows are
assigned by comparing their (hash, key) with the cuts of their class.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidalframe.session import pin_small

HASH_SPAN = 1 << 32


def key_hash(key: Column) -> Column:
    """First 32 bits of the md5 of the key text: the same number in every engine."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint")


def random_split(df: DataFrame, key: str, test_percent: int = 20, seed: int | None = None, out: str = "split") -> DataFrame:
    """Unstratified hold-out: the share is met on average, the choice depends on the key only."""
    source = F.col(key) if seed is None else F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))
    is_test = F.pmod(key_hash(source), F.lit(100)) >= 100 - test_percent
    return df.withColumn(out, F.when(is_test, "test").otherwise("train"))


def hash_sample(df: DataFrame, key: str, most: int, rows: int | None = None) -> DataFrame:
    """About ``most`` rows by key hash, every class at its own share; all rows of a smaller table. ``rows`` is the count if known."""
    n = df.count() if rows is None else rows
    return df if n <= most else df.where(key_hash(F.col(key)) < HASH_SPAN * most // n)


def hash_order_cuts(df: DataFrame, key: str, cls: str, cuts: dict[str, Column], ranges: int = 4096) -> DataFrame:
    """(cls, cut...): the last (hash, key) of the first ``cut`` rows of every class.

    ``cuts`` gives each cut as a column expression of ``n``, the size of the class.
    A cut of zero rows is null.
    """
    span = HASH_SPAN // ranges
    keyed = df.select(F.col(cls).alias("cls"), key_hash(F.col(key)).alias("h"), F.col(key).alias("k"))
    keyed = keyed.withColumn("r", F.floor(F.col("h") / span))
    counts = keyed.groupBy("cls", "r").agg(F.count(F.lit(1)).alias("m"))
    by_class = Window.partitionBy("cls")
    sized = counts.select(
        "cls", "r", "m",
        F.sum("m").over(by_class.orderBy("r")).alias("upto"),
        F.sum("m").over(by_class).alias("n"),
    )
    targets = F.array(*[F.struct(F.lit(name).alias("cut"), e.cast("bigint").alias("target")) for name, e in cuts.items()])
    wanted = (
        sized.select("cls", "r", "m", "upto", F.inline(targets))
        .where((F.col("target") <= F.col("upto")) & (F.col("target") > F.col("upto") - F.col("m")))
        .select("cls", "r", "cut", (F.col("target") - F.col("upto") + F.col("m")).alias("place"))
    )
    in_range = Window.partitionBy("cls", "r", "cut").orderBy("h", "k")
    # One row per class and cut, joined with every row: a literal table when the classes are few, as classes are.
    targets_of = pin_small(wanted).withColumnsRenamed({"cls": "_cls", "r": "_r"})
    numbered = keyed.join(targets_of, F.col("cls").eqNullSafe(F.col("_cls")) & (F.col("r") == F.col("_r"))).withColumn("i", F.row_number().over(in_range))
    found = numbered.where(F.col("i") == F.col("place"))
    return found.groupBy("cls").agg(
        *[F.max(F.when(F.col("cut") == name, F.struct("h", "k"))).alias(name) for name in cuts]
    )


def _with_cuts(df: DataFrame, key: str, cls: str, cuts: dict[str, Column]) -> tuple[DataFrame, Column]:
    found = pin_small(hash_order_cuts(df, key, cls, cuts)).withColumnRenamed("cls", "_cls")
    place = F.struct(key_hash(F.col(key)).alias("h"), F.col(key).alias("k"))
    return df.join(found, F.col(cls).eqNullSafe(F.col("_cls")), "left").drop("_cls"), place


def stratified_split(
    df: DataFrame, key: str, cls: str, train: float = 0.8, val: float = 0.1, out: str = "split"
) -> DataFrame:
    """Per class: the first ``int(train * n)`` rows of the hash order train, the next ``int(val * n)`` validate, the rest test."""
    n = F.col("n")
    n_train = F.floor(n * F.lit(train))
    joined, place = _with_cuts(df, key, cls, {"_train": n_train, "_val": n_train + F.floor(n * F.lit(val))})
    split = F.when(place <= F.col("_train"), "train").when(place <= F.col("_val"), "val").otherwise("test")
    return joined.withColumn(out, split).drop("_train", "_val")


def stratified_folds(df: DataFrame, key: str, cls: str, folds: int = 3, out: str = "fold") -> DataFrame:
    """Consecutive folds of the hash order of every class; sizes differ by one at most, earlier folds are the larger."""
    n = F.col("n")
    names = [f"_cut{i}" for i in range(1, folds)]
    cuts = {name: i * F.floor(n / folds) + F.least(F.lit(i), n % folds) for i, name in enumerate(names, 1)}
    joined, place = _with_cuts(df, key, cls, cuts)
    beyond: Sequence[Column] = [F.when(F.coalesce(place <= F.col(c), F.lit(False)), 0).otherwise(1) for c in names]
    return joined.withColumn(out, sum(beyond, F.lit(0))).drop(*names)
