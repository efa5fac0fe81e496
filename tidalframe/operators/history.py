"""Training curves: two phases as one, and where early stopping ends a run.

Runs are cut into blocks of consecutive epochs: windows work inside a block and small
per-block totals carry over, so one very long run still spreads over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65_536


def number_rows(df: DataFrame, by: Sequence[str], block: Column, order: Sequence[str | Column], out: str) -> DataFrame:
    """Consecutive numbers from 1 within ``by``. ``block`` must not fall along the order; rows of a block are numbered together."""
    keys = list(by)
    blocked = df.withColumn("_block", block)
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocked.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    offsets = offsets.select(*keys, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*order))
    numbered = _join_null_safe(blocked.withColumn("_i", inside), offsets, [*keys, "_block"])
    return numbered.withColumn(out, F.col("_offset") + F.col("_i")).drop("_offset", "_i", "_block")


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which null keys meet null keys."""
    right = right.withColumnsRenamed({k: f"_right_{i}" for i, k in enumerate(keys)})
    same = [left[k].eqNullSafe(right[f"_right_{i}"]) for i, k in enumerate(keys)]
    return left.join(right, same).drop(*[f"_right_{i}" for i in range(len(keys))])


def concat_history(first: DataFrame, second: DataFrame, run: str = "run_id", block: int = BLOCK) -> DataFrame:
    """Append the epochs of phase 2 to those of phase 1 and number them from 1 per run."""
    both = first.withColumn("phase", F.lit(1)).unionByName(second.withColumn("phase", F.lit(2)), allowMissingColumns=True)
    both = both.withColumnRenamed("epoch", "phase_epoch")
    blocks = F.struct("phase", F.floor(F.col("phase_epoch") / block).alias("b"))
    return number_rows(both, [run], blocks, ["phase_epoch"], "epoch")


def early_stop(
    history: DataFrame, patience: int = 10, metric: str = "val_accuracy", run: str = "run_id", block: int = BLOCK
) -> DataFrame:
    """Per run the epoch with the best value so far when training ends, and the epoch it ends at.

    Training ends at the first epoch that is ``patience`` after the last improvement, else at the last epoch.
    A null or NaN value is no improvement; rows with a null run are a run of their own.
    """
    value = F.when(~F.isnan(F.col(metric).cast("double")), F.col(metric)).alias(metric)
    blocked = history.select(run, "epoch", value, F.floor(F.col("epoch") / block).alias("_block"))
    before_block = Window.partitionBy(run).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # Highest value first, earliest epoch among equals: its epoch is the last improvement.
    peak = F.max(F.struct(F.col(metric).alias("m"), (-F.col("epoch")).alias("neg")))
    carried = (
        blocked.groupBy(run, "_block").agg(peak.alias("peak"))
        .select(run, "_block", F.max("peak").over(before_block).alias("carry"))
    )
    so_far = Window.partitionBy(run, "_block").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    inside = F.max(F.struct(F.col(metric).alias("m"), (-F.col("epoch")).alias("neg"))).over(so_far)
    tracked = (
        _join_null_safe(blocked.withColumn("_inside", inside), carried, [run, "_block"])
        .select(run, "epoch", (-F.greatest("_inside", "carry")["neg"]).alias("best_epoch"))
    )
    out_of_patience = F.col("epoch") - F.col("best_epoch") >= patience
    ended = tracked.groupBy(run).agg(
        F.min(F.when(out_of_patience, F.struct("epoch", "best_epoch"))).alias("hit"),
        F.max(F.struct("epoch", "best_epoch")).alias("end"),
    )
    stop = F.coalesce("hit", "end")
    return ended.select(
        run, stop["best_epoch"].alias("best_epoch"), stop["epoch"].alias("stopped_epoch"),
        F.col("hit").isNotNull().alias("stopped_early"),
    )
