"""Order statistics without a one-task sort.

All exact ranks, quantiles, areas under the curve and rank correlations come from one
building block, ``cumulative_counts``: how many rows lie below every distinct value.

* Equal values are counted together first, with map-side combine, so a value held by a
  third of all rows is one record per task.
* Distinct values fall into ranges with literal bounds. Bounds decide only how even the
  work is, never the result.
* Inside a range a window runs over sorted distinct values; totals of the ranges before
  it are added. No window lacks a partition key that grows with the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from urllib.parse import quote

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidalframe.session import SMALL_ROWS, default_buckets, kept, pin_small, scratch_path


def column_outline(
    df: DataFrame, cols: Sequence[str], buckets: int | None = None
) -> tuple[dict[str, list[float]], list[str], dict[str, int]]:
    """Range limits of every column from quantile sketches, the columns that have nulls, and about how many values each has. One pass."""
    k = buckets or default_buckets(df.sparkSession)
    probabilities = [i / k for i in range(1, k)]
    sketches = [F.percentile_approx(F.col(c).cast("double"), probabilities, 4 * k).alias(f"q{i}") for i, c in enumerate(cols)]
    gaps = [F.coalesce(F.bool_or(F.col(c).isNull()), F.lit(False)).alias(f"g{i}") for i, c in enumerate(cols)]
    sizes = [F.approx_count_distinct(F.col(c)).alias(f"d{i}") for i, c in enumerate(cols)]
    row = df.agg(*sketches, *gaps, *sizes).first()
    bounds = {c: sorted(set(row[f"q{i}"] or [])) for i, c in enumerate(cols)}
    return bounds, [c for i, c in enumerate(cols) if row[f"g{i}"]], {c: row[f"d{i}"] for i, c in enumerate(cols)}


def value_bounds(df: DataFrame, cols: Sequence[str], buckets: int | None = None) -> dict[str, list[float]]:
    return column_outline(df, cols, buckets)[0]


def range_bucket(v: Column, bounds: Sequence[float]) -> Column:
    """Number of bounds below v, by binary search over a literal array."""
    n = len(bounds)
    if n == 0:
        return F.lit(0)
    limits = F.lit(np.array(bounds, dtype="float64"))
    steps = [1 << s for s in reversed(range(n.bit_length()))]
    return F.aggregate(
        F.lit(np.array(steps, dtype="int32")),
        F.lit(0),
        lambda at, step: F.when(
            (at + step <= n) & (F.get(limits, F.least(at + step, F.lit(n)) - 1) < v), at + step
        ).otherwise(at),
    )


def melt_values(df: DataFrame, cols: Sequence[str], carry: Mapping[str, Column] | None = None) -> DataFrame:
    """One row (stat, v) per known value of every column, with carried expressions."""
    entries = F.array(*[F.struct(F.lit(c).alias("stat"), F.col(c).cast("double").alias("v")) for c in cols])
    extra = [e.alias(name) for name, e in (carry or {}).items()]
    return df.select(F.inline(entries), *extra).where(F.col("v").isNotNull())


def cumulative_counts(
    long: DataFrame, bounds: Mapping[str, Sequence[float]], weights: Mapping[str, Column] | None = None
) -> DataFrame:
    """Per stat and distinct v: for each weight ``w`` its sum ``w``, ``w_before``, its sum over smaller values, and ``w_total``."""
    sums = dict(weights or {"n": F.count(F.lit(1))})
    counts = long.groupBy("stat", "v").agg(*[e.alias(w) for w, e in sums.items()])
    bucket = reduce(
        lambda rest, item: F.when(F.col("stat") == item[0], range_bucket(F.col("v"), item[1])).otherwise(rest),
        bounds.items(),
        F.lit(0),
    )
    # Never null, so that no null filter is pushed below one use of the counts only: both uses share one shuffle.
    counts = counts.withColumn("bucket", F.coalesce(bucket, F.lit(0)))
    earlier = Window.partitionBy("stat").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        counts.groupBy("stat", "bucket")
        .agg(*[F.sum(w).alias(w) for w in sums])
        .select(
            "stat", "bucket",
            *[F.coalesce(F.sum(w).over(earlier), F.lit(0)).alias(f"{w}_offset") for w in sums],
            *[F.sum(w).over(Window.partitionBy("stat")).alias(f"{w}_total") for w in sums],
        )
    )
    within = Window.partitionBy("stat", "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    running = counts.select(
        "stat", "bucket", "v", *sums, *[F.coalesce(F.sum(w).over(within), F.lit(0)).alias(f"{w}_inside") for w in sums]
    )
    return running.join(offsets, ["stat", "bucket"]).select(
        "stat", "v", *sums,
        *[(F.col(f"{w}_offset") + F.col(f"{w}_inside")).alias(f"{w}_before") for w in sums],
        *[f"{w}_total" for w in sums],
    )


def ranked_values(df: DataFrame, cols: Sequence[str], buckets: int | None = None) -> DataFrame:
    """(stat, v, n, n_before, n_total) of several columns in one job."""
    return cumulative_counts(melt_values(df, cols), value_bounds(df, cols, buckets))


def average_rank(df: DataFrame, col: str, out: str = "rank", buckets: int | None = None) -> DataFrame:
    """Rank over the whole table, 1 for the smallest, ties share their mean; null stays null."""
    bounds, _, sizes = column_outline(df, [col], buckets)
    ranks = cumulative_counts(melt_values(df, [col]), bounds).select(
        F.col("v").alias("_v"), (F.col("n_before") + (F.col("n") + 1) / 2).alias(out)
    )
    # Few values: the rank table is checked and broadcast, and the rows stay where they are.
    if sizes[col] <= SMALL_ROWS // 2:
        ranks = pin_small(ranks)
    return df.join(ranks, F.col(col).cast("double") == F.col("_v"), "left").drop("_v")


# Relative rank error of the sketches that exact percentiles start from.
SKETCH_ERROR = 1e-4


# How far around a percentile a sketch is read: four errors, and more where the last of them is less than two rows.
_REACHES = (4 * SKETCH_ERROR, 0.003, 0.03, 0.3, 1.0)

Sketch = tuple[int, Sequence[float] | None]


def percentile_sketch(col: str, probabilities: Sequence[float]) -> Column:
    """Struct (n, edges): the count of known values, and per percentile the values at its sides, by reach."""
    v = F.col(col).cast("double")
    sides = [min(max(q + side, 0.0), 1.0) for q in probabilities for reach in _REACHES for side in (-reach, reach)]
    return F.struct(F.count(v).alias("n"), F.percentile_approx(v, sides, round(1 / SKETCH_ERROR)).alias("edges"))


def _intervals(sketch: Sketch) -> list[tuple[float, float]]:
    """Disjoint ascending intervals that hold the rows next to each percentile."""
    n, edges = sketch
    if not n:
        return []
    wide = next(i for i, reach in enumerate(_REACHES) if reach >= 3 * SKETCH_ERROR + 2 / n or reach == 1.0)
    merged: list[tuple[float, float]] = []
    for low, high in sorted((edges[i], edges[i + 1]) for i in range(2 * wide, len(edges), 2 * len(_REACHES))):
        if merged and low <= merged[-1][1]:
            low, high = merged[-1][0], max(high, merged.pop()[1])
        merged.append((low, high))
    return merged


def percentiles_between(
    df: DataFrame, sketches: Mapping[str, Sketch], probabilities: Sequence[float], buckets: int | None = None
) -> DataFrame:
    """(stat, n, p0, p1, ...) by one pass that counts every value but keeps apart only those between the sketched ones.

    A value outside all intervals counts as the nearest end of one, so a few values in ten thousand are grouped and ordered.
    Should a sketch have been too far off, its percentile lies among counted-only values and the query fails rather than err.
    """
    k = buckets or default_buckets(df.sparkSession)
    intervals = {c: _intervals(s) for c, s in sketches.items()}
    entries = []
    for c, parts in intervals.items():
        v = F.col(c).cast("double")
        near, below = v, None
        if parts:
            near = F.when(v < parts[0][0], F.lit(parts[0][0]))
            for low, high in parts:
                if below is not None:
                    near = near.when(v < low, F.lit(below))
                near, below = near.when(v <= high, v), high
            near = near.when(v.isNotNull(), F.lit(below))
        entries.append(F.struct(F.lit(c).alias("stat"), near.alias("v"), (v < near).cast("int").alias("under"), (v > near).cast("int").alias("over")))
    long = df.select(F.inline(F.array(*entries))).where(F.col("v").isNotNull())
    bounds = {c: [b for low, high in parts for b in np.linspace(low, high, max(2, k // len(parts)), endpoint=False).tolist()] if parts else [] for c, parts in intervals.items()}
    bounds = {c: sorted({b for b in found if np.isfinite(b)}) for c, found in bounds.items()}
    # all three sums are used where they are counted and where they are accumulated, so both share one shuffle
    weights = {"own": F.sum(1 - F.col("under") - F.col("over")), "under": F.sum("under"), "over": F.sum("over")}
    whole = lambda suffix: F.col(f"own{suffix}") + F.col(f"under{suffix}") + F.col(f"over{suffix}")
    placed = cumulative_counts(long, bounds, weights).withColumns({"total": whole("_total"), "first": whole("_before") + F.col("under")})

    def at(position: Column) -> Column:
        found = F.max(F.when((F.col("first") <= position) & (position < F.col("first") + F.col("own")), F.col("v")))
        return F.coalesce(found, F.raise_error(F.lit("a quantile sketch was off by more than its error")).cast("double"))

    picks = []
    for i, q in enumerate(probabilities):
        h = F.lit(float(q)) * (F.col("total") - 1)
        picks += [
            at(F.floor(h)).alias(f"lo{i}"),
            at(F.least(F.floor(h) + 1, F.col("total") - 1)).alias(f"hi{i}"),
            F.max(h - F.floor(h)).alias(f"part{i}"),
        ]
    found = placed.groupBy("stat").agg(F.max("total").alias("n"), *picks)
    values = [
        (F.col(f"lo{i}") + F.when(F.col(f"part{i}") == 0, 0.0).otherwise((F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"part{i}"))).alias(f"p{i}")
        for i in range(len(probabilities))
    ]
    return found.select("stat", "n", *values)


def exact_percentiles(
    df: DataFrame, cols: Sequence[str], probabilities: Sequence[float], buckets: int | None = None
) -> DataFrame:
    """(stat, n, p0, p1, ...): linear-interpolated percentiles of every column, in two passes: sketch, then refine."""
    row = df.agg(*[percentile_sketch(c, probabilities).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return percentiles_between(df, {c: row[i] for i, c in enumerate(cols)}, probabilities, buckets)


def median_iqr(df: DataFrame, cols: Sequence[str], buckets: int | None = None) -> DataFrame:
    """(column, q1, median, q3) of every column; a column with no value has nulls."""
    found = exact_percentiles(df, cols, (0.25, 0.5, 0.75), buckets)
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return names.join(found.withColumnRenamed("stat", "column"), "column", "left").select(
        "column", F.col("p0").alias("q1"), F.col("p1").alias("median"), F.col("p2").alias("q3")
    )


def describe_exact(df: DataFrame, cols: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles of every column."""
    quarters = (0.25, 0.5, 0.75)
    parts = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        parts += [
            F.struct(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")).alias(f"m{i}"),
            percentile_sketch(c, quarters).alias(f"s{i}"),
        ]
    row = df.agg(*parts).first()  # one short row
    quartiles = percentiles_between(df, {c: row[f"s{i}"] for i, c in enumerate(cols)}, quarters, buckets)
    quartiles = quartiles.select(F.col("stat").alias("column"), F.col("p0").alias("p25"), F.col("p1").alias("p50"), F.col("p2").alias("p75"))
    moments = df.sparkSession.createDataFrame(
        [(c, *row[f"m{i}"]) for i, c in enumerate(cols)], "column string, count bigint, mean double, std double, min double, max double"
    )
    return moments.join(quartiles, "column", "left").select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def roc_auc(df: DataFrame, label: str, score: str, buckets: int | None = None) -> DataFrame:
    """Exact area under the ROC curve; tied scores count half, null when a class is absent."""
    known = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    long = melt_values(known, [score], {"y": F.col(label).cast("int")})
    weights = {"pos": F.sum("y").cast("decimal(28,0)"), "neg": F.sum(1 - F.col("y")).cast("decimal(28,0)")}
    steps = cumulative_counts(long, value_bounds(known, [score], buckets), weights)
    won = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2).cast("double"))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return steps.agg(F.try_divide(won, pairs).alias("roc_auc"))


def safe_corr(x: Column, y: Column) -> Column:
    """Correlation, null when a side does not vary. Both sides have to be null on the same rows."""
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y)))


def spearman_matrix(df: DataFrame, cols: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Absolute rank correlation of every pair over the rows where both are known: (col_a, col_b, rho).

    A column is ranked once per other column that has nulls, all in one pass: counts of a
    value restricted to the rows where that other column is known ride along as extra weights
    of the same sort. Ranks then come back to the rows by value, one equi join per column,
    and all pairs are measured by one aggregate.
    """
    names = list(cols)
    base = kept(df.select(*[F.col(c).cast("double").alias(c) for c in names]), "measures")  # three passes read it
    bounds, with_nulls, sizes = column_outline(base, names, buckets)
    slot = {c: i + 1 for i, c in enumerate(with_nulls)}
    known = {f"known{i}": F.col(c).isNotNull().cast("int") for c, i in slot.items()}
    weights = {"w0": F.count(F.lit(1)), **{f"w{i}": F.sum(f"known{i}") for i in slot.values()}}
    path = scratch_path(df.sparkSession, "ranks")
    ranked = cumulative_counts(melt_values(base, names, known), bounds, weights)
    ranked.select(
        "stat", "v", F.array(*[F.col(f"{w}_before") + (F.col(w) + 1) / 2 for w in weights]).alias("ranks")
    ).write.partitionBy("stat").parquet(path)
    rows = base
    # A column of many values meets its ranks in a shuffle: it comes first, while rows are the plain measures yet.
    for c in sorted(names, key=lambda c: -sizes[c]):
        if not bounds[c]:
            rows = rows.withColumn(f"r#{c}", F.lit(None).cast("array<double>"))
            continue
        # One folder per column: the planner sees the size of this rank table alone and broadcasts only a small one.
        side = df.sparkSession.read.schema("v DOUBLE, ranks ARRAY<DOUBLE>").parquet(f"{path}/stat={quote(c)}")
        side = side.select(F.col("v").alias(f"v#{c}"), F.col("ranks").alias(f"r#{c}"))
        rows = rows.join(side, F.col(c) == F.col(f"`v#{c}`"), "left").drop(f"v#{c}")

    def rank_of(c: str, other: str) -> Column:
        return F.when(F.col(other).isNotNull(), F.get(F.col(f"`r#{c}`"), F.lit(slot.get(other, 0))))

    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    measured = rows.agg(
        *[F.abs(safe_corr(rank_of(a, b), rank_of(b, a))).alias(f"{i}#rho") for i, (a, b) in enumerate(pairs)]
    )
    records = []
    for i, (a, b) in enumerate(pairs):
        for x, y in {(a, b), (b, a)}:
            records.append(F.struct(F.lit(x).alias("col_a"), F.lit(y).alias("col_b"), F.col(f"`{i}#rho`").alias("rho")))
    return measured.select(F.inline(F.array(*records)))


def high_corr_pairs(matrix: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Pairs above the threshold, each once."""
    return matrix.where((F.col("col_a") < F.col("col_b")) & (F.col("rho") > threshold))


def expand_copies(ranked: DataFrame, chunk: int = 100_000) -> DataFrame:
    """(v, n_total, position) for every copy of every value, positions from 1. Large groups split over tasks."""
    parts = ranked.select(
        "v", "n", "n_before", "n_total", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("n") - 1), F.lit(chunk).cast("bigint"))).alias("first")
    )
    spread = parts.repartition("v", "first")
    last = F.least(F.col("first") + chunk, F.col("n")) - 1
    start, end = F.col("n_before") + F.col("first") + 1, F.col("n_before") + last + 1
    return spread.select("v", "n_total", F.explode(F.sequence(start, end)).alias("position"))


def normal_qq(df: DataFrame, col: str, buckets: int | None = None) -> DataFrame:
    """Points of a normal quantile plot: (position, theoretical, observed), medians of order statistics by Filliben."""
    from tidalframe.functions.normal import inverse_normal

    points = expand_copies(ranked_values(df, [col], buckets))
    i, total = F.col("position"), F.col("n_total")
    last_place = F.pow(F.lit(0.5), 1 / total)
    place = F.when(i == total, last_place).when(i == 1, 1 - last_place).otherwise((i - 0.3175) / (total + 0.365))
    return points.select("position", inverse_normal(place).alias("theoretical"), F.col("v").alias("observed"))


def normal_qq_fit(points: DataFrame) -> DataFrame:
    """Least-squares line and correlation of the plot."""
    y, x = F.col("observed"), F.col("theoretical")
    return points.agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), safe_corr(x, y).alias("r")
    )
