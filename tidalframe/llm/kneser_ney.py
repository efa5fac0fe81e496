"""Interpolated modified Kneser-Ney models over characters, estimated with joins and groupings.

A gram of up to four UTF-16 units is one whole number, 16 bits a unit, the last unit lowest. Cutting off the first unit
is a mask, cutting off the last one a shift, so every statistic is a grouping of the table of distinct grams.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalframe.llm.common import materialise

START = 2  # stands before the first unit of a text


def units(text: str, order: int) -> np.ndarray:
    """UTF-16 units of a text behind ``order - 1`` start marks."""
    return np.concatenate((np.full(order - 1, START, np.uint16), np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)))


def grams(codes: np.ndarray, order: int) -> np.ndarray:
    """The gram that ends at each unit from place ``order - 1`` on."""
    n = len(codes) - order + 1
    out = np.zeros(max(n, 0), np.int64)
    for i in range(order):
        out = (out << 16) | codes[i : i + n]
    return out


def text_grams(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams of all texts one after the other, and where each text begins among them (and the end)."""
    codes = [units(t, order) for t in texts]
    bounds = np.cumsum([0] + [len(c) - order + 1 for c in codes])
    if not texts:
        return np.zeros(0, np.int64), bounds
    found = grams(np.concatenate(codes), order)
    # grams that reach from one text into the next are left out
    ends = np.cumsum([len(c) for c in codes])
    keep = np.ones(len(found), bool)
    for e in ends[:-1]:
        keep[e - order + 1 : e] = False
    return found[keep], bounds


def _levels(counts: DataFrame, order: int, name: str) -> dict[int, DataFrame]:
    """Counts of each order: those given for the highest, below it how many different units stand before a gram."""
    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        shorter = levels[k + 1].select("model", F.col("gram").bitwiseAND((1 << 16 * k) - 1).alias("gram"))
        levels[k] = materialise(shorter.groupBy("model", "gram").agg(F.count("*").alias("n")), f"{name}-{k}")
    return levels


def _discounts(level: DataFrame) -> DataFrame:
    """Modified Kneser-Ney discounts of each model from its counts of counts; plain guesses where those are zero."""
    n = [F.count(F.when(F.col("n") == i, 1)).cast("double") for i in (1, 2, 3, 4)]
    seen = level.groupBy("model").agg(*[c.alias(f"n{i}") for i, c in enumerate(n, 1)])
    y = F.coalesce(F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2")), F.lit(0.5))

    def amount(i: int, guess: float):
        value = F.try_divide(F.lit(float(i + 1)) * y * F.col(f"n{i + 1}"), F.col(f"n{i}"))
        return F.least(F.greatest(F.coalesce(F.lit(float(i)) - value, F.lit(guess)), F.lit(0.05)), F.lit(i - 0.05))

    return seen.select("model", amount(1, 0.5).alias("d1"), amount(2, 1.0).alias("d2"), amount(3, 1.5).alias("d3"))


def estimate(counts: DataFrame, order: int, name: str) -> tuple[dict[int, DataFrame], dict[int, DataFrame]]:
    """From distinct (model, gram, n) of one order: by order k, tables (model, gram, p) and (model, context, gamma).

    p is the interpolated probability of the last unit after the others. An unseen gram has gamma of its context times
    the probability of the gram without its first unit; an unseen context has gamma 1; an unseen unit has
    gamma of the empty context divided by 2^16.
    """
    levels, probabilities, gammas = _levels(counts, order, name), {}, {}
    for k in range(1, order + 1):
        level = levels[k].withColumn("context", F.shiftright("gram", 16))
        level = level.join(_discounts(levels[k]), "model")
        less = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        level = level.withColumn("less", less)
        gamma = level.groupBy("model", "context").agg((F.sum("less") / F.sum("n")).alias("gamma"), F.sum("n").alias("total"))
        gamma = materialise(gamma, f"{name}-gamma-{k}")
        gammas[k] = gamma.select("model", "context", "gamma")
        level = level.join(gamma, ["model", "context"])
        own = (F.col("n") - F.col("less")) / F.col("total")
        if k == 1:
            p = level.select("model", "gram", (own + F.col("gamma") / (1 << 16)).alias("p"))
        else:
            lower = probabilities[k - 1].select("model", F.col("gram").alias("shorter"), F.col("p").alias("lower"))
            level = level.withColumn("shorter", F.col("gram").bitwiseAND((1 << 16 * (k - 1)) - 1))
            p = level.join(lower, ["model", "shorter"]).select("model", "gram", (own + F.col("gamma") * F.col("lower")).alias("p"))
        probabilities[k] = materialise(p, f"{name}-p-{k}")
    return probabilities, gammas


def score_grams(wanted: DataFrame, probabilities: dict[int, DataFrame], gammas: dict[int, DataFrame], order: int) -> DataFrame:
    """Distinct (model, gram) with the natural log of the probability of each, backing off through the orders by joins."""
    out = wanted.withColumns({"factor": F.lit(1.0), "p": F.lit(None).cast("double")})
    for k in range(order, 0, -1):
        known = probabilities[k].select(F.col("model").alias("_m"), F.col("gram").alias("_g"), F.col("p").alias("_p"))
        weights = gammas[k].select(F.col("model").alias("_n"), F.col("context").alias("_c"), F.col("gamma").alias("_w"))
        short = F.col("gram").bitwiseAND((1 << 16 * k) - 1)
        out = out.join(known, (F.col("model") == F.col("_m")) & (short == F.col("_g")), "left")
        out = out.join(weights, (F.col("model") == F.col("_n")) & (F.shiftright(short, 16) == F.col("_c")), "left")
        p = F.coalesce("p", F.col("factor") * F.col("_p"))
        out = out.select("model", "gram", F.when(p.isNull(), F.col("factor") * F.coalesce("_w", F.lit(1.0))).otherwise(F.col("factor")).alias("factor"), p.alias("p"))
    return out.select("model", "gram", F.log(F.coalesce("p", F.col("factor") / (1 << 16))).alias("logp"))
