"""Exact classification metrics from a label, a prediction and a score column."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidalframe.operators.ordering import roc_auc

# How far probabilities are kept from 0 and 1 in the log loss.
CLIP = 1e-7


def pair_truth_pred(truth: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """Labels and predictions of the same item on one row."""
    return truth.join(pred, key, "inner")


def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "pred", classes: Sequence[int] = (0, 1)) -> DataFrame:
    """Counts of true and predicted class, zero cells included."""
    cells = [(t, p) for t in classes for p in classes]
    spine = df.sparkSession.createDataFrame(cells, "label int, pred int")
    counted = df.groupBy(F.col(label).cast("int").alias("label"), F.col(pred).cast("int").alias("pred")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return spine.join(counted, ["label", "pred"], "left").select("label", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def binary_metrics(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Accuracy, and precision, recall and F1 of class 1; an undefined ratio is 0."""
    y, z = F.col(label) == 1, F.col(pred) == 1

    def count(condition: Column) -> Column:
        return F.sum(condition.cast("int"))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))

    cells = df.agg(
        count(y & z).alias("tp"), count(~y & z).alias("fp"), count(y & ~z).alias("fn"), count(y == z).alias("right"),
        F.count(F.lit(1)).alias("n"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return cells.select(
        ratio(F.col("right"), F.col("n")).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def log_loss(df: DataFrame, label: str = "label", score: str = "p") -> DataFrame:
    """Mean binary cross-entropy of clipped probabilities."""
    p = F.least(F.greatest(F.col(score), F.lit(CLIP)), F.lit(1 - CLIP))
    y = F.col(label)
    return df.agg(F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))


def score_card(df: DataFrame, name: str, label: str = "label", pred: str = "pred", score: str = "p") -> DataFrame:
    """One row of all metrics of a model: two scalar results, no join of predictions."""
    auc = roc_auc(df, label, score).scalar()
    return binary_metrics(df, label, pred).select(F.lit(name).alias("model"), "*", auc.alias("roc_auc"))


def compare_models(scored: dict[str, DataFrame], label: str = "label", pred: str = "pred", score: str = "p") -> DataFrame:
    """One row of metrics per scored model."""
    cards = [score_card(df, name, label, pred, score) for name, df in scored.items()]
    return reduce(DataFrame.unionByName, cards)
