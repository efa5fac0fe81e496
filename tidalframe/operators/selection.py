"""Feature importance, top-k sweeps and picking of results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Model, Transformer
from pyspark.ml.feature import VectorSlicer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidalframe.operators.linear_grid import folded_rows
from tidalframe.operators.metrics import binary_metrics
from tidalframe.operators.models import grid_search, score


def name_importances(names: DataFrame, importances: DataFrame) -> DataFrame:
    """Names and values of the same position: inputs (idx, name) and (idx, importance)."""
    return names.join(importances, "idx").select("idx", "name", "importance")


def importance_values(model: Model) -> list[float]:
    """Tree importances, or signed coefficients; other models have none."""
    if hasattr(model, "featureImportances"):
        return model.featureImportances.toArray().tolist()
    if hasattr(model, "coefficients"):
        return model.coefficients.toArray().tolist()
    raise ValueError(f"{type(model).__name__} has no feature importance")


def feature_importance(spark: SparkSession, model: Model, names: Sequence[str]) -> DataFrame:
    """(idx, name, importance), highest first; coefficients keep their sign."""
    values = spark.createDataFrame(list(enumerate(importance_values(model))), "idx int, importance double")
    labels = spark.createDataFrame(list(enumerate(names)), "idx int, name string")
    return name_importances(labels, values).orderBy(F.desc("importance"), "idx")


def feature_ranking(importance: DataFrame) -> DataFrame:
    """The same by size, sign dropped."""
    return importance.withColumn("importance", F.abs("importance")).orderBy(F.desc("importance"), "idx")


def top_k_features(ranking: DataFrame, k: int) -> DataFrame:
    """First k of the order by size."""
    return ranking.orderBy(F.desc(F.abs("importance")), "idx").limit(k)


def slicer(ranking: DataFrame, k: int, source: str = "features", out: str = "features_k") -> VectorSlicer:
    """Stage that keeps the k best positions of a vector."""
    indices = [r["idx"] for r in top_k_features(ranking, k).collect()]
    return VectorSlicer(inputCol=source, outputCol=out, indices=sorted(indices))


def sweep_stop(results: DataFrame, baseline: float, delta: float, *by: str) -> DataFrame:
    """Rows in sequence up to and including the first whose F1 is below ``baseline - delta``, per run when given."""
    failed = F.col("f1") < baseline - delta
    if not by:
        stop = results.agg(F.min(F.when(failed, F.col("seq"))).alias("s")).scalar()
        return results.where(F.coalesce(F.col("seq") <= stop, F.lit(True)))
    ends = results.where(failed).groupBy(*by).agg(F.min("seq").alias("_stop"))
    return results.join(ends, list(by), "left").where(F.coalesce(F.col("seq") <= F.col("_stop"), F.lit(True))).drop("_stop")


def best_result(results: DataFrame, *by: str) -> DataFrame:
    """Row with the highest F1, the earliest of equals."""
    rest = [c for c in results.columns if c not in ("f1", "seq", *by)]
    top = results.groupBy(*by).agg(F.max(F.struct("f1", (-F.col("seq")).alias("_neg"), *rest)).alias("_best"))
    return top.select(*by, "_best.f1", (-F.col("_best._neg")).alias("seq"), *[f"_best.{c}" for c in rest])


def pick_by_k(results: DataFrame, k: int = 10, *by: str) -> DataFrame:
    """First row with the given k."""
    rest = [c for c in results.columns if c not in ("seq", *by)]
    first = results.where(F.col("k") == k).groupBy(*by).agg(F.min_by(F.struct(*rest, "seq"), "seq").alias("_row"))
    return first.select(*by, "_row.*").where(F.col("k").isNotNull())


def _f1_accuracy(model: Transformer, test: DataFrame) -> tuple[float, float]:
    row = binary_metrics(score(model, test)).first()
    return row["f1"], row["accuracy"]


def sweep_top_k(
    train: DataFrame, test: DataFrame, ranking: DataFrame, estimator_of, ks: Sequence[int] = (50, 30, 20, 10, 5),
    baseline_f1: float | None = None, delta: float = 0.01,
) -> DataFrame:
    """Refit on the k best features for each k and measure; end after the first k that loses more than ``delta``.

    ``estimator_of`` makes a fresh estimator. The loop runs over a handful of k values, every fit is a Spark job.
    Rows (seq, k, accuracy, f1), ready for ``best_result``.
    """
    results, known = [], {}
    for seq, k in enumerate(ks):
        cut = slicer(ranking, k)
        at = tuple(cut.getIndices())
        if at not in known:  # every k from the number of features on has the same ones
            known[at] = _f1_accuracy(estimator_of().fit(_narrow(cut, train)), _narrow(cut, test))
        f1, accuracy = known[at]
        results.append((seq, k, accuracy, f1))
        if baseline_f1 is not None and f1 < baseline_f1 - delta:
            break
    return train.sparkSession.createDataFrame(results, "seq int, k int, accuracy double, f1 double")


def sweep_top_k_tuned(
    train: DataFrame, test: DataFrame, ranking: DataFrame, name: str, grid: Mapping[str, Sequence], key: str,
    ks: Sequence[int] = (50, 30, 20, 10, 5), baseline_f1: float | None = None, delta: float = 0.01,
) -> tuple[DataFrame, dict[int, Model]]:
    """The sweep with a grid search per k: result rows with the chosen settings, and the model of each k.

    The folds depend on key and label only, so the linear searches of all k read one folded table.
    """
    results, models, known = [], {}, {}
    folded = folded_rows(train, key) if name.startswith("Logistic") else None
    for seq, k in enumerate(ks):
        cut = slicer(ranking, k)
        at = tuple(cut.getIndices())
        if at not in known:  # every k from the number of features on has the same ones
            model, settings, _ = grid_search(_narrow(cut, train), name, grid, key, folded=folded, columns=at)
            known[at] = (model, settings, *_f1_accuracy(model, _narrow(cut, test)))
        models[k], settings, f1, accuracy = known[at]
        results.append((seq, k, accuracy, f1, str(settings)))
        if baseline_f1 is not None and f1 < baseline_f1 - delta:
            break
    frame = train.sparkSession.createDataFrame(results, "seq int, k int, accuracy double, f1 double, settings string")
    return frame, models


def _narrow(cut: VectorSlicer, df: DataFrame) -> DataFrame:
    return cut.transform(df).drop("features").withColumnRenamed("features_k", "features")
