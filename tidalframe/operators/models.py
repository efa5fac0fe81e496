"""Classifiers, grid search and scoring of hold-out sets, on Spark ML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark import SparkContext
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, LogisticRegressionModel, MultilayerPerceptronClassifier, RandomForestClassifier,
)
from pyspark.ml.common import _py2java
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, SQLTransformer, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import CrossValidator
from pyspark.ml.wrapper import JavaParams
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalframe.operators.features import fit_quartiles
from tidalframe.operators.linear_grid import folded_rows, search_and_fit
from tidalframe.operators.splitting import stratified_folds

SEED = 42
# Depth Spark's trees end at; stands for "no limit".
DEEPEST = 30


def random_forest(trees: int = 300, max_depth: int | None = None, min_split: int = 2, **extra) -> RandomForestClassifier:
    """Forest of 300 unpruned trees on random square-root feature subsets.

    Spark bounds rows per leaf, not per split: a split of ``min_split`` rows leaves at least half of them, rounded down.
    """
    settings = dict(
        numTrees=trees, maxDepth=max_depth or DEEPEST, minInstancesPerNode=max(1, min_split // 2),
        featureSubsetStrategy="sqrt", seed=SEED, maxMemoryInMB=1024,
    )
    return RandomForestClassifier(**{**settings, **extra})


def gradient_boosting(rounds: int = 300, rate: float = 0.05, max_depth: int = 3, **extra) -> GBTClassifier:
    """Boosted shallow trees."""
    return GBTClassifier(**{**dict(maxIter=rounds, stepSize=rate, maxDepth=max_depth, seed=SEED, maxMemoryInMB=1024), **extra})


def boosted_subsampled(
    rounds: int = 300, rate: float = 0.05, max_depth: int | None = 6, subsample: float = 0.8, columns: float = 0.8, **extra
) -> GBTClassifier:
    """Boosted deeper trees on row and column samples: first-order gradients, columns drawn per node."""
    settings = dict(
        maxIter=rounds, stepSize=rate, maxDepth=max_depth or DEEPEST, subsamplingRate=subsample,
        featureSubsetStrategy=str(columns), seed=SEED, maxMemoryInMB=1024,
    )
    return GBTClassifier(**{**settings, **extra})


def logistic_elastic_net(n_rows: int, c: float = 1.0, l1_ratio: float = 0.5, max_iter: int = 5000, **extra) -> LogisticRegression:
    """Logistic regression with a mixed penalty; ``c`` is the inverse strength of a summed loss, hence the row count."""
    settings = dict(elasticNetParam=l1_ratio, regParam=1.0 / (c * n_rows), standardization=False, maxIter=max_iter)
    return LogisticRegression(**{**settings, **extra})


def logistic_l2(n_rows: int, c: float = 1.0, max_iter: int = 2000, **extra) -> LogisticRegression:
    return logistic_elastic_net(n_rows, c, 0.0, max_iter, **extra)


# The two search grids, as the values tried per setting. None means no depth limit.
FIRST_GRIDS: dict[str, dict[str, list]] = {
    "RandomForest": {"trees": [200, 400], "max_depth": [None, 10, 20], "min_split": [2, 5]},
    "GradientBoosting": {"rounds": [200, 400], "rate": [0.05, 0.1], "max_depth": [2, 3]},
    "XGBoost": {"rounds": [200, 400], "rate": [0.03, 0.1], "max_depth": [4, 6], "subsample": [0.8, 1.0]},
    "LogisticElasticNet": {"c": [0.1, 1, 10], "l1_ratio": [0.2, 0.5, 0.8]},
    "LogisticRegressionClassic": {"c": [0.01, 0.1, 1, 10, 100]},
}
SECOND_GRIDS: dict[str, dict[str, list]] = {
    "RandomForestClassifier": {"trees": [100, 200, 400], "max_depth": [None, 5, 10], "min_split": [2, 5, 10]},
    "XGBClassifier": {"rounds": [100, 200, 400], "rate": [0.01, 0.05, 0.1, 0.5], "max_depth": [None, 5, 10], "subsample": [0.8, 1.0]},
    "LogisticRegression": {"c": [0.01, 0.1, 1, 10]},
}
BUILDERS = {
    "RandomForest": random_forest, "RandomForestClassifier": random_forest,
    "GradientBoosting": gradient_boosting,
    "XGBoost": boosted_subsampled, "XGBClassifier": boosted_subsampled,
    "LogisticElasticNet": logistic_elastic_net,
    "LogisticRegressionClassic": logistic_l2, "LogisticRegression": logistic_l2,
}


def candidates(name: str, grid: Mapping[str, Sequence], n_rows: int) -> list[tuple[dict, Estimator]]:
    """Every setting of a grid with its estimator, in grid order."""
    fixed = {"n_rows": n_rows} if name.startswith("Logistic") else {}
    settings = [dict(zip(grid, values)) for values in product(*grid.values())]
    return [(s, BUILDERS[name](**fixed, **s)) for s in settings]


def _as_param_map(shell: Estimator, candidate: Estimator) -> dict:
    return {shell.getParam(p.name): v for p, v in candidate.extractParamMap().items() if p.name not in ("featuresCol", "labelCol")}


def linear_model(estimator: LogisticRegression, coefficients: Sequence[float]) -> LogisticRegressionModel:
    """The model of known coefficients, intercept first, with the settings of an estimator."""
    context = SparkContext._active_spark_context
    vector = _py2java(context, Vectors.dense(coefficients[1:]))
    java = JavaParams._new_java_obj("org.apache.spark.ml.classification.LogisticRegressionModel", estimator.uid, vector, float(coefficients[0]))
    return estimator._copyValues(LogisticRegressionModel(java))


def grid_search(
    train: DataFrame, name: str, grid: Mapping[str, Sequence], key: str, folds: int = 3, label: str = "label",
    parallelism: int = 2, folded: DataFrame | None = None, columns: Sequence[int] | None = None,
) -> tuple[Model, dict, list[float]]:
    """Try every setting on stratified folds, keep the best F1 of class 1 (the first on ties), refit it on all rows.

    Returns the model, its settings and the mean F1 of every candidate in grid order. Linear candidates are fitted all
    together, on folds and on all rows, a pass over the rows per step; for several searches on the same rows ``folded`` is their
    ``folded_rows`` of all features, and ``columns`` are the features that ``train`` has of them. For others folds are assigned
    once; the folded table is kept in memory or on disk for the fits and released after them.
    """
    if name.startswith("Logistic"):
        options = candidates(name, grid, train.count())
        rows = folded if folded is not None else folded_rows(train, key, folds, label)
        settings = [{"l1_ratio": 0.0, **s} if "Elastic" not in name else {"l1_ratio": 0.5, **s} for s, _ in options]
        means, whole = search_and_fit(rows, [{"c": 1.0, **s} for s in settings], folds, columns)
        best = means.index(max(means))
        return linear_model(options[best][1].setLabelCol(label), whole[best]), options[best][0], means
    folded = stratified_folds(train, key, label, folds, "fold").persist()
    try:
        options = candidates(name, grid, folded.count())
        shell = options[0][1]
        search = CrossValidator(
            estimator=shell,
            estimatorParamMaps=[_as_param_map(shell, e) for _, e in options],
            evaluator=MulticlassClassificationEvaluator(metricName="fMeasureByLabel", metricLabel=1.0, labelCol=label),
            numFolds=folds, foldCol="fold", parallelism=parallelism, seed=SEED,
        )
        found = search.fit(folded)
    finally:
        folded.unpersist()
    means = list(found.avgMetrics)
    best = means.index(max(means))
    return found.bestModel, options[best][0], means


def score(model: Transformer, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., label, p, pred): probability of class 1 and predicted class."""
    p = vector_to_array("probability")[1]
    return model.transform(df).select(*keep, F.col("label").cast("int").alias("label"), p.alias("p"), F.col("prediction").cast("int").alias("pred"))


def transfer_head(hidden: int | None = None, width: int = 64, max_iter: int = 100) -> Estimator:
    """Classifier on frozen image vectors: one hidden layer of the given size, or none."""
    if hidden is None:
        return LogisticRegression(maxIter=max_iter)
    return MultilayerPerceptronClassifier(layers=[width, hidden, 2], maxIter=max_iter, seed=SEED)


def as_vector(df: DataFrame, array_col: str, out: str = "features") -> DataFrame:
    """Array of numbers as an ML vector."""
    return df.withColumn(out, array_to_vector(F.col(array_col).cast("array<double>"))).drop(array_col)


def pca_reduce(df: DataFrame, cols: Sequence[str], variance: float = 0.9, out: str = "components") -> tuple[PipelineModel, int]:
    """Impute medians, standardise, and keep the fewest principal components that explain the given variance."""
    q = fit_quartiles(df, cols)
    filled = ", ".join(f"coalesce(`{c}`, {q[c][1]!r}D) AS `filled_{c}`" for c in cols)
    prepare = Pipeline(stages=[
        SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"),
        VectorAssembler(inputCols=[f"filled_{c}" for c in cols], outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True),
    ]).fit(df)
    full = PCA(k=len(cols), inputCol="scaled", outputCol="all_components").fit(prepare.transform(df))
    explained, k = 0.0, 0
    for share in full.explainedVariance.toArray():
        explained, k = explained + share, k + 1
        if explained > variance:
            break
    first = VectorSlicer(inputCol="all_components", outputCol=out, indices=list(range(k)))
    return PipelineModel(stages=[*prepare.stages, full, first]), k
