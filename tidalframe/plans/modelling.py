"""Queries that fit models, all with the library defaults and on all training rows."""

from __future__ import annotations

from pyspark.ml import Model, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidalframe.functions.labels import bleach_class, encode_label
from tidalframe.operators import features, metrics, models, scoring, selection, splitting
from tidalframe.operators.linear_grid import search_settings
from tidalframe.plans.catalog import query
from tidalframe.plans.features import CATEGORIES
from tidalframe.plans.standins import FEATURES, obs_kept, r6, table
from tidalframe.session import kept, scratch_path
from tidalframe.sources.images import image_manifest

_prepared: dict[tuple[str, str], tuple[str, list[str], PipelineModel]] = {}
_fitted: dict[tuple[str, str], Model] = {}

TREE_MODELS = {"RandomForest": models.random_forest, "GradientBoosting": models.gradient_boosting, "XGBoost": models.boosted_subsampled}
LINEAR_MODELS = {"LogisticElasticNet": models.logistic_elastic_net, "LogisticRegressionClassic": models.logistic_l2}


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Observations with a target, their label, and a key that names a row; joined once per session."""
    cols = ["obs_no", "site_id", "data_source", *FEATURES, *CATEGORIES, "percent_bleaching"]
    known = obs_kept(spark, d, cols, "percent_bleaching IS NOT NULL")
    key = F.concat_ws("-", "obs_no", "site_id", "data_source", "distance_to_shore")
    return known.withColumns({"label": encode_label(bleach_class(F.col("percent_bleaching"))), "row_key": key})


def training_set(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, list[str], PipelineModel]:
    """Train and test part, feature names and the preprocessor fitted on the train part.

    The prepared table is written once per session and folder: every fit reads it many times.
    """
    at = (spark.sparkContext.applicationId, d)
    if at not in _prepared:
        rows = splitting.random_split(labelled(spark, d), "row_key", 20, seed=models.SEED)
        pre = features.fit_preprocessor(rows.where("split = 'train'"), FEATURES, CATEGORIES, keep=["row_key", "label", "split"])
        path = scratch_path(spark, "training")
        pre.transform(rows).write.parquet(path)
        _prepared[at] = (path, features.feature_name_list(pre), pre)
    path, names, pre = _prepared[at]
    prepared = spark.read.parquet(path)
    return prepared.where("split = 'train'").drop("split"), prepared.where("split = 'test'").drop("split"), names, pre


def fitted(spark: SparkSession, d: str, name: str) -> Model:
    """One of the five classifiers, fitted once per prepared table."""
    train, _, _, _ = training_set(spark, d)
    at = (_prepared[spark.sparkContext.applicationId, d][0], name)
    if at not in _fitted:
        rows = train.select("label", "features")
        _fitted[at] = (TREE_MODELS[name]() if name in TREE_MODELS else LINEAR_MODELS[name](train.count())).fit(rows)
    return _fitted[at]


def scored_test(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The test part with the scores of a classifier: written, as metrics pass over the scores three times."""
    _, test, _, _ = training_set(spark, d)
    return kept(models.score(fitted(spark, d, name), test), "scored")


def _card(name: str, spark: SparkSession, d: str) -> DataFrame:
    card = metrics.score_card(scored_test(spark, d, name), name)
    return card.select("model", r6("accuracy"), r6("precision"), r6("recall"), r6("f1"), r6("roc_auc"))


@query("m7_random_forest")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _card("RandomForest", spark, d)


@query("m8_gradient_boosting")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _card("GradientBoosting", spark, d)


@query("m9_boosted_subsampled")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _card("XGBoost", spark, d)


@query("m10_logistic_elastic_net")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _card("LogisticElasticNet", spark, d)


@query("m11_logistic_l2")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _card("LogisticRegressionClassic", spark, d)


@query("a23_fitted_models")
def _(spark: SparkSession, d: str) -> DataFrame:
    """All five classifiers on the same test rows; one after the other, as each fit on all rows needs the memory of the executors."""
    scored = {name: scored_test(spark, d, name) for name in [*TREE_MODELS, *LINEAR_MODELS]}
    return metrics.compare_models(scored).select(
        "model", r6("accuracy"), r6("precision"), r6("recall"), r6("f1"), r6("roc_auc")
    )


# The linear grids of both searches; all their settings and folds are fitted in the same passes.
LINEAR_GRIDS = {
    "LogisticElasticNet": models.FIRST_GRIDS["LogisticElasticNet"], "LogisticRegressionClassic": models.FIRST_GRIDS["LogisticRegressionClassic"],
    "LogisticRegression": models.SECOND_GRIDS["LogisticRegression"],
}


@query("m12_grid_search")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Every setting of the three linear grids: mean F1 on three folds, and the chosen one of each grid, the first of equals."""
    train, _, _, _ = training_set(spark, d)
    settings = [(name, s) for name, grid in LINEAR_GRIDS.items() for s, _ in models.candidates(name, grid, 1)]
    means = search_settings(train, [s for _, s in settings], "row_key")
    best = {name: max(f1 for (n, _), f1 in zip(settings, means) if n == name) for name in LINEAR_GRIDS}
    rows, taken = [], set()
    for (name, s), f1 in zip(settings, means):
        rows.append((name, float(s["c"]), float(s.get("l1_ratio", 0.0)), round(f1, 6), f1 == best[name] and name not in taken))
        taken |= {name} if f1 == best[name] else set()
    return spark.createDataFrame(rows, "grid string, c double, l1_ratio double, f1 double, chosen boolean")


@query("m13_feature_importance")
def _(spark: SparkSession, d: str) -> DataFrame:
    _, _, names, _ = training_set(spark, d)
    return selection.feature_importance(spark, fitted(spark, d, "RandomForest"), names)


def _ranking(spark: SparkSession, d: str) -> DataFrame:
    _, _, names, _ = training_set(spark, d)
    return selection.feature_ranking(selection.feature_importance(spark, fitted(spark, d, "LogisticRegressionClassic"), names))


def _baseline(spark: SparkSession, d: str) -> float:
    """F1 of the model on all features, which the ranking is made from."""
    _, test, _, _ = training_set(spark, d)
    return metrics.binary_metrics(models.score(fitted(spark, d, "LogisticRegressionClassic"), test)).first()["f1"]


@query("m14_feature_ranking")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _ranking(spark, d)


@query("m15_sweep_top_k")
def _(spark: SparkSession, d: str) -> DataFrame:
    train, test, _, _ = training_set(spark, d)
    n = train.count()
    return selection.sweep_top_k(
        train, test, _ranking(spark, d), lambda: models.logistic_l2(n), baseline_f1=_baseline(spark, d)
    )


@query("m16_sweep_top_k_tuned")
def _(spark: SparkSession, d: str) -> DataFrame:
    train, test, _, _ = training_set(spark, d)
    results, _ = selection.sweep_top_k_tuned(
        train, test, _ranking(spark, d), "LogisticRegression", models.SECOND_GRIDS["LogisticRegression"], "row_key", baseline_f1=_baseline(spark, d)
    )
    return results


def image_vectors(spark: SparkSession, d: str) -> DataFrame:
    """(path, image_id, label, features): label 1 is the second class by alphabet."""
    base = table(spark, d, "embeddings")
    folder = F.when(F.col("label") < 5, "Bleached").otherwise("Unbleached")
    named = base.select(
        F.col("vec_id").alias("image_id"), F.concat(F.lit("file:/set/"), folder, F.lit("/img_"), F.col("vec_id").cast("string"), F.lit(".png")).alias("path"),
        "embedding",
    )
    manifest = image_manifest(named.select("path"))
    joined = manifest.join(named, "path").withColumn("label", F.col("class_index").cast("double"))
    return models.as_vector(joined.select("path", "image_id", "label", "embedding"), "embedding")


@query("m17_transfer_head")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = splitting.random_split(image_vectors(spark, d), "image_id", 20)
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    heads = {"no hidden layer": models.transfer_head(), "256 hidden": models.transfer_head(256, max_iter=30)}
    return metrics.compare_models({name: models.score(e.fit(train), test) for name, e in heads.items()})


@query("m18_score_tabular")
def _(spark: SparkSession, d: str) -> DataFrame:
    _, _, _, pre = training_set(spark, d)
    classifier = fitted(spark, d, "LogisticRegressionClassic")
    rows = labelled(spark, d).withColumn("split", F.lit("score"))
    scored = scoring.score_tabular(rows, PipelineModel(stages=[*pre.stages, classifier]), ["row_key"])
    return scored.select("row_key", "predicted_class", r6("probability_bleached"), r6("probability_unbleached"))


@query("m19_score_images")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = image_vectors(spark, d)
    scored = scoring.score_images(rows, models.transfer_head().fit(rows))
    return scored.select("filename", "pred_class", r6("p_bleached"), r6("confidence"))


@query("m19_predicted_counts")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = image_vectors(spark, d)
    return scoring.predicted_counts(scoring.score_images(rows, models.transfer_head().fit(rows)))


@query("r2_predict_image_job")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = image_vectors(spark, d)
    model = models.transfer_head().fit(rows)
    sent = rows.withColumn("content_type", F.when(F.col("image_id") % 9 == 0, "text/plain").when(F.col("image_id") % 8 == 0, None).otherwise("image/png"))
    done = scoring.predict_image_job(sent, model, key="image_id")
    return done.select("image_id", "error", "predicted_class", r6("probability_bleached"), r6("probability_unbleached"))


@query("m21_pca_reduce")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Variance of every kept component over the table."""
    base = obs_kept(spark, d, FEATURES)
    model, _ = models.pca_reduce(base, FEATURES, 0.9)
    parts = model.transform(base).select(F.posexplode(vector_to_array("components")).alias("component", "v"))
    return parts.groupBy("component").agg(F.round(F.var_samp("v"), 6).alias("variance"))
