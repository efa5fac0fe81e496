import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tidalframe.operators import features, models, selection
from tidalframe.sources import tables


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, float(i % 7) if i % 5 else None, 7.0, ["a", "b", None][i % 3], float(i % 7 > 3)) for i in range(300)]
    return spark.createDataFrame(data, "row_key int, x double, c double, k string, label double")


def test_constant_column_is_only_centred(rows):
    assert {r.c for r in features.robust_scale(rows.select("c"), ["c"]).collect()} == {0.0}


def test_impute_uses_the_exact_median(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "x double")
    assert sorted(r.x for r in features.impute_median(df, ["x"]).collect()) == [1.0, 2.0, 2.5, 3.0, 4.0]


def test_one_hot_unknown_and_null(spark, rows):
    lists = features.fit_categories(rows, ["k"])
    assert lists == {"k": ["a", "b", None]}
    new = spark.createDataFrame([("b",), (None,), ("zz",)], "k string")
    assert [tuple(r) for r in features.one_hot(new, ["k"], lists).collect()] == [(0, 1, 0), (0, 0, 1), (0, 0, 0)]


def test_preprocessor_names_unknowns_and_reload(spark, rows, tmp_path):
    pre = features.fit_preprocessor(rows, ["x", "c"], ["k"], keep=["row_key"])
    assert features.feature_name_list(pre) == ["x", "c", "k_a", "k_b", "k_None"]
    new = spark.createDataFrame([(1, None, 8.0, "zz"), (2, 5.0, 7.0, None)], "row_key int, x double, c double, k string")
    tables.save_model(pre, str(tmp_path / "pre"))
    for model in (pre, tables.load_model(str(tmp_path / "pre"))):
        got = [list(r[0]) for r in model.transform(new).orderBy("row_key").select(vector_to_array("features")).collect()]
        assert got[0] == [0.0, 1.0, 0.0, 0.0, 0.0] and got[1][1:] == [0.0, 0.0, 0.0, 1.0]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4))
    y = (x[:, 1] * 2 - x[:, 3] + rng.normal(scale=0.3, size=400) > 0).astype(float)
    data = [(i, Vectors.dense(v), float(t)) for i, (v, t) in enumerate(zip(x.tolist(), y))]
    return spark.createDataFrame(data, ["row_key", "features", "label"]).persist()


def test_grid_search_takes_first_best_and_even_folds(vectors):
    model, best, means = models.grid_search(vectors, "LogisticRegression", {"c": [1.0, 1.0]}, "row_key")
    assert best == {"c": 1.0} and len(means) == 2 and means[0] == pytest.approx(means[1]) and means[0] > 0.85
    assert model.coefficients.size == 4


def test_grid_counts():
    assert [len(models.candidates(n, g, 10)) for n, g in models.FIRST_GRIDS.items()] == [12, 8, 16, 9, 5]
    assert [len(models.candidates(n, g, 10)) for n, g in models.SECOND_GRIDS.items()] == [27, 72, 4]


def test_importance_and_sweep(spark, vectors):
    forest = models.random_forest(5, max_depth=4).fit(vectors)
    found = selection.feature_importance(spark, forest, list("pqrs"))
    assert sum(r.importance for r in found.collect()) == pytest.approx(1.0)
    logistic = models.logistic_l2(400).fit(vectors)
    signed = selection.feature_importance(spark, logistic, list("pqrs"))
    ranking = selection.feature_ranking(signed)
    assert [r.name for r in ranking.limit(2).collect()] == ["q", "s"]
    assert [r.name for r in selection.top_k_features(signed, 2).collect()] == ["q", "s"]
    swept = selection.sweep_top_k(vectors, vectors, ranking, lambda: models.logistic_l2(400), ks=(4, 2, 1), baseline_f1=0.99, delta=0.05)
    assert [r.k for r in swept.orderBy("seq").collect()][0] == 4
    with pytest.raises(ValueError):
        selection.importance_values(object())


def test_scores_are_probabilities(vectors):
    model = models.boosted_subsampled(3, max_depth=3).fit(vectors)
    low, high, n = models.score(model, vectors).agg(F.min("p"), F.max("p"), F.count("p")).first()
    assert 0 <= low <= high <= 1 and n == 400


def test_pca_keeps_enough_variance(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=300)
    data = [(float(v), float(v * 2 + 1e-3 * w), float(w)) for v, w in zip(a, rng.normal(size=300))]
    model, k = models.pca_reduce(spark.createDataFrame(data, "x double, y double, z double"), ["x", "y", "z"], 0.9)
    assert k == 2
