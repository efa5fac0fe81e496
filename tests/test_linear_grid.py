import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from tidalframe.operators import linear_grid, selection
from tidalframe.operators.metrics import binary_metrics
from tidalframe.operators.models import logistic_elastic_net, score

SETTINGS = [(0.01, 0.0), (1.0, 0.0), (100.0, 0.0), (0.1, 0.5), (0.02, 1.0), (10.0, 0.8)]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 5)) * [1, 3, 0.5, 1, 1]
    x[:, 4] = x[:, 3]  # two equal columns
    y = (x[:, 0] - x[:, 1] + rng.normal(size=900) > 0.5).astype(float)
    return x, y, np.arange(900) % 3


@pytest.fixture(scope="module")
def rows(spark, data):
    x, y, fold = data
    return spark.createDataFrame([(v.tolist(), float(t), int(f)) for v, t, f in zip(x, y, fold)], "x array<double>, label double, fold int").repartition(5)


def test_every_model_is_at_its_optimum(rows, data):
    """At the least point the gradient is within the penalty where a coefficient is 0, and equals it where it is not."""
    x, y, fold = data
    out = [0, 1, 2, 0, 1, -1]
    found = linear_grid.fit_settings(rows, SETTINGS, out)
    assert (found[4][1:] == 0).any() and (found[1][1:] != 0).all()
    for (c, ratio), held, b in zip(SETTINGS, out, found):
        a, t = x[fold != held], y[fold != held]
        p = 1 / (1 + np.exp(-(b[0] + a @ b[1:])))
        slope = c * (a.T @ (p - t)) + (1 - ratio) * b[1:]
        assert abs((p - t).sum()) < 1e-5 * len(t)
        assert np.all(np.abs(np.where(b[1:] == 0, np.maximum(np.abs(slope) - ratio, 0), slope + ratio * np.sign(b[1:]))) < 1e-4)


def test_equals_spark_on_all_rows(spark, rows, data):
    x, y, _ = data
    vectors = spark.createDataFrame([(Vectors.dense(v.tolist()), float(t)) for v, t in zip(x, y)], ["features", "label"])
    ours = linear_grid.fit_settings(rows, SETTINGS[:4], [-1] * 4)
    for (c, ratio), b in zip(SETTINGS, ours):
        model = logistic_elastic_net(900, c, ratio, tol=1e-12).fit(vectors)
        assert np.allclose(x @ b[1:] + b[0], x @ model.coefficients.toArray() + model.intercept, atol=2e-3)


def test_f1_on_the_own_fold_and_search(spark, rows, data):
    x, y, fold = data
    b = linear_grid.fit_settings(rows, [(1.0, 0.0)] * 3, [0, 1, 2])
    want = []
    for f in range(3):
        hit, true = b[f][0] + x[fold == f] @ b[f][1:] > 0, y[fold == f] == 1
        want.append(2 * (hit & true).sum() / (hit.sum() + true.sum()))
    assert linear_grid.held_out_f1(rows, b, [0, 1, 2]) == pytest.approx(want)
    train = spark.createDataFrame([(i, Vectors.dense(v.tolist()), float(t)) for i, (v, t) in enumerate(zip(x, y))], ["key", "features", "label"])
    means = linear_grid.search_settings(train, [{"c": 1.0}, {"c": 0.0001, "l1_ratio": 1.0}, {"c": 1.0, "l1_ratio": 0.0}], "key")
    assert means[0] == means[2] > 0.8 and means[1] < means[0]


def test_separable_rows_and_too_many_features(spark, monkeypatch):
    rows = spark.createDataFrame([([float(i)], float(i > 10), 0) for i in range(21)], "x array<double>, label double, fold int")
    b = linear_grid.fit_settings(rows, [(100.0, 0.0)], [-1])[0]
    assert np.isfinite(b).all() and b[1] > 0
    monkeypatch.setattr(linear_grid, "MOST_FEATURES", 0)
    with pytest.raises(ValueError, match="features"):
        linear_grid.fit_settings(rows, [(1.0, 0.0)], [-1])


def test_few_passes_where_features_add_up(spark, monkeypatch):
    """Two full sets of 0/1 columns, a penalty that leaves their sums nearly free: exact steps need few passes."""
    rng = np.random.default_rng(7)
    x = np.column_stack([rng.normal(size=2000), np.eye(5)[rng.integers(0, 5, 2000)], np.eye(6)[rng.integers(0, 6, 2000)]])
    y = (x[:, 0] + x[:, 1] - x[:, 7] + rng.logistic(size=2000) > 0).astype(float)
    rows = spark.createDataFrame([(v.tolist(), float(t), i % 3) for i, (v, t) in enumerate(zip(x, y))], "x array<double>, label double, fold int")
    passes, sums = [], linear_grid._sums
    monkeypatch.setattr(linear_grid, "_sums", lambda *a: passes.append(1) or sums(*a))
    for b in linear_grid.fit_settings(rows, [(10.0, 0.2), (10.0, 0.8), (1.0, 0.5)], [-1] * 3):
        p = 1 / (1 + np.exp(-(b[0] + x @ b[1:])))
        assert np.isfinite(b).all() and abs((p - y).sum()) < 1e-3
    assert len(passes) <= 12


def test_models_near_each_other_share_their_passes(rows, monkeypatch):
    """Settings of a fold start where its most penalised model nearly stands still, so most passes are for a model a fold."""
    apart, sums = [], linear_grid._sums

    def seen(rows, b, out, *more):
        apart.append(len({(f, *column) for f, column in zip(out, b.T)}))
        return sums(rows, b, out, *more)

    monkeypatch.setattr(linear_grid, "_sums", seen)
    settings = [(c, ratio) for c in (1e3, 1e4, 1e5, 1e6) for ratio in (0.0, 0.2, 0.5, 0.8)]
    linear_grid.fit_settings(rows, [s for s in settings for _ in range(3)], [0, 1, 2] * len(settings))
    assert len([n for n in apart if n > 3]) <= 4 and sum(apart) < len(apart) * 24


def test_a_sweep_folds_once_and_refits_on_all_rows(spark, data, monkeypatch):
    x, y, _ = data
    train = spark.createDataFrame([(i, Vectors.dense(v[:4].tolist()), float(t)) for i, (v, t) in enumerate(zip(x, y))], ["key", "features", "label"])
    ranking = spark.createDataFrame([(1, "b", 3.0), (0, "a", 2.0), (3, "d", 0.2), (2, "c", 0.1)], "idx int, name string, importance double")
    folded, folds = [], linear_grid.stratified_folds
    monkeypatch.setattr(linear_grid, "stratified_folds", lambda *a: folded.append(1) or folds(*a))
    found, models = selection.sweep_top_k_tuned(train, train, ranking, "LogisticRegression", {"c": [0.1, 1]}, "key", ks=(4, 2))
    assert len(folded) == 1
    for (k, model), row in zip(models.items(), found.orderBy("seq").collect()):
        used = [0, 1] if k == 2 else [0, 1, 2, 3]
        vectors = spark.createDataFrame([(Vectors.dense(v[used].tolist()), float(t)) for v, t in zip(x, y)], ["features", "label"])
        spark_model = logistic_elastic_net(900, eval(row.settings)["c"], 0.0, tol=1e-12).fit(vectors)
        assert np.allclose(model.coefficients.toArray(), spark_model.coefficients.toArray(), atol=2e-3)
        assert abs(model.intercept - spark_model.intercept) < 2e-3 and model.getRegParam() == spark_model.getRegParam()
        assert row.f1 == pytest.approx(binary_metrics(score(spark_model, vectors)).first()["f1"], abs=5e-3)


def test_folded_rows_are_whole_and_in_small_blocks(spark):
    data = [(i, Vectors.dense([float(i + j) for j in range(20)]), float(i % 2)) for i in range(3000)]
    packed = linear_grid.folded_rows(spark.createDataFrame(data, ["key", "features", "label"]).coalesce(1), "key").collect()
    assert max(len(r.x) for r in packed) <= 1 << 16 and {r.width for r in packed} == {20}
    x = np.concatenate([np.frombuffer(r.x).reshape(-1, 20) for r in packed])
    assert x[np.argsort(x[:, 0])].tolist() == [d[1].toArray().tolist() for d in data]
    assert sorted(sum(len(r.label) // 8 for r in packed if r.fold == f) for f in range(3)) == [1000] * 3
