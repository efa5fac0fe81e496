"""What the registered model queries are fitted on."""

import pytest

from tidalframe.plans import modelling


@pytest.mark.parametrize("name", sorted(modelling.TREE_MODELS))
def test_tree_models_are_fitted_on_all_training_rows(spark, monkeypatch, name):
    train = spark.range(2_500).selectExpr("id AS row_key", "CAST(id % 2 AS DOUBLE) AS label", "id AS features")
    seen = []

    class Estimator:
        def fit(self, df):
            seen.append(df.count())

    monkeypatch.setattr(modelling, "training_set", lambda *a: (train, train, [], None))
    monkeypatch.setitem(modelling._prepared, (spark.sparkContext.applicationId, "own rows"), (f"own {name}", [], None))
    monkeypatch.setitem(modelling.TREE_MODELS, name, Estimator)
    modelling.fitted(spark, "own rows", name)
    assert seen == [2_500]
