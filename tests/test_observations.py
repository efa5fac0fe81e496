"""Observations of own small tables: joined once for all passes, in the order that suits many orders too."""

import datetime

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors

from tidalframe.operators import selection
from tidalframe.plans import catalog, standins


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    day = datetime.datetime(1995, 3, 1)
    tables = {
        "region": ([(0, "ASIA"), (1, "EUROPE"), (1, "EUROPE")], "r_regionkey bigint, r_name string"),
        "nation": ([(i, f"N{i}", i % 3 if i % 3 < 2 else None) for i in range(6)], "n_nationkey bigint, n_name string, n_regionkey bigint"),
        "customer": ([(i, i % 7) for i in range(12)] + [(None, 1), (3, 2)], "c_custkey bigint, c_nationkey bigint"),
        "orders": ([(i, i % 13, day + datetime.timedelta(i * 40), f"{i % 5}-P") for i in range(40)] + [(5, None, day, None), (6, 1, None, "x")], "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp, o_orderpriority string"),
        "lineitem": ([(i % 45, i % 4, i * 7 % 60, i * 3 % 40, float(i % 50), i * 11.5, (i % 10) / 100, (i % 8) / 100) for i in range(300)] + [(None, 1, 2, 3, 4.0, 5.0, 0.1, 0.2)],
                     "l_orderkey bigint, l_linenumber bigint, l_partkey bigint, l_suppkey bigint, l_quantity double, l_extendedprice double, l_discount double, l_tax double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    return d


def test_sites_first_gives_the_same_rows(spark, folder, monkeypatch):
    want = sorted(map(str, standins._raw(spark, folder).collect()))
    monkeypatch.setattr(standins, "MANY_ORDERS", 0)
    got = standins._raw(spark, folder)
    assert sorted(map(str, got.collect())) == want and len(want) > 100


@pytest.mark.parametrize("name", ["m1_impute_median", "m2_robust_scale", "m4_fit_preprocessor", "m21_pca_reduce", "a10_describe_exact"])
def test_passes_read_the_joined_table(spark, folder, name):
    catalog.load_all()
    out = catalog.QUERIES[name](spark, folder)
    assert out.count() > 0 and not [f for f in out.inputFiles() if "lineitem" in f]


def test_equal_choices_of_features_are_fitted_once(spark):
    rows = spark.createDataFrame([(str(i), Vectors.dense([float(i % 5), float(i % 3)]), float(i % 5 > 2)) for i in range(60)], ["row_key", "features", "label"])
    ranking = spark.createDataFrame([(0, "a", 2.0), (1, "b", 1.0)], "idx int, name string, importance double")
    made = []
    out = selection.sweep_top_k(rows, rows, ranking, lambda: made.append(1) or LogisticRegression(maxIter=20), ks=(50, 30, 2, 1))
    assert [r.k for r in out.orderBy("seq").collect()] == [50, 30, 2, 1] and len(made) == 2
