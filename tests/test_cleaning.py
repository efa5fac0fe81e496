import pytest
from pyspark.sql import functions as F

from tidalframe.functions.missing import obs_year, to_numeric
from tidalframe.operators import cleaning, profiling


def test_number_text_edges(spark):
    texts = ["1d", "1F", "1_0", " 1.5 ", ".5e3", "inf", "nd", "", None, "-7", "0x1p3", "1e"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    got = [r[1] for r in df.select("i", to_numeric(F.col("v"))).orderBy("i").collect()]
    assert got == [None, None, None, 1.5, 500.0, float("inf"), None, None, None, -7.0, None, None]


def test_missing_tokens_and_nan(spark):
    df = spark.createDataFrame([("nd", float("nan")), ("nD", 1.0), ("NULL", 2.0), ("kept", None)], "s string, x double")
    assert cleaning.clean_missing(df).collect() == [(None, None), (None, 1.0), (None, 2.0), ("kept", None)]


def test_infer_numeric_needs_every_value(spark):
    df = spark.createDataFrame([("1", "1", None), ("2.5", "src?", None)], "a string, b string, c string")
    assert dict(cleaning.infer_numeric(df).dtypes) == {"a": "double", "b": "string", "c": "double"}


def test_years(spark):
    df = spark.createDataFrame([("2004-02-03",), ("2/3/2005",), ("nd",), ("15-Sep-06",)], "t string")
    assert [r[0] for r in df.select(obs_year(F.col("t"))).collect()] == [2004, 2005, None, 2006]


def test_sparse_limit_is_strict(spark):
    rows = [(1, 1 if i < 7 else None, 1 if i < 6 else None) for i in range(10)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    assert cleaning.sparse_columns(df, 0.30) == ["c"]


def test_drop_columns_checks_names(spark):
    with pytest.raises(ValueError):
        cleaning.drop_columns(spark.range(1), ["absent"])


def test_region_filter_null_is_false(spark):
    df = spark.createDataFrame([("A", "Great Reef"), ("A", None), ("B", "great reef"), ("A", "GREAT reef x")], "country_name string, ecoregion_name string")
    assert cleaning.region_filter(df, "A", "great reef").count() == 2
    assert cleaning.region_filter(df, "A", "great +reef", pattern=True).count() == 2


def test_dedup_nulls_and_nan_are_equal(spark):
    df = spark.createDataFrame([(None, float("nan")), (None, float("nan")), (1, 2.0)], "a int, b double")
    assert cleaning.drop_duplicate_rows(df).count() == 2


def test_union_fills_absent_columns(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3,)], "x int")
    assert cleaning.union_rows(a, b).collect() == [(1, 2), (3, None)]


def test_null_summary_of_empty_column(spark):
    df = spark.createDataFrame([(None, "a"), (None, None)], "x double, k string")
    got = {r["column"]: (r["null_count"], r["null_percent"]) for r in profiling.null_summary(df).collect()}
    assert got == {"x": (2, 100.0), "k": (1, 50.0)}


def test_histogram_closes_last_bin_and_takes_constants(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 3)], "x double")
    assert [r["n"] for r in profiling.histogram(df, "x", 3).orderBy("bin").collect()] == [1, 1, 2]
    same = spark.createDataFrame([(7.0,)] * 4, "x double")
    assert sum(r["n"] for r in profiling.histogram(same, "x", 5).collect()) == 4


def test_missing_by_group_counts_each_group(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 1.0), ("b", 1, None), (None, 1, 1.0)], "g string, h int, x double")
    got = {(r.group_column, r.group_value): (r.n_rows, r.missing_share) for r in profiling.missing_by_group(df, ["g", "h"], ["x"]).collect()}
    assert got == {("g", "a"): (2, 0.5), ("g", "b"): (1, 1.0), ("h", "1"): (3, 2 / 3), ("h", "2"): (1, 0.0)}
