import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidalframe.operators import ordering


@pytest.fixture(scope="module")
def numbers():
    """A third of the rows share one value; nulls in two columns."""
    rng = np.random.default_rng(7)
    n = 3000
    x = np.round(rng.normal(size=n), 2)
    x[: n // 3] = 0.25
    y = x * 2 + rng.normal(size=n)
    z = np.round(rng.exponential(size=n), 1)
    pdf = pd.DataFrame({"x": x, "y": y, "z": z})
    pdf.loc[rng.random(n) < 0.2, "y"] = None
    pdf.loc[rng.random(n) < 0.1, "z"] = None
    return pdf


@pytest.fixture(scope="module")
def table(spark, numbers):
    rows = [tuple(None if pd.isna(v) else float(v) for v in r) for r in numbers.itertuples(index=False)]
    return spark.createDataFrame(rows, "x double, y double, z double")


@pytest.mark.parametrize("buckets", [2, 16])
def test_average_rank_like_pandas(table, numbers, buckets):
    got = ordering.average_rank(table.select("z"), "z", "r", buckets).toPandas().sort_values(["z", "r"])
    want = numbers[["z"]].assign(r=numbers["z"].rank()).sort_values(["z", "r"])
    assert np.allclose(got["r"].to_numpy(), want["r"].to_numpy(), equal_nan=True)


def test_percentiles_like_numpy(table, numbers):
    got = {r["stat"]: r for r in ordering.exact_percentiles(table, ["x", "y", "z"], (0.0, 0.1, 0.5, 0.99, 1.0)).collect()}
    for c in numbers:
        want = np.nanpercentile(numbers[c], [0, 10, 50, 99, 100])
        assert np.allclose([got[c][f"p{i}"] for i in range(5)], want)


def test_spearman_like_pandas(table, numbers):
    got = {(r.col_a, r.col_b): r.rho for r in ordering.spearman_matrix(table, ["x", "y", "z"]).collect()}
    want = numbers.corr(method="spearman").abs()
    assert len(got) == 9
    for a in numbers:
        for b in numbers:
            assert got[a, b] == pytest.approx(want.loc[a, b], abs=1e-12)


def test_spearman_of_empty_and_constant_columns(spark):
    df = spark.createDataFrame([(1.0, None, 5.0), (2.0, None, 5.0), (3.0, None, 5.0)], "x double, e double, c double")
    got = {(r.col_a, r.col_b): r.rho for r in ordering.spearman_matrix(df, ["x", "e", "c"]).collect()}
    assert got["x", "x"] == pytest.approx(1.0)
    assert got["x", "e"] is None and got["e", "e"] is None
    assert got["x", "c"] is None or np.isnan(got["x", "c"])


def test_describe_edges(spark):
    df = spark.createDataFrame([(7.0, None), (7.0, None), (7.0, None), (9.0, None)], "x double, e double")
    got = {r["column"]: r for r in ordering.describe_exact(df, ["x", "e"]).collect()}
    assert (got["x"]["count"], got["x"]["p25"], got["x"]["p75"], got["x"]["max"]) == (4, 7.0, 7.5, 9.0)
    assert got["e"]["count"] == 0 and got["e"]["p50"] is None


def test_auc_against_pairs(spark):
    rng = np.random.default_rng(3)
    y, p = rng.integers(0, 2, 400), np.round(rng.random(400), 1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "label int, p double")
    pos, neg = p[y == 1], p[y == 0]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert ordering.roc_auc(df, "label", "p").first()[0] == pytest.approx(want)
    assert ordering.roc_auc(df.where("label = 0"), "label", "p").first()[0] is None


def test_quantile_plot(spark):
    from statistics import NormalDist

    df = spark.createDataFrame([(float(v),) for v in (3, 1, 2, 2, 5)], "x double")
    got = ordering.normal_qq(df, "x").orderBy("position").collect()
    assert [r.observed for r in got] == [1, 2, 2, 3, 5]
    places = [1 - 0.5 ** 0.2, (2 - 0.3175) / 5.365, (3 - 0.3175) / 5.365, (4 - 0.3175) / 5.365, 0.5 ** 0.2]
    assert np.allclose([r.theoretical for r in got], [NormalDist().inv_cdf(p) for p in places], atol=1e-8)


def test_copies_of_a_large_group_are_split(spark):
    ranked = spark.createDataFrame([(1.0, 10, 0, 13), (2.0, 3, 10, 13)], "v double, n bigint, n_before bigint, n_total bigint")
    got = ordering.expand_copies(ranked, chunk=4).orderBy("position").collect()
    assert [(r.v, r.position) for r in got] == [(1.0, i) for i in range(1, 11)] + [(2.0, i) for i in range(11, 14)]


def test_bucket_is_monotone(spark):
    bounds = [-1.0, 0.0, 0.5, 2.0, 9.0]
    df = spark.createDataFrame([(float(v),) for v in (-5, -1, -0.5, 0, 0.1, 0.5, 1, 2, 3, 9, 10)], "v double")
    got = [r[0] for r in df.select(ordering.range_bucket(F.col("v"), bounds)).collect()]
    assert got == [sum(b < v for b in bounds) for v in (-5, -1, -0.5, 0, 0.1, 0.5, 1, 2, 3, 9, 10)]


def test_no_single_partition_sort_of_data(table):
    plan = ordering.average_rank(table, "x")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("kind", ["uniform", "ties", "skewed", "few"])
def test_sketch_and_refine_equals_exact_order(spark, kind):
    rng = np.random.default_rng(3)
    n = 9 if kind == "few" else 60_000
    x = {"uniform": rng.random(n), "ties": rng.integers(0, 7, n).astype(float), "skewed": np.where(rng.random(n) < 0.4, 0.0, rng.exponential(size=n) ** 9), "few": rng.random(n)}[kind]
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": -x})).selectExpr("IF(rand(1) < 0.0, NULL, x) AS x", "y", "CAST(NULL AS DOUBLE) AS z").repartition(7)
    wanted = (0.0, 0.001, 0.25, 0.5, 0.501, 0.75, 1.0)
    got = {r["stat"]: [r[f"p{i}"] for i in range(len(wanted))] for r in ordering.exact_percentiles(df, ["x", "y", "z"], wanted).collect()}
    assert set(got) == {"x", "y"}
    assert got["x"] == pytest.approx(np.quantile(x, wanted), rel=1e-12) and got["y"] == pytest.approx(np.quantile(-x, wanted), rel=1e-12)


def test_percentiles_order_few_values_and_read_the_source_twice(spark, tmp_path):
    path = str(tmp_path / "x")
    spark.range(200_000).selectExpr("(id * 7919) % 200003 / 3.0 AS x").write.parquet(path)
    df = spark.read.parquet(path)
    sketch = df.agg(ordering.percentile_sketch("x", (0.25, 0.5, 0.75))).first()[0]
    refine = ordering.percentiles_between(df, {"x": sketch}, (0.25, 0.5, 0.75))
    low, high = zip(*ordering._intervals(sketch))
    assert df.where(" OR ".join(f"x BETWEEN {a} AND {b}" for a, b in zip(low, high))).count() < 0.01 * 200_000
    assert len(refine.collect()) == 1
    final = refine._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1 and "ReusedExchange" in final  # one more pass was the sketch


def test_a_wrong_sketch_is_never_a_wrong_result(spark):
    df = spark.range(1000).selectExpr("CAST(id AS DOUBLE) AS x")
    with pytest.raises(Exception, match="sketch"):
        ordering.percentiles_between(df, {"x": (100_000, [10.0, 20.0] * 5)}, (0.5,)).collect()


def test_the_column_of_most_values_meets_its_ranks_first(spark, capsys):
    """Its join may shuffle the rows, which then carry no ranks of other columns yet."""
    df = spark.range(400).selectExpr("double(id % 3) AS few", "double(id % 40) AS some", "double(id * 7 % 400) AS most")
    matrix = ordering.spearman_matrix(df, ["few", "some", "most"])
    matrix.explain(True)
    plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    joins = [line for line in plan.splitlines() if "Join LeftOuter" in line]
    assert [next(c for c in ("few", "some", "most") if f"{c}#" in line) for line in joins] == ["few", "some", "most"]
    assert matrix.count() == 9
