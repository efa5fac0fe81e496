import math

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from tidalframe.operators import dictionary
from tidalframe.operators.preprocessor import ObservationPreprocessor, ObservationPreprocessorModel
from tidalframe.sources.tables import load_model, save_model


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, float(i % 7) if i % 5 else None, 7.0, ["a", "None", None, "b=c"][i % 4], f"site {i % 50:02}", 2000 + i % 6, 1 + i % 12, float(i % 7 > 3)) for i in range(300)]
    return spark.createDataFrame(data, "row_key int, x double, c double, k string, site string, year int, month int, label double")


STAGE = dict(numeric=["x", "c"], categorical=["k", "site"], yearCol="year", monthCol="month")


def test_stored_numbers_prepare_a_second_table(spark, rows, tmp_path):
    path = str(tmp_path / "pre")
    save_model(Pipeline(stages=[ObservationPreprocessor(**STAGE)]).fit(rows), path)
    model = load_model(path)
    assert isinstance(model.stages[0], ObservationPreprocessorModel) and model.stages[0].size() == 5 + 4 + 50
    data = [(1, 9.0, None, "b=c", "site 07", 2030, 3, 0), (2, None, 8.0, None, "unseen", None, None, 1), (3, 4.0, 7.0, "None", "site 49", 2002, 12, 2)]
    new = spark.createDataFrame(data, "row_key int, x double, c double, k string, site string, year int, month int, _ix0 int")
    out = model.transform(new).orderBy("row_key")
    assert out.columns == [*new.columns, "features"]
    known = [float(i % 7) for i in range(300) if i % 5]
    years = [2000 + i % 6 for i in range(300)]
    mean, median = sum(years) / 300, sorted(known)[120]
    std = math.sqrt(sum((y - mean) ** 2 for y in years) / 299)
    span = 4.0
    want = [
        {0: (9 - median) / span, 1: 0.0, 2: 1.0, 3: math.cos(math.pi / 2), 4: (2030 - mean) / std, 5 + 2: 1.0, 9 + 7: 1.0},
        {0: 0.0, 1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0, 5 + 3: 1.0},
        {0: (4 - median) / span, 1: 0.0, 2: math.sin(2 * math.pi), 3: 1.0, 4: (2002 - mean) / std, 5: 1.0, 9 + 49: 1.0},
    ]
    got = [dict(zip(r.features.indices.tolist(), r.features.values.tolist())) for r in out.collect()]
    assert all(r.features.size == 59 for r in out.collect())
    assert [g.keys() for g in got] == [w.keys() for w in want]
    assert all(g[i] == pytest.approx(w[i], abs=1e-12) for g, w in zip(got, want) for i in w)


def test_names_by_position(spark, rows):
    model = ObservationPreprocessor(**STAGE).fit(rows)
    names = [r.name for r in model.feature_names(spark).orderBy("idx").collect()]
    assert names[:9] == ["x", "c", "month_sin", "month_cos", "year_norm", "k_None", "k_a", "k_b=c", "k_None"] and names[9:] == [f"site_site {i:02}" for i in range(50)]


def test_stage_before_a_classifier(spark, rows, tmp_path):
    pipeline = Pipeline(stages=[ObservationPreprocessor(**STAGE), LogisticRegression(maxIter=5)])
    pipeline.write().save(str(tmp_path / "pipeline"))
    model = Pipeline.load(str(tmp_path / "pipeline")).fit(rows)
    save_model(model, str(tmp_path / "model"))
    a, b = (m.transform(rows).orderBy("row_key").select("row_key", F.col("probability")).collect() for m in (model, load_model(str(tmp_path / "model"))))
    assert a == b


def test_odd_tables(spark, rows):
    with pytest.raises(ValueError, match="x"):
        ObservationPreprocessor(numeric=["x"]).fit(rows.where("x IS NULL"))
    nulls = rows.withColumns({"year": F.lit(None).cast("int"), "k": F.lit(None).cast("string")})
    model = ObservationPreprocessor(categorical=["k"], yearCol="year").fit(nulls)
    assert {(tuple(r.features.indices), tuple(r.features.values)) for r in model.transform(nulls).collect()} == {((0, 1), (0.0, 1.0))}
    assert model.transform(nulls.where("false")).count() == 0
    assert ObservationPreprocessor(categorical=["k"]).fit(rows.where("false")).size() == 0


def test_a_column_of_very_many_values(spark):
    """Two hundred thousand values and one that a third of the rows hold, without a list on the driver."""
    df = spark.range(300_000).selectExpr("id", "IF(id % 3 = 0, 'busy', format_string('v%06d', id)) AS v", "CAST(NULL AS STRING) AS n")
    known = dictionary.number_categories(df, ["v", "n"])
    assert dictionary.category_widths(known, ["v", "n", "other"]) == [200_001, 1, 0]
    got = dictionary.add_category_index(df, known, "v", "at").agg(F.min("at"), F.max("at"), F.countDistinct("at"), F.min(F.expr("IF(v = 'busy', at, NULL)")), F.count("at")).first()
    assert tuple(got) == (0, 200_000, 200_001, 0, 300_000)
    order = known.where("column = 'v'").selectExpr("key", "index", "lag(key) OVER (PARTITION BY index DIV 1000 ORDER BY index) AS before")
    assert order.where("before >= key").count() == 0
    model = ObservationPreprocessor(categorical=["v", "n"]).fit(df)
    sizes = model.transform(df.where("id IN (0, 299999)")).orderBy("id").collect()
    assert [(r.features.size, r.features.indices.tolist()) for r in sizes] == [(200_002, [0, 200_001]), (200_002, [200_000, 200_001])]


def test_a_column_of_few_values_beside_one_of_many(spark, rows, monkeypatch):
    """Only the column of many values may shuffle the rows, though both are in one dictionary."""
    monkeypatch.setattr(dictionary, "FEW_VALUES", 10, raising=False)
    model = ObservationPreprocessor(**STAGE).fit(rows)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = model.transform(rows)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("BroadcastHashJoin") == plan.count("SortMergeJoin") == 1


def test_vectors_hold_the_entries_of_every_row(spark):
    """More rows than a batch has, odd numbers and unknown categories; no text on the way."""
    odd = "CASE id % 9 WHEN 0 THEN double('NaN') WHEN 1 THEN double('inf') WHEN 2 THEN double('-inf') WHEN 3 THEN NULL WHEN 4 THEN -0.0D WHEN 5 THEN 1e-300D ELSE id / 7 END AS x"
    df = spark.range(0, 25_000, 1, 1).selectExpr("id", odd, "IF(id % 4 = 0, NULL, CONCAT('k', id % 6)) AS k", "id % 300 AS site")
    fitted = df.selectExpr("double(id % 5 - 2) AS x", "k", "site").where("site < 200 AND k > 'k1'")
    model = ObservationPreprocessor(numeric=["x"], categorical=["k", "site"]).fit(fitted)
    out = model.transform(df)
    assert "from_json" not in out._jdf.queryExecution().optimizedPlan().toString()
    checked = model.entries(out.select("*", F.unwrap_udt("features").alias("v")), "e")
    same = f"v.type = 0 AND v.size = {model.size()} AND v.indices = transform(e, y -> int(y.index)) AND v.values = transform(e, y -> y.value)"
    assert checked.where(same).count() == 25_000
    assert {len(r.indices) for r in checked.selectExpr("v.indices").distinct().collect()} == {1, 2, 3}
    assert math.copysign(1, out.where("id = 4").first().features.values[0]) == -1
