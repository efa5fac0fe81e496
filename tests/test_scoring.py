import json
import math

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidalframe.operators import enrich, scoring
from tidalframe.operators.features import fit_preprocessor
from tidalframe.operators.models import as_vector, logistic_l2, transfer_head
from tidalframe.sources.tables import load_model, save_model
from tidalframe.streaming.requests import move_clock, score_stream

MODES = (scoring.FUSION, scoring.IMAGE_ONLY, scoring.TABULAR_ONLY, scoring.MANUAL, "other")


FIELDS = {"a": "double", "t": "string"}


def test_parse_keeps_types_and_bad_payloads_apart(spark):
    texts = [
        '{"prediction_type": "Tabular-Only", "tabular_data": {"a": 1, "t": "it\'s \\"x\\"", "n": null, "l": [1, {"b": true}]}}', "{oops", None, '{"tabular_data": {}}', "[1]", "3", '{"tabular_data": {"a": "2.5", "t": 7}} ',
        '{"a": 1} x', '{"a": 1}, {"b": 2}', "", '{"prediction_type": 5, "tabular_data": [1]}', '{"tabular_data": {"a": "far", "t": null}}',
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "request_id int, payload string")
    parsed = scoring.parse_requests(df)
    typed = scoring.typed_fields(parsed, "tabular_data", FIELDS)
    got = parsed.select("prediction_type", F.to_json("tabular_data").alias("data"), typed["a"].alias("a"), typed["t"].alias("t"), "error").collect()
    bad = (None, None, None, None, scoring.BAD_JSON)
    first = '{"a":1,"l":[1,{"b":true}],"n":null,"t":"it\'s \\"x\\""}'
    assert [tuple(r) for r in got] == [
        ("Tabular-Only", first, 1.0, 'it\'s "x"', None), bad, bad, (None, "{}", None, None, None), bad, bad, (None, '{"a":"2.5","t":7}', 2.5, "7", None),
        bad, bad, bad, ("5", None, None, None, None), (None, '{"a":"far","t":null}', None, None, None),
    ]
    numbers = spark.createDataFrame([({"a": 1.0},)], "tabular_data map<string,double>")
    assert tuple(numbers.select(*scoring.typed_fields(numbers, "tabular_data", FIELDS).values()).first()) == (1.0, None)


def test_mode_rules(spark):
    rows = [(m, t, d) for m in MODES for t in (None, "image/png", "text/plain") for d in ({}, {"a": 1.0})]
    df = spark.createDataFrame(rows, "prediction_type string, content_type string, tabular_data map<string,double>")

    def rule(mode, kind, data):
        if mode == scoring.FUSION and not kind:
            return scoring.FUSION_NEEDS_IMAGE
        if mode == scoring.FUSION and not data:
            return scoring.FUSION_NEEDS_DATA
        if mode in (scoring.TABULAR_ONLY, scoring.MANUAL) and not data:
            return scoring.NEEDS_DATA
        if mode == scoring.IMAGE_ONLY and not kind:
            return scoring.NEEDS_IMAGE
        return scoring.NOT_AN_IMAGE if kind and not kind.startswith("image/") else None

    for r in scoring.validate_mode(df).collect():
        assert r.error == rule(r.prediction_type, r.content_type, r.tabular_data)


def test_fusion_rules(spark):
    rows = [(m, i, t) for m in MODES for i in (None, 0.4) for t in (None, 0.0, 0.201)]
    df = spark.createDataFrame(rows, "m string, i double, t double")
    for r in df.withColumn("risk", scoring.fuse(F.col("i"), F.col("t"), F.col("m"))).collect():
        if r.m == scoring.FUSION:
            want = None if r.i is None or r.t is None else pytest.approx(round((r.i + r.t) / 2 + 1e-9, 3))
        elif r.m == scoring.IMAGE_ONLY:
            want = r.i
        elif r.m in (scoring.TABULAR_ONLY, scoring.MANUAL):
            want = r.t
        else:
            want = r.t or (r.i if r.i is not None else r.t)
        assert r.risk == want


def test_required_fields_order(spark):
    df = spark.createDataFrame([({k: 1.0 for k in scoring.REQUIRED[2:]},), (None,)], "tabular_data map<string,double>")
    assert [r.missing for r in scoring.required_fields(df).collect()] == [list(scoring.REQUIRED[:2]), list(scoring.REQUIRED)]


def test_overrides_before_fetched_before_default(spark):
    req = spark.createDataFrame([(1,), (2,)], "id int")
    fetched = spark.createDataFrame([(1, 27.0, 301.0)], "id int, ClimSST double, Temperature_Kelvin double")
    user = spark.createDataFrame([(1, None, 3.0)], "id int, ClimSST double, Depth_m double")
    got = {r.id: r for r in enrich.apply_overrides(req, fetched, user, "id").collect()}
    assert (got[1].ClimSST, got[1].Temperature_Kelvin, got[1].Depth_m, got[1].Windspeed) == (27.0, 301.0, 3.0, 5.0)
    assert (got[2].ClimSST, got[2].Depth_m) == (26.0, 15.0)


def test_grid_lookup_takes_last_row_of_a_cell(spark):
    points = spark.createDataFrame([(1, "d", -89.96, -179.93), (2, "d", 10.0, 10.0)], "point_id int, grid_date string, lat double, lon double")
    grid = spark.createDataFrame([("d", 0, 1, 1, 20.0), ("d", 0, 1, 2, 21.0)], "grid_date string, iy bigint, ix bigint, seq int, sst double")
    got = {r.point_id: r.sst for r in enrich.grid_lookup(points, grid, unit="C", order=("seq",)).collect()}
    assert got == {1: pytest.approx(294.15), 2: None}


def sigmoid(z):
    return 1 / (1 + math.exp(-z))


@pytest.fixture
def models(tmp_path):
    """A tabular and an image model, as a job gets them from a folder."""
    tabular = scoring.linear_pipeline({"a": 0.5}, -1.0, {"a": 4.0}, {"t": {"it's": 1.0, "back\\slash": 2.0}})
    for name, model in (("tabular", tabular), ("image", scoring.linear_image_pipeline([1.0, -2.0], 0.5))):
        save_model(model, str(tmp_path / name))
    return load_model(str(tmp_path / "tabular")), load_model(str(tmp_path / "image"))


def payload(mode, **data):
    return json.dumps({"prediction_type": mode, "tabular_data": data})


def test_job_scores_with_its_models(spark, models):
    rows = [
        (1, payload(scoring.FUSION, a=2, t="it's"), "image/png"), (2, payload(scoring.FUSION, a=2), None), (3, "x", None), (4, payload(scoring.TABULAR_ONLY, t="back\\slash"), None),
        (5, payload(scoring.IMAGE_ONLY), "image/jpeg"), (6, payload(scoring.MANUAL, a=None), "text/plain"), (7, payload(scoring.IMAGE_ONLY), "image/png"), (8, payload("other", a=1), "image/png"),
    ]
    req = spark.createDataFrame(rows, "request_id int, payload string, content_type string").selectExpr("*", "1 AS a", "'c' AS probability", "2 AS missing")
    images = spark.createDataFrame([(1, [1.0, 0.5]), (5, [0.0, 1.0]), (8, [2.0, 0.0])], "request_id int, image array<double>")
    got = {r.request_id: r for r in scoring.predict_job(req, *models, images=images, fields=FIELDS).collect()}
    fused = round((sigmoid(-1 + 1 + 1) + 1 - sigmoid(0.5 + 1 - 1)) / 2, 3)
    assert (got[1].risk, got[1].risk_level) == (fused, "Moderate Risk") and got[1].probability == "c"
    response = json.loads(got[1].response)
    assert response["predicted_bleaching_risk"] == fused and response["tabular_data_used"] == {"a": 2, "t": "it's"} and response["image_processed"]
    assert {i: got[i].error for i in got} == {1: None, 2: scoring.FUSION_NEEDS_IMAGE, 3: scoring.BAD_JSON, 4: None, 5: None, 6: scoring.NOT_AN_IMAGE, 7: scoring.IMAGE_CONTENT_MISSING, 8: None}
    assert got[4].risk == pytest.approx(sigmoid(-1 + 2 + 2)) and got[5].risk == pytest.approx(1 - sigmoid(0.5 - 2)) and got[8].risk == pytest.approx(sigmoid(-0.5))
    assert all(got[i].response is None and got[i].risk is None for i in (2, 3, 6, 7))


def test_looked_up_values_lie_below_sent_ones(spark, models):
    rows = [(1, payload(scoring.TABULAR_ONLY, a=None, t="x")), (2, payload(scoring.TABULAR_ONLY)), (3, payload(scoring.IMAGE_ONLY)), (4, "{"), (5, payload(scoring.MANUAL, a=6)), (6, payload(scoring.MANUAL))]
    parsed = scoring.parse_requests(spark.createDataFrame(rows, "request_id int, payload string"))
    background = spark.createDataFrame([(i, {"a": 9.0, "b": 1.5}) for i in range(1, 6)], "request_id int, values map<string,double>")
    got = {r.request_id: r.data and json.loads(r.data) for r in scoring.merge_data(parsed, background).select("request_id", F.to_json("tabular_data").alias("data")).collect()}
    assert got == {1: {"a": None, "b": 1.5, "t": "x"}, 2: {"a": 9, "b": 1.5}, 3: {}, 4: None, 5: {"a": 6, "b": 1.5}, 6: {}}


def test_tabular_job_imputes_null_features(spark, models):
    rows = [(1, {"a": 2.0}), (2, {"a": None}), (3, {}), (4, None), (5, {"b": 1.0})]
    df = spark.createDataFrame(rows, "request_id int, tabular_data map<string,double>")
    got = {r.request_id: r for r in scoring.predict_tabular_job(df, models[0], fields=FIELDS, required=("a",)).collect()}
    assert got[1].probability_bleached == 0.5 and got[2].probability_bleached == pytest.approx(sigmoid(1))
    assert [got[i].error for i in (3, 4, 5)] == [scoring.NEEDS_DATA, scoring.NEEDS_DATA, scoring.NEEDS_FEATURES + "['a']"]
    assert all(got[i].probability_bleached is None for i in (3, 4, 5))


def test_job_takes_fitted_pipelines(spark):
    """A preprocessor with a classifier, and a classifier on vectors, both fitted here."""
    table = spark.createDataFrame([(float(i), "x" if i % 3 else "y", float(i > 20)) for i in range(40)], "a double, t string, label double")
    pre = fit_preprocessor(table, ["a"], ["t"], keep=None)
    tabular = PipelineModel(stages=[*pre.stages, logistic_l2(40).fit(pre.transform(table))])
    vectors = as_vector(spark.createDataFrame([([float(i), 1.0], float(i > 5)) for i in range(12)], "v array<double>, label double"), "v")
    image = transfer_head().fit(vectors)
    rows = [(1, payload(scoring.FUSION, a=30, t="x"), "image/png", [9.0, 1.0]), (2, payload(scoring.TABULAR_ONLY, t="unseen"), None, None)]
    req = spark.createDataFrame(rows, "request_id int, payload string, content_type string, image array<double>")
    got = {r.request_id: r for r in scoring.predict_job(req, tabular, image, fields=FIELDS, image_width=2).collect()}
    plain = spark.createDataFrame([(30.0, "x"), (None, "unseen")], "a double, t string")
    p = [r[0] for r in tabular.transform(plain).select(vector_to_array("probability")[1]).collect()]
    q = image.transform(as_vector(spark.createDataFrame([([9.0, 1.0],)], "v array<double>"), "v")).select(vector_to_array("probability")[1]).first()[0]
    assert (got[1].tabular_score, got[1].image_score) == (pytest.approx(p[0]), pytest.approx(1 - q))
    assert got[2].risk == pytest.approx(p[1]) and got[2].image_score is None


def test_stream_waits_for_images_and_goes_on_where_it_ended(spark, tmp_path, models):
    folders = {name: tmp_path / name for name in ("asked", "sent")}
    for f in folders.values():
        f.mkdir()
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def put(folder, name, *lines):
        (folders[folder] / f"{name}.json").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))

    def ask(i, minute, mode, kind=None, **data):
        return {"request_id": i, "sent": f"2024-05-01T10:{minute:02}:00Z", "content_type": kind, "payload": payload(mode, **data)}

    def image(i, minute, *numbers):
        return {"request_id": i, "sent": f"2024-05-01T10:{minute:02}:00Z", "image": numbers}

    def run():
        score_stream(spark, str(folders["asked"]), str(folders["sent"]), out, state, *models, fields=FIELDS).awaitTermination()
        return {r.request_id: (r.outcome, r.risk, r.error) for r in spark.read.parquet(out).collect()}

    put("asked", 0, "")
    put("sent", 0, image(2, 1, 0.0, 1.0), "{broken")
    put("asked", 1, ask(1, 0, scoring.TABULAR_ONLY, a=2), "{broken", ask(2, 0, scoring.IMAGE_ONLY, "image/png"), ask(3, 0, scoring.IMAGE_ONLY, "image/png"), ask(4, 0, scoring.FUSION, a=2), ask(5, 0, scoring.IMAGE_ONLY, "image/png"))
    done = {
        1: ("accepted", 0.5, None), 2: ("accepted", pytest.approx(1 - sigmoid(-1.5)), None), 4: ("rejected", None, scoring.FUSION_NEEDS_IMAGE), None: ("rejected", None, scoring.BAD_JSON),
    }
    assert run() == done  # 3 and 5 wait in the state
    put("sent", 2, image(3, 8, 2.0, 0.0))
    put("asked", 2, ask(6, 9, scoring.MANUAL, t="it's"))
    done |= {3: ("accepted", pytest.approx(1 - sigmoid(2.5)), None), 6: ("accepted", pytest.approx(sigmoid(2)), None)}
    assert run() == done
    for _ in range(2):
        move_clock(spark, str(folders["asked"]), str(folders["sent"]), "2024-05-02 00:00:00")
        last = run()
    assert last == done | {5: ("rejected", None, scoring.IMAGE_CONTENT_MISSING)}
    put("asked", 3, ask(7, 0, scoring.MANUAL, a=4))  # needs no image, so it cannot be too late
    assert run()[7] == ("accepted", pytest.approx(sigmoid(1)), None)
