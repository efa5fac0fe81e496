"""Queries on requests: parsing, validation, scoring, fusion, responses and the stream."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidalframe.operators import scoring
from tidalframe.plans.catalog import query
from tidalframe.plans.standins import OBS_CTE, PAYLOADS_CTE, REQUESTS_CTE, images, obs, payloads, r6, requests
from tidalframe.session import scratch_path
from tidalframe.sources.tables import load_model, save_model
from tidalframe.streaming.requests import move_clock, score_stream

# What the checking engine sees after parsing: broken text and what is no object has no fields.
_PARSED = PAYLOADS_CTE + f""", read AS (SELECT *, CASE WHEN json_valid(payload) THEN json_type(payload) = 'OBJECT' ELSE false END AS good FROM payloads),
parsed AS (SELECT request_id, CASE WHEN good THEN json_extract_string(payload, '$.prediction_type') END AS prediction_type,
 CASE WHEN good THEN nullif(json_extract(payload, '$.tabular_data'), 'null') END AS data,
 CASE WHEN good THEN TRY_CAST(json_extract_string(payload, '$.tabular_data.k') AS DOUBLE) END AS k,
 CASE WHEN good THEN json_extract_string(payload, '$.tabular_data.Realm_Name') END AS realm,
 CASE WHEN NOT good THEN '{scoring.BAD_JSON}' END AS bad, content_type, image FROM read LEFT JOIN images USING (request_id))"""


@query("s7_parse_requests", f"WITH {_PARSED} SELECT request_id, prediction_type, k, realm, bad AS error FROM parsed")
def _(spark: SparkSession, d: str) -> DataFrame:
    parsed = scoring.parse_requests(payloads(spark, d))
    typed = scoring.typed_fields(parsed, "tabular_data", {"k": "double", "Realm_Name": "string"})
    return parsed.select("request_id", "prediction_type", typed["k"].alias("k"), typed["Realm_Name"].alias("realm"), "error")


# Feature values of a tabular request per observation; every tenth lacks two of them.
_FIELDS = {
    "Distance_to_Shore": "distance_to_shore", "Turbidity": "coalesce(turbidity, 0.05)", "Cyclone_Frequency": "0.1",
    "Depth_m": "coalesce(depth_m, 15.0)", "ClimSST": "26.0", "Temperature_Kelvin": "300.0",
    "Temperature_Kelvin_Standard_Deviation": "1.5", "Windspeed": "5.0",
}
WEIGHTS = {"Distance_to_Shore": -0.02, "Turbidity": 4.0, "Depth_m": 0.05, "Windspeed": -0.1}
INTERCEPT = -0.25


def _tabular_requests(spark: SparkSession, d: str) -> DataFrame:
    """(obs_no, site_id, tabular_data): the map a client would send, empty for one site in nine, short for one in ten."""
    pairs = ", ".join(f"'{name}', CAST({text} AS DOUBLE)" for name, text in _FIELDS.items())
    short = ", ".join(f"'{name}', CAST({text} AS DOUBLE)" for name, text in _FIELDS.items() if name not in ("Depth_m", "Windspeed"))
    base = obs(spark, d).select("obs_no", "site_id", "distance_to_shore", "turbidity", "depth_m")
    data = F.expr(f"CASE WHEN site_id % 9 = 0 THEN CAST(map() AS MAP<STRING, DOUBLE>) WHEN site_id % 10 = 0 THEN map({short}) ELSE map({pairs}) END")
    return base.select("obs_no", "site_id", data.alias("tabular_data"))


_ALL = ", ".join(scoring.REQUIRED)


@query("p8_required_fields", f"WITH {OBS_CTE} SELECT obs_no, site_id, CASE WHEN site_id % 9 = 0 THEN '{_ALL}' WHEN site_id % 10 = 0 THEN 'Depth_m, Windspeed' ELSE '' END AS missing FROM obs")
def _(spark: SparkSession, d: str) -> DataFrame:
    found = scoring.required_fields(_tabular_requests(spark, d))
    return found.select("obs_no", "site_id", F.array_join("missing", ", ").alias("missing"))


_MODE_RULES = """CASE WHEN prediction_type = 'Multi-Modal Fusion (Image + Data)' AND content_type IS NULL THEN 'Fusion requires an image.'
 WHEN prediction_type = 'Multi-Modal Fusion (Image + Data)' AND {no_data} THEN 'Fusion requires tabular data.'
 WHEN prediction_type IN ('Tabular-Only', 'Manual Data Entry Only (No NOAA Pull)') AND {no_data} THEN 'Tabular data is required.'
 WHEN prediction_type = 'Image-Only (VGG Augmented)' AND content_type IS NULL THEN 'Image-only prediction requires an image file.'
 WHEN content_type IS NOT NULL AND NOT starts_with(content_type, 'image/') THEN 'File must be an image' END"""


@query("p9_validate_mode", f"WITH {REQUESTS_CTE} SELECT request_id, prediction_type, {_MODE_RULES.format(no_data='tabular_json IS NULL')} AS error FROM requests")
def _(spark: SparkSession, d: str) -> DataFrame:
    return scoring.validate_mode(requests(spark, d), data="tabular_json").select("request_id", "prediction_type", "error")


@query("p10_is_image", f"WITH {PAYLOADS_CTE} SELECT request_id, coalesce(starts_with(content_type, 'image/'), false) AS is_image FROM payloads")
def _(spark: SparkSession, d: str) -> DataFrame:
    return payloads(spark, d).select("request_id", scoring.is_image(F.col("content_type")).alias("is_image"))


_FUSE = """CASE prediction_type WHEN 'Multi-Modal Fusion (Image + Data)' THEN round((image_score + tabular_score) / 2, 3)
 WHEN 'Image-Only (VGG Augmented)' THEN image_score WHEN 'Tabular-Only' THEN tabular_score
 WHEN 'Manual Data Entry Only (No NOAA Pull)' THEN tabular_score ELSE coalesce(nullif(tabular_score, 0), image_score, tabular_score) END"""


@query("r4_fuse", f"WITH {REQUESTS_CTE} SELECT request_id, round({_FUSE}, 6) AS risk FROM requests")
def _(spark: SparkSession, d: str) -> DataFrame:
    risk = scoring.fuse(F.col("image_score"), F.col("tabular_score"), F.col("prediction_type"))
    return requests(spark, d).select("request_id", F.round(risk, 6).alias("risk"))


_LINEAR = f"1 / (1 + exp(-({INTERCEPT} + distance_to_shore * -0.02 + coalesce(turbidity, 0.05) * 4.0 + coalesce(depth_m, 15.0) * 0.05 + 5.0 * -0.1)))"


@query("m18_score_linear", f"WITH {OBS_CTE}, s AS (SELECT obs_no, site_id, {_LINEAR} AS p FROM obs) SELECT obs_no, site_id, CASE WHEN p >= 0.5 THEN 'Bleached' ELSE 'Unbleached' END AS predicted_class, round(p, 6) AS probability_bleached, round(1 - p, 6) AS probability_unbleached FROM s")
def _(spark: SparkSession, d: str) -> DataFrame:
    values = {name: F.expr(f"CAST({text} AS DOUBLE)") for name, text in _FIELDS.items()}
    prepared = obs(spark, d).select("obs_no", "site_id", *[values[c].alias(c) for c in WEIGHTS])
    scored = scoring.score_linear(prepared, WEIGHTS, INTERCEPT, ["obs_no", "site_id"])
    return scored.select("obs_no", "site_id", "predicted_class", r6("probability_bleached"), r6("probability_unbleached"))


def _stored(spark: SparkSession, model: PipelineModel) -> PipelineModel:
    """The model as a job gets it: from a folder."""
    path = scratch_path(spark, "scoring-model")
    save_model(model, path)
    return load_model(path)


@query("r1_predict_tabular_job", f"""WITH {OBS_CTE}, s AS (SELECT obs_no, CASE WHEN site_id % 9 = 0 THEN 'Tabular data is required.'
 WHEN site_id % 10 = 0 THEN 'Missing required tabular features: [''Depth_m'', ''Windspeed'']' END AS error, {_LINEAR} AS p FROM obs)
SELECT obs_no, error, CASE WHEN error IS NOT NULL THEN NULL WHEN p >= 0.5 THEN 'Bleached' ELSE 'Unbleached' END AS predicted_class,
 CASE WHEN error IS NULL THEN round(p, 6) END AS probability_bleached, CASE WHEN error IS NULL THEN round(1 - p, 6) END AS probability_unbleached FROM s""")
def _(spark: SparkSession, d: str) -> DataFrame:
    model = _stored(spark, scoring.linear_pipeline(WEIGHTS, INTERCEPT))
    scored = scoring.predict_tabular_job(_tabular_requests(spark, d), model, key="obs_no")
    return scored.select("obs_no", "error", "predicted_class", r6("probability_bleached"), r6("probability_unbleached"))


# The models of the universal job: numbers and a text, and the numbers of an image.
_JOB_FIELDS = {"k": "double", "Realm_Name": "string"}
_REALMS = {"Central Indo-Pacific, west": 0.75, "Tethys": -0.5}
_IMAGE_WEIGHTS = [((i * 5) % 9 - 4) / 2 for i in range(64)]


def _models(spark: SparkSession) -> tuple[PipelineModel, PipelineModel]:
    tabular = scoring.linear_pipeline({"k": 0.05}, -2.5, {"k": 20.0}, {"Realm_Name": _REALMS})
    return _stored(spark, tabular), _stored(spark, scoring.linear_image_pipeline(_IMAGE_WEIGHTS, 0.25))


_REALM_SQL = " ".join(f"WHEN '{v}' THEN {w}" for v, w in _REALMS.items())


def _done(k: str = "k", data: str = "data", lost: str = "image IS NULL") -> str:
    """Error, scores and risk of every parsed request."""
    return f"""{_PARSED}, known AS (SELECT *, {k} AS used_k, {data} AS used, starts_with(content_type, 'image/') AS named FROM parsed),
checked AS (SELECT *, coalesce(bad, {_MODE_RULES.format(no_data="used IS NULL")}, CASE WHEN named AND ({lost}) THEN '{scoring.IMAGE_CONTENT_MISSING.replace("'", "''")}' END) AS error FROM known),
scored AS (SELECT *, CASE WHEN error IS NULL AND used IS NOT NULL THEN 1 / (1 + exp(-(-2.5 + coalesce(used_k, 20.0) * 0.05 + CASE realm {_REALM_SQL} ELSE 0 END))) END AS tabular_score,
 CASE WHEN error IS NULL AND named THEN 1 - 1 / (1 + exp(-(0.25 + list_dot_product(image::DOUBLE[], {_IMAGE_WEIGHTS}::DOUBLE[])))) END AS image_score FROM checked),
done AS (SELECT *, CASE WHEN error IS NULL THEN {_FUSE} END AS risk FROM scored)"""


_JOB_SQL = """SELECT request_id, error, round(tabular_score, 6) AS tabular_score, round(image_score, 6) AS image_score, round(risk, 6) AS risk,
 CASE WHEN risk * 100 > 70 THEN 'High Risk' WHEN risk * 100 > 40 THEN 'Moderate Risk' WHEN risk IS NOT NULL THEN 'Low Risk' END AS risk_level FROM done"""
_LOOKED_UP = "request_id % 2 = 0 AND bad IS NULL AND prediction_type IS DISTINCT FROM 'Image-Only (VGG Augmented)'"


@query("r3_predict_job", f"""WITH {_done(f"coalesce(k, CASE WHEN {_LOOKED_UP} THEN request_id % 90 END)", f"coalesce(data, CASE WHEN {_LOOKED_UP} THEN '1' END)")} {_JOB_SQL}""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Half of the requests have looked-up values, which the sent ones override."""
    p = payloads(spark, d)
    background = p.where("request_id % 2 = 0").selectExpr("request_id", "map('k', CAST(request_id % 90 AS DOUBLE)) AS values")
    done = scoring.predict_job(p, *_models(spark), images=images(spark, d).drop("sent"), background=background, fields=_JOB_FIELDS)
    return done.select("request_id", "error", r6("tabular_score"), r6("image_score"), r6("risk"), "risk_level")


@query("s11_response_json", f"""WITH {_done()} SELECT request_id, CASE WHEN error IS NULL THEN concat('{{"status":"success","prediction_type":"', prediction_type,
 '","predicted_bleaching_risk":', coalesce(CAST(round(risk, 3) AS VARCHAR), 'null'), ',"tabular_data_used":', coalesce(CAST(data AS VARCHAR), '{{}}'),
 ',"image_processed":', CASE WHEN content_type IS NULL THEN 'false' ELSE 'true' END, ',"model_ready":true}}') END AS response FROM done""")
def _(spark: SparkSession, d: str) -> DataFrame:
    parsed = scoring.parse_requests(payloads(spark, d)).join(images(spark, d).drop("sent"), "request_id", "left")
    scored = scoring.score_requests(parsed, *_models(spark), fields=_JOB_FIELDS)
    return scoring.response_json(scored.withColumn("risk", F.round("risk", 3))).select("request_id", "response")


_STREAMED = _done(lost="image IS NULL OR request_id % 29 = 0")


@query("t1_score_stream", f"WITH {_STREAMED} SELECT CASE WHEN error IS NULL THEN 'accepted' ELSE 'rejected' END AS outcome, request_id, error, round(risk, 6) AS risk FROM done WHERE request_id % 43 <> 0 UNION ALL SELECT 'rejected', NULL, '{scoring.BAD_JSON}', NULL FROM done WHERE request_id % 43 = 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Requests and images written as JSON lines, then brought together, scored and written by the stream.

    Some request lines are broken, some images come too late or never: those requests go on without when the clock says so.
    """
    line = F.to_json(F.struct("request_id", "sent", "content_type", "payload"))
    lines = payloads(spark, d).select(F.when(F.col("request_id") % 43 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value"))
    late = F.when(F.col("request_id") % 29 == 0, F.expr("INTERVAL 1 HOUR")).otherwise(F.expr("INTERVAL 5 MINUTE"))
    content = images(spark, d).withColumns({"sent": F.col("sent") + late, "image": F.col("image").cast("array<double>")})
    asked, sent, out, state = (scratch_path(spark, f"stream-{part}") for part in ("requests", "images", "out", "state"))
    lines.write.text(asked)
    content.write.json(sent)
    tabular, image = _models(spark)
    for _ in range(3):  # the last two read the clock and what waited for it
        score_stream(spark, asked, sent, out, state, tabular, image, fields=_JOB_FIELDS).awaitTermination()
        move_clock(spark, asked, sent, "2200-01-01 00:00:00")
    return spark.read.parquet(out).select("outcome", "request_id", "error", r6("risk"))
