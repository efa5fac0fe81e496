"""Requests: validation per mode, scoring, fusion and responses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

from tidalframe.functions.labels import (
    base_name, binary_prediction, bleached_probability, confidence, risk_label, risk_level,
)
from tidalframe.operators.profiling import class_counts

# The prediction modes.
FUSION = "Multi-Modal Fusion (Image + Data)"
IMAGE_ONLY = "Image-Only (VGG Augmented)"
TABULAR_ONLY = "Tabular-Only"
MANUAL = "Manual Data Entry Only (No NOAA Pull)"

# Features a tabular request has to have.
REQUIRED = (
    "Distance_to_Shore", "Turbidity", "Cyclone_Frequency", "Depth_m", "ClimSST", "Temperature_Kelvin",
    "Temperature_Kelvin_Standard_Deviation", "Windspeed",
)

# What a refused request is told.
BAD_JSON = "Invalid JSON payload"
NOT_AN_IMAGE = "File must be an image"
FUSION_NEEDS_IMAGE = "Fusion requires an image."
FUSION_NEEDS_DATA = "Fusion requires tabular data."
NEEDS_DATA = "Tabular data is required."
NEEDS_IMAGE = "Image-only prediction requires an image file."
NEEDS_FEATURES = "Missing required tabular features: "
# Of this engine: the request names an image, but its content is not there.
IMAGE_CONTENT_MISSING = "The image's content is missing."

CLASS_NAMES = ("Bleached", "Unbleached")

# The typed fields of a tabular request.
TABULAR_FIELDS = {
    "Longitude_Degrees": "double", "year_norm": "double", "Latitude_Degrees": "double", "Depth_m": "double",
    "Distance_to_Shore": "double", "Temperature_Kelvin_Standard_Deviation": "double", "Temperature_Kelvin": "double",
    "TSA": "double", "Cyclone_Frequency": "double", "SSTA": "double", "ClimSST": "double", "Realm_Name": "string",
    "SSTA_DHW": "double", "month_cos": "double", "TSA_DHW": "double", "Exposure": "double", "Ocean_Name": "string",
    "Windspeed": "double", "month_sin": "double", "Turbidity": "double",
}
DATA = "map<string,variant>"


def missing_required(features: Column, required: Sequence[str] = REQUIRED) -> Column:
    """Required names a feature map lacks, in their stated order."""
    return F.filter(F.array(*[F.lit(r) for r in required]), lambda name: ~F.map_contains_key(features, name))


def required_fields(df: DataFrame, features: str = "tabular_data", required: Sequence[str] = REQUIRED) -> DataFrame:
    """Add ``missing``: the required features a request does not have. A null value is there; scoring imputes it."""
    known = F.coalesce(F.col(features), F.create_map().cast(df.schema[features].dataType))
    return df.withColumn("missing", missing_required(known, required))


def typed_fields(df: DataFrame, features: str, fields: Mapping[str, str]) -> dict[str, Column]:
    """Values of a feature map as typed columns: null where a field is absent, null or not of its type.

    The map's values may be of any type JSON has (a map of VARIANT) or plain numbers.
    """
    loose = isinstance(df.schema[features].dataType.valueType, VariantType)

    def value(name: str, kind: str) -> Column:
        found = F.col(features)[name]
        return F.try_variant_get(found, "$", kind) if loose else found.try_cast(kind)

    return {name: value(name, kind) for name, kind in fields.items()}


def is_image(content_type: Column) -> Column:
    return F.coalesce(F.startswith(content_type, F.lit("image/")), F.lit(False))


def mode_error(mode: Column, has_image: Column, has_data: Column) -> Column:
    """Why a request cannot be scored in its mode, null when it can."""
    needs_data = mode.isin(TABULAR_ONLY, MANUAL)
    error = F.when((mode == FUSION) & ~has_image, FUSION_NEEDS_IMAGE)
    error = error.when((mode == FUSION) & ~has_data, FUSION_NEEDS_DATA)
    error = error.when(needs_data & ~has_data, NEEDS_DATA)
    return error.when((mode == IMAGE_ONLY) & ~has_image, NEEDS_IMAGE)


def validate_mode(df: DataFrame, mode: str = "prediction_type", image: str = "content_type", data: str = "tabular_data") -> DataFrame:
    """Add ``error``: the rule a request breaks, a missing part before a wrong file type."""
    has_image = F.col(image).isNotNull()
    has_data = F.coalesce(F.size(data) > 0, F.lit(False)) if dict(df.dtypes)[data].startswith("map") else F.col(data).isNotNull()
    wrong_type = F.when(has_image & ~is_image(F.col(image)), NOT_AN_IMAGE)
    return df.withColumn("error", F.coalesce(mode_error(F.col(mode), has_image, has_data), wrong_type))


def parse_requests(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Replace the JSON payload by ``prediction_type`` and ``tabular_data``, a map of typed values (VARIANT).

    Values keep the type they are sent with: numbers, text, truth values, nested data. Text that does not parse, or is no
    JSON object, sets ``error``; data that is no object counts as none.
    """
    rest = [c for c in df.columns if c != payload]
    # in brackets, since the parser stops behind the first value: what follows it makes the list longer or broken
    parsed = df.select(*rest, F.when(F.endswith(F.rtrim(payload), F.lit("}")), F.try_parse_json(F.concat(F.lit("["), payload, F.lit("]")))).alias("_p"))
    bad = F.try_variant_get("_p", "$[0]", DATA).isNull() | F.try_variant_get("_p", "$[1]", "variant").isNotNull()
    return parsed.select(
        *rest,
        F.when(~bad, F.try_variant_get("_p", "$[0].prediction_type", "string")).alias("prediction_type"),
        F.when(~bad, F.try_variant_get("_p", "$[0].tabular_data", DATA)).alias("tabular_data"),
        F.when(bad, BAD_JSON).alias("error"),
    )


def fuse_scores(image: DataFrame, tabular: DataFrame, key: str = "request_id") -> DataFrame:
    """Image and tabular score of each request that has either."""
    return image.join(tabular, key, "full")


def fuse(image: Column, tabular: Column, mode: Column) -> Column:
    """One risk from both scores, by mode; an unknown mode takes the tabular score unless that is missing or 0."""
    risk = F.when(mode == FUSION, F.round((image + tabular) / 2, 3))
    risk = risk.when(mode == IMAGE_ONLY, image).when(mode.isin(TABULAR_ONLY, MANUAL), tabular)
    return risk.otherwise(F.coalesce(F.nullif(tabular, F.lit(0.0)), image, tabular))


def linear_probability(values: Mapping[str, Column], weights: Mapping[str, float], intercept: float) -> Column:
    """Logistic score of prepared values."""
    z = sum((values[name] * w for name, w in weights.items()), F.lit(float(intercept)))
    return 1 / (1 + F.exp(-z))


def linear_pipeline(
    weights: Mapping[str, float], intercept: float, defaults: Mapping[str, float] | None = None,
    categories: Mapping[str, Mapping[str, float]] | None = None,
) -> PipelineModel:
    """Given coefficients as a pipeline that can be saved, loaded and applied to tables and streams.

    It adds ``probability``, of class 1. A missing number takes its default; ``categories`` has the weights of texts, an
    unknown or missing text adds nothing.
    """
    quoted = lambda text: "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
    terms = [f"coalesce(`{c}`, {(defaults or {}).get(c, 0.0)!r}D) * {w!r}D" for c, w in weights.items()]
    for c, known in (categories or {}).items():
        cases = " ".join(f"WHEN {quoted(v)} THEN {w!r}D" for v, w in known.items())
        terms.append(f"(CASE `{c}` {cases} ELSE 0D END)")
    z = " + ".join([f"{float(intercept)!r}D", *terms])
    return PipelineModel(stages=[SQLTransformer(statement=f"SELECT *, 1 / (1 + exp(-({z}))) AS probability FROM __THIS__")])


def linear_image_pipeline(weights: Sequence[float], intercept: float, image: str = "image") -> PipelineModel:
    """As ``linear_pipeline`` for an array of numbers, a weight each."""
    listed = ", ".join(f"{float(w)!r}D" for w in weights)
    z = f"aggregate(zip_with(`{image}`, array({listed}), (x, w) -> x * w), {float(intercept)!r}D, (a, x) -> a + x)"
    return PipelineModel(stages=[SQLTransformer(statement=f"SELECT *, 1 / (1 + exp(-({z}))) AS probability FROM __THIS__")])


def add_score(df: DataFrame, model: Transformer, inputs: Mapping[str, Column], out: str) -> DataFrame:
    """``df`` with ``out``, the probability of class 1 that a fitted pipeline gives the inputs.

    The row travels beside the inputs in one column, so the pipeline has to pass columns on that it does not know, and no
    name of the row can clash with one of its own.
    """
    packed = df.select(F.struct(*df.columns).alias("_row"), *[c.alias(n) for n, c in inputs.items()])
    scored = model.transform(packed)
    p = F.col("probability") if dict(scored.dtypes)["probability"] == "double" else vector_to_array("probability")[1]
    return scored.select("_row.*", p.alias(out))


def describe_score(p: Column, positive: str = CLASS_NAMES[0], negative: str = CLASS_NAMES[1], threshold: float = 0.5) -> list[Column]:
    """Class name and both probabilities; p belongs to the positive class."""
    hit = binary_prediction(p, threshold) == 1
    return [
        F.when(hit, positive).when(p.isNotNull(), negative).alias("predicted_class"),
        p.alias("probability_bleached"), (1 - p).alias("probability_unbleached"),
    ]


def score_linear(
    df: DataFrame, weights: Mapping[str, float], intercept: float, keep: Sequence[str], threshold: float = 0.5
) -> DataFrame:
    """Score prepared columns with given coefficients."""
    p = linear_probability({c: F.col(c) for c in weights}, weights, intercept)
    return df.select(*keep, p.alias("_p")).select(*keep, *describe_score(F.col("_p"), threshold=threshold))


def score_tabular(df: DataFrame, model: PipelineModel, keep: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Prepare and score rows with a fitted pipeline; ``keep`` columns have to pass through its preprocessor."""
    scored = model.transform(df).select(*keep, vector_to_array("probability")[1].alias("_p"))
    return scored.select(*keep, *describe_score(F.col("_p"), threshold=threshold))


def score_images(df: DataFrame, model: PipelineModel, path: str = "path", bleached_index: int = 0, threshold: float = 0.5) -> DataFrame:
    """Score image vectors: file name, predicted class, probability of bleaching and confidence."""
    scored = model.transform(df).select(path, vector_to_array("probability")[1].alias("_p1"))
    scored = scored.select(path, bleached_probability(F.col("_p1"), bleached_index).alias("p_bleached"))
    p = F.col("p_bleached")
    named = F.when(binary_prediction(p, threshold) == 1, CLASS_NAMES[0]).otherwise(CLASS_NAMES[1])
    return scored.select(
        F.col(path).alias("path"), base_name(F.col(path)).alias("filename"), named.alias("pred_class"), "p_bleached",
        confidence(p).alias("confidence"),
    )


def predicted_counts(scored: DataFrame, classes: Sequence[str] = CLASS_NAMES) -> DataFrame:
    """Scored images per class, zero included."""
    return class_counts(scored, "pred_class", classes)


def predict_tabular_job(
    df: DataFrame, model: Transformer, key: str = "request_id", features: str = "tabular_data",
    fields: Mapping[str, str] = TABULAR_FIELDS, required: Sequence[str] = REQUIRED,
) -> DataFrame:
    """Batch form of tabular prediction by a fitted pipeline over ``fields``.

    Requests without data or without a required feature get an error. A feature that is there but null, or not of its
    type, is left to the pipeline, which imputes it.
    """
    checked = required_fields(df, features, required)
    empty = F.coalesce(F.size(features) == 0, F.lit(True))
    absent = F.size("missing") > 0
    error = F.when(empty, NEEDS_DATA).when(
        absent, F.concat(F.lit(NEEDS_FEATURES), F.lit("["), F.array_join(F.transform("missing", lambda m: F.concat(F.lit("'"), m, F.lit("'"))), ", "), F.lit("]"))
    )
    scored = add_score(checked.withColumn("error", error), model, typed_fields(df, features, fields), "_p")
    return scored.select(key, "error", *describe_score(F.when(F.col("error").isNull(), F.col("_p"))))


def predict_image_job(df: DataFrame, model: PipelineModel, key: str = "request_id", bleached_index: int = 0) -> DataFrame:
    """Batch form of image prediction on (key, content_type, features): other file types get an error."""
    good = is_image(F.col("content_type"))
    scored = model.transform(df).select(
        key, F.when(~good, NOT_AN_IMAGE).alias("error"),
        F.when(good, bleached_probability(vector_to_array("probability")[1], bleached_index)).alias("_p"),
    )
    return scored.select(key, "error", *describe_score(F.col("_p")))


def response_json(df: DataFrame) -> DataFrame:
    """Add the response document of a scored request."""
    document = F.struct(
        F.lit("success").alias("status"), "prediction_type",
        F.col("risk").alias("predicted_bleaching_risk"),
        F.coalesce("tabular_data", F.create_map().cast(df.schema["tabular_data"].dataType)).alias("tabular_data_used"),
        F.col("content_type").isNotNull().alias("image_processed"),
        F.lit(True).alias("model_ready"),
    )
    return df.withColumn("response", F.when(F.col("error").isNull(), F.to_json(document, {"ignoreNullFields": "false"})))


def merge_data(requests: DataFrame, background: DataFrame, key: str = "request_id") -> DataFrame:
    """Values looked up for a request (``background``: key, values) below the ones it sent, which win; image-only requests take none.

    A refused payload stays without data.
    """
    found = background.select(key, F.transform_values("values", lambda _, v: v.cast("variant")).alias("_found"))
    none = F.create_map().cast(DATA)
    merged = F.map_zip_with(F.coalesce("_found", none), F.coalesce("tabular_data", none), lambda _, low, high: F.coalesce(high, low))
    takes = F.col("error").isNull() & ~F.col("prediction_type").eqNullSafe(IMAGE_ONLY) & F.col("_found").isNotNull()
    joined = requests.join(found, key, "left")
    return joined.withColumn("tabular_data", F.when(takes, merged).otherwise(F.col("tabular_data"))).drop("_found")


def score_requests(
    parsed: DataFrame, tabular_model: Transformer, image_model: Transformer, fields: Mapping[str, str] = TABULAR_FIELDS,
    image: str = "image", image_width: int | None = None, bleached_index: int = 0,
) -> DataFrame:
    """Validate parsed requests, score their data and images with fitted pipelines, fuse both and name the risk.

    Works on tables and streams, without a shuffle. Expects prediction_type, tabular_data, content_type, the image's numbers and
    the parser's ``error``. With ``image_width`` the numbers become the vector ``features`` of a Spark ML model, without it the
    array itself is the pipeline's input. A named image without numbers is an error. A risk is a share; level and label are for its percent.
    """
    unread = parsed.withColumnRenamed("error", "_unread")
    validated = validate_mode(unread).withColumn("error", F.coalesce("_unread", "error")).drop("_unread")
    lost = F.when(is_image(F.col("content_type")) & F.col(image).isNull(), IMAGE_CONTENT_MISSING)
    validated = validated.withColumn("error", F.coalesce("error", lost))
    scored = add_score(validated, tabular_model, typed_fields(validated, "tabular_data", fields), "tabular_score")
    numbers = F.col(image).cast("array<double>")
    inputs = {image: numbers} if image_width is None else {"features": array_to_vector(F.coalesce(numbers, F.array_repeat(F.lit(0.0), image_width)))}
    scored = add_score(scored, image_model, inputs, "image_score").drop(image)
    good = F.col("error").isNull()
    has_data, has_image = F.coalesce(F.size("tabular_data") > 0, F.lit(False)), is_image(F.col("content_type"))
    scored = scored.withColumns({
        "tabular_score": F.when(good & has_data, F.col("tabular_score")),
        "image_score": F.when(good & has_image, bleached_probability(F.col("image_score"), bleached_index)),
    })
    risk = F.when(good, fuse(F.col("image_score"), F.col("tabular_score"), F.col("prediction_type")))
    fused = scored.withColumn("risk", risk)
    percent = F.col("risk") * 100
    return fused.withColumns({"risk_level": risk_level(percent), "risk_label": F.when(percent.isNotNull(), risk_label(percent))})


def predict_job(
    requests: DataFrame, tabular_model: Transformer, image_model: Transformer, images: DataFrame | None = None,
    background: DataFrame | None = None, key: str = "request_id", **options,
) -> DataFrame:
    """Batch form of the universal prediction: parse, add looked-up values and images, validate, score, fuse, respond.

    ``images`` has (key, image), ``background`` (key, values); both are joined by key, one row a request. ``options`` go
    to ``score_requests``.
    """
    parsed = parse_requests(requests)
    if background is not None:
        parsed = merge_data(parsed, background, key)
    if images is not None:
        parsed = parsed.join(images, key, "left")
    return response_json(score_requests(parsed, tabular_model, image_model, **options))
