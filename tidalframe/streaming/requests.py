"""Requests and images that arrive as files: brought together, scored, fused and written as they come."""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidalframe.operators.scoring import BAD_JSON, is_image, parse_requests, response_json, score_requests

REQUEST_SCHEMA = "request_id BIGINT, sent TIMESTAMP, content_type STRING, payload STRING, _bad STRING"
IMAGE_SCHEMA = "request_id BIGINT, sent TIMESTAMP, image ARRAY<DOUBLE>"
# Ids of lines that only move the clock of a stream; they differ, so that they never meet.
REQUEST_CLOCK, IMAGE_CLOCK = -1, -2


def read_requests(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Stream of JSON lines with a fixed schema; a line that does not parse is kept as text in ``_bad``."""
    return (
        spark.readStream.schema(REQUEST_SCHEMA)
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(folder)
    )


def read_images(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Stream of image contents, an array of numbers for a request each; lines that do not parse are left out."""
    return spark.readStream.schema(IMAGE_SCHEMA).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_trigger).json(folder)


def move_clock(spark: SparkSession, request_dir: str, image_dir: str, sent: str) -> None:
    """Write lines that only move the clock. Waiting requests go on in the batch after the one that reads them."""
    for folder, number in ((request_dir, REQUEST_CLOCK), (image_dir, IMAGE_CLOCK)):
        spark.range(1).selectExpr(f"{number}L AS request_id", f"TIMESTAMP '{sent}' AS sent").write.mode("append").json(folder)


def with_images(requests: DataFrame, images: DataFrame, late: str = "10 minutes", apart: str = "10 minutes") -> DataFrame:
    """Requests that name an image with the one sent at most ``apart`` from them, or null when none has come.

    Both sides are kept until the watermark, ``late`` behind the newest row of the slower stream, shows that no partner can
    come; a request without a partner goes on then. Other requests pass at once. State is bounded by ``late`` + ``apart``.
    """
    clock = F.col("request_id").eqNullSafe(REQUEST_CLOCK)
    waits = is_image(F.col("content_type")) & F.col("_bad").isNull() & ~clock
    asked = requests.where(waits | clock).withWatermark("sent", late)
    sent = images.withWatermark("sent", late).select(F.col("request_id").alias("_request"), F.col("sent").alias("_sent"), "image")
    near = (F.col("request_id") == F.col("_request")) & F.expr(f"_sent BETWEEN sent - INTERVAL {apart} AND sent + INTERVAL {apart}")
    # this condition on both sides stays above the join: one on requests alone would go below the watermark and stop the clock
    met = asked.join(sent, near, "leftOuter").where(waits | F.col("_request").isNotNull())
    columns = ["request_id", "content_type", "payload", "_bad", "image"]
    rest = requests.where(~waits & ~clock).withColumn("image", F.lit(None).cast("array<double>"))
    return rest.select(*columns).unionByName(met.select(*columns))


def score_stream(
    spark: SparkSession, request_dir: str, image_dir: str, out_dir: str, checkpoint: str, tabular_model: Transformer,
    image_model: Transformer, files_per_trigger: int = 1000, late: str = "10 minutes", apart: str = "10 minutes", **options,
) -> StreamingQuery:
    """Score what has arrived and stop. Accepted and rejected requests go to their own folder below ``out_dir``.

    Both models are fitted pipelines; ``options`` go to ``score_requests``. Waiting requests and images are state in the
    checkpoint, and the file sink commits every batch once, so a restart goes on where it ended.
    """
    arrived = with_images(read_requests(spark, request_dir, files_per_trigger), read_images(spark, image_dir, files_per_trigger), late, apart)
    parsed = parse_requests(arrived).withColumn("error", F.when(F.col("_bad").isNotNull(), BAD_JSON).otherwise(F.col("error"))).drop("_bad")
    done = response_json(score_requests(parsed, tabular_model, image_model, **options)).drop("tabular_data")
    routed = done.withColumn("outcome", F.when(F.col("error").isNull(), "accepted").otherwise("rejected"))
    return (
        routed.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint)
        .partitionBy("outcome").outputMode("append").trigger(availableNow=True).start()
    )
