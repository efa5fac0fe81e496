"""CSV tables in and out, class folders, saved models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV with every column as text; types come later, from whole columns."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def read_grid_csv(spark: SparkSession, path: str) -> DataFrame:
    """Ocean grid CSV: the row of units is dropped, measurements are numbers."""
    text = spark.read.option("header", True).option("inferSchema", False).csv(path)
    timed = text.withColumn("time", F.try_to_timestamp("time")).where(F.col("time").isNotNull())
    return timed.withColumns({c: F.col(c).try_cast("double") for c in text.columns if c != "time"})


def write_predictions_csv(df: DataFrame, path: str) -> None:
    """CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_by_class(df: DataFrame, path: str, *folders: str) -> None:
    """One folder per predicted class, or per split and class."""
    df.write.mode("overwrite").partitionBy(*(folders or ("pred_class",))).parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
