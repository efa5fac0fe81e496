"""Queries that write files and read them back: CSV tables, class folders, saved models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidalframe.functions import labels
from tidalframe.operators import scoring
from tidalframe.plans.catalog import query
from tidalframe.plans.modelling import fitted, labelled, training_set
from tidalframe.plans.profiling import RAW_COLUMNS
from tidalframe.plans.standins import GRID_CELLS, GRID_CTE, OBS_RAW_CTE, SCORES_CTE, obs_raw, scores, view
from tidalframe.session import scratch_path
from tidalframe.sources import tables


@query("s1_read_observations", f"WITH {OBS_RAW_CTE} SELECT " + ", ".join(f"NULLIF(CAST({c} AS VARCHAR), '') AS {c}" for c in RAW_COLUMNS) + " FROM reef_obs_raw")
def _(spark: SparkSession, d: str) -> DataFrame:
    """In a CSV an empty field is a missing value, however it is quoted."""
    path = scratch_path(spark, "observations")
    obs_raw(spark, d).write.option("header", True).csv(path)
    return tables.read_observations(spark, path)


@query("s6_read_grid_csv", f"WITH {GRID_CTE} SELECT grid_date, CAST(iy AS DOUBLE) AS iy, CAST(ix AS DOUBLE) AS ix, round(sst, 6) AS sst, round(clim_sst, 6) AS clim_sst FROM grid_cells")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A grid file with its row of units, as a download has it."""
    path = scratch_path(spark, "grid")
    cells = view(spark, d, GRID_CELLS).select(
        labels.grid_date_text(F.col("grid_date")).alias("time"), *[F.col(c).cast("string").alias(c) for c in ("iy", "ix", "sst", "clim_sst")]
    )
    units = spark.createDataFrame([("UTC", "degrees_north", "degrees_east", "degree_C", "degree_C")], cells.schema)
    units.unionByName(cells).write.option("header", True).csv(path)
    read = tables.read_grid_csv(spark, path)
    return read.select(F.to_date("time").alias("grid_date"), "iy", "ix", F.round("sst", 6).alias("sst"), F.round("clim_sst", 6).alias("clim_sst"))


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p")
    name = F.when(labels.binary_prediction(p, 0.02) == 1, scoring.CLASS_NAMES[0]).otherwise(scoring.CLASS_NAMES[1])
    return scores(spark, d).select(
        F.concat(F.lit("img_"), F.col("item_id").cast("string"), F.lit(".png")).alias("filename"), name.alias("pred_class"),
        p.alias("p_bleached"), labels.confidence(p).alias("confidence"),
    )


_PREDICTIONS_SQL = f"WITH {SCORES_CTE} SELECT concat('img_', item_id, '.png') AS filename, CASE WHEN p >= CAST(0.02 AS DOUBLE) THEN 'Bleached' ELSE 'Unbleached' END AS pred_class, round(p, 6) AS p_bleached, round(greatest(p, 1 - p), 6) AS confidence FROM score_pairs"


@query("s8_write_predictions_csv", _PREDICTIONS_SQL)
def _(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "predictions")
    tables.write_predictions_csv(_predictions(spark, d), path)
    read = tables.read_observations(spark, path)
    return read.select("filename", "pred_class", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("p_bleached", "confidence")])


@query("s9_write_by_class", _PREDICTIONS_SQL)
def _(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "by-class")
    tables.write_by_class(_predictions(spark, d), path)
    return spark.read.parquet(path).select("filename", "pred_class", F.round("p_bleached", 6).alias("p_bleached"), F.round("confidence", 6).alias("confidence"))


@query("s10_save_load_model", "SELECT CAST(sum(CASE WHEN (l_orderkey + l_linenumber) % 6 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS n_rows, CAST(0 AS DOUBLE) AS max_difference FROM lineitem")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a fitted pipeline before saving and after loading, over all rows with a target."""
    _, _, _, pre = training_set(spark, d)
    whole = PipelineModel(stages=[*pre.stages, fitted(spark, d, "LogisticRegressionClassic")])
    path = scratch_path(spark, "model")
    tables.save_model(whole, path)
    rows = labelled(spark, d).withColumn("split", F.lit("score"))
    before = scoring.score_tabular(rows, whole, ["row_key"]).select("row_key", F.col("probability_bleached").alias("a"))
    after = scoring.score_tabular(rows, tables.load_model(path), ["row_key"]).select("row_key", F.col("probability_bleached").alias("b"))
    return before.join(after, "row_key").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(F.abs(F.col("a") - F.col("b"))).alias("max_difference")
    )
