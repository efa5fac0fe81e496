"""Corpus pipeline over documents: quality, lines, near-duplicates, benchmark, mixture.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; ``run`` writes each result as Parquet
below the shared folder and reads it back. The tables that a stage makes are removed when the next one starts, unless its
rows are still read from them: one pipeline at a time in a session.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidalframe.llm.common import documents, materialise, remove_scratch, scratch_scope, table_path
from tidalframe.llm.decontamination import decontaminate
from tidalframe.llm.line_dedup import line_dedup
from tidalframe.llm.mixing import mix_sources
from tidalframe.llm.quality import quality_classifier
from tidalframe.llm.queries import trusted_ids
from tidalframe.llm.simhash_similar import similar_dedup


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# (application, folder) of the tables of stages whose result may not be written yet.
_made: list[tuple[str, str]] = []


def release(spark: SparkSession, docs: DataFrame) -> None:
    """Remove the tables of earlier stages that ``docs`` does not read."""
    here = spark.sparkContext.applicationId
    own = [folder for app, folder in _made if app == here]
    files = docs.inputFiles() if own else []
    still = [folder for folder in own if any(f"{folder.split(':', 1)[-1].lstrip('/')}/" in f for f in files)]
    for folder in own:
        if folder not in still:
            remove_scratch(spark, folder)
    _made[:] = [(here, folder) for folder in still]


def staged(stage: Stage) -> Stage:
    """The stage with a folder of its own for what it writes on its way."""

    @wraps(stage)
    def with_scope(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, docs)
        with scratch_scope(spark, f"pipeline-{stage.__name__}") as folder:
            _made.append((spark.sparkContext.applicationId, folder))
            return stage(spark, docs, sf_dir)

    return with_scope


@staged
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality_classifier(docs, trusted_ids(spark, sf_dir)).kept()


@staged
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go; n_chars follows the text."""
    out = line_dedup(docs).withColumn("n_chars", F.length("text").cast("bigint"))
    return out.select(*docs.columns)


@staged
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: shingles of five words, a similarity of 0.8 or more."""
    return similar_dedup(docs)


@staged
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, documents(spark, sf_dir, "benchmark"))


@staged
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All sources in equal parts, in random order."""
    return mix_sources(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
]

# The language model and the fingerprints have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        path = table_path(spark, f"stage-{name.replace(' ', '-')}")
        docs = materialise(stage(spark, docs, sf_dir), name, path)
        release(spark, docs)
        if before is not None:
            remove_scratch(spark, before)
        before = path
    return docs
