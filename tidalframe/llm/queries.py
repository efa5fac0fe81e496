"""Registered queries of this subpackage and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidalframe.llm.common import documents
from tidalframe.llm import line_dedup, merkle, mixing, periodic_runs, secret_scan, url_filter
from tidalframe.llm.decontamination import contamination
from tidalframe.llm.embedding_dedup import embedding_classes
from tidalframe.llm.language_id import train
from tidalframe.llm.quality import quality_classifier
from tidalframe.llm.simhash import simhash_classes
from tidalframe.llm.substring_dedup import substring_dedup
from tidalframe.llm.suffix_dedup import suffix_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return keep


@register("op4_substring_dedup")
def substring_query(spark: SparkSession, folder: str) -> DataFrame:
    out = substring_dedup(documents(spark, folder))
    return out.select(F.col("id").alias("doc_id"), F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@register("op8_suffix_array_dedup")
def suffix_query(spark: SparkSession, folder: str) -> DataFrame:
    out = suffix_dedup(documents(spark, folder))
    return out.select(F.col("id").alias("doc_id"), F.col("n_units").alias("n_bytes"), "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@register("op1_simhash_dedup")
def simhash_query(spark: SparkSession, folder: str) -> DataFrame:
    out = simhash_classes(documents(spark, folder))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@register("op7_embedding_dedup")
def embedding_query(spark: SparkSession, folder: str) -> DataFrame:
    out = embedding_classes(documents(spark, folder, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.expr("id <=> component").alias("kept"))


@register("op2_benchmark_decontamination")
def decontamination_query(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item."""
    out = contamination(documents(spark, folder), documents(spark, folder, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "item_id", "windows", "item_windows", "changed")


@register("op5_source_mixing", mixing.ORACLE)
def mixing_query(spark: SparkSession, folder: str) -> DataFrame:
    """Every replicated document, by id and copy, in random order."""
    return mixing.mix_sources(documents(spark, folder).select("doc_id", "source")).select("doc_id", "source", "copy")


@register("op9_line_dedup", line_dedup.ORACLE)
def line_query(spark: SparkSession, folder: str) -> DataFrame:
    out = line_dedup.line_dedup(documents(spark, folder).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@register("op10_url_filter", url_filter.ORACLE)
def url_query(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.url_filter(documents(spark, folder, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def trusted_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Documents labelled as good and not toxic."""
    return documents(spark, folder, "labels").where("quality = 1 AND toxic = 0").select("doc_id")


@register("op3_quality_classifier")
def quality_query(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its perplexity, the limit of its language and the decision."""
    out = quality_classifier(documents(spark, folder).select("doc_id", "lang", "text"), trusted_ids(spark, folder)).rows()
    return out.select("doc_id", "lang", "perplexity", "perplexity_limit", "keep")


@register("op6_language_id")
def language_query(spark: SparkSession, folder: str) -> DataFrame:
    """Prediction of every document; those whose id has a CRC-32 of 1 modulo 3 are held out of training."""
    docs = documents(spark, folder).select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    docs = docs.withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    model = train(docs.where("NOT held_out"))
    return model.predict(docs.select("doc_id", "held_out", "text")).select("doc_id", "held_out", "lang_pred", "score", "accepted")


@register("op11_periodic_runs", periodic_runs.ORACLE)
def periodic_query(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of every document, a tenth of which is made to go on periodically, and the words that are left."""
    out = periodic_runs.periodic_runs(periodic_runs.with_repeats(documents(spark, folder)))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    out = out.select("*", F.size("runs").cast("bigint").alias("n_runs"), (-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period"))
    said = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    return out.select(
        F.col("id").alias("doc_id"), "n_runs", "start", "length", "period", F.expr("1000 * length div period").alias("exponent_milli"),
        F.sha2(said.cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@register("op13_merkle_manifest", merkle.ORACLE)
def merkle_query(spark: SparkSession, folder: str) -> DataFrame:
    """Proof of every document, and whether the document as it is claimed, some with another length, still leads to the root."""
    changed = [F.col(c) if c != "n_chars" else F.col(c).cast("decimal(20,0)") + 1 for c in merkle.MANIFEST]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    out = merkle.merkle_manifest(documents(spark, folder), merkle.MANIFEST, claims={"changed": F.when(tampered, merkle.leaf_digest(changed))})
    out = out.withColumn("folded_root", merkle.fold(F.coalesce("changed", "leaf"), F.col("proof")))
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(merkle.proof_text(F.col("proof")).cast("binary"), 256).alias("proof_sha256"), "folded_root", F.expr("folded_root = root").alias("verified"))


@register("op12_secret_scan", secret_scan.ORACLE)
def secret_query(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of secrets: those of the base patterns, counted and hashed, and all with what the entropy windows add."""
    out = secret_scan.secret_scan(documents(spark, folder).select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    said = secret_scan.spans_text
    return out.select("doc_id", *map(count, secret_scan.BASE_KINDS), F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
