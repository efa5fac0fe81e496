"""Mixing sources to target weights by Poisson replication; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidalframe.llm.common import materialise, partitions

SEED = 17
# Copies of the table of rates when it is too large to be broadcast, so that a busy source is spread.
SALTS = 64


def uniform(seed: int, *parts: Column) -> Column:
    """Number in [0, 1) from the MD5 of the parts and the seed, 52 bits."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def poisson_tables(df: DataFrame, source_col: str, weights: dict | None, total_rows: int | None) -> DataFrame:
    """Table (source, rate, cdf): mean repetitions of a row of each source and the distribution function at 0, 1, 2, ...

    The rate brings a source to its share of ``total_rows``: weight / sum of weights x total / rows of the source.
    """
    spark = df.sparkSession
    sizes = df.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.lit(1.0))
    else:
        listed = spark.createDataFrame([(k, float(w)) for k, w in weights.items()], f"name {df.schema[source_col].dataType.simpleString()}, weight double")
        sizes = sizes.join(listed, F.col("source").eqNullSafe(F.col("name")), "left").select("source", "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    sizes = materialise(sizes, "mix-sizes")
    whole = sizes.agg(F.sum("weight").alias("weight"), F.sum("n").alias("n")).first()
    total = float(total_rows if total_rows is not None else whole["n"] or 0)
    rates = sizes.select("source", (F.col("weight") / F.lit(float(whole["weight"] or 1.0)) * F.lit(total) / F.col("n")).alias("rate")).where("rate > 0")
    steps = rates.withColumn("k", F.explode(F.expr("sequence(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS INT))")))
    order = Window.partitionBy("source").orderBy("k")
    steps = steps.withColumn("p", F.exp(F.col("k") * F.log("rate") - F.col("rate") - F.sum(F.log(F.greatest("k", F.lit(1)))).over(order)))
    steps = steps.withColumn("c", F.sum("p").over(order))
    tables = steps.groupBy("source", "rate").agg(F.sort_array(F.collect_list("c")).alias("cdf"))
    return materialise(tables, "mix-rates")


def mix_sources(
    df: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict | None = None, total_rows: int | None = None, seed: int = SEED,
) -> DataFrame:
    """Rows repeated by Poisson counts so that the sources meet their weights in expectation, in a global random order.

    Returns the columns of ``df`` with copy (1, 2, ...) and mix_key, the place in [0, 1) of the row in the random order:
    partitions hold random parts of it, each sorted. ``weights``: by source, any scale; None weighs all sources equally,
    a source not listed has weight 0 and goes. ``total_rows``: expected size, by default that of ``df``. The count of a
    row is the Poisson quantile at a hash of its id and the seed, so rows with equal ids are repeated alike. A null
    source is a source of its own; a null id has a hash too. Columns named copy or mix_key are replaced. Text is not
    looked at. An empty table gives an empty result.
    """
    columns = [c for c in df.columns if c not in ("copy", "mix_key")]
    tables = poisson_tables(df, source_col, weights, total_rows).select(F.col("source").alias("_source"), F.col("cdf").alias("_cdf"))
    # salted on both sides: a busy source meets its rate in many tasks, unless the table is small enough to be sent to all
    salted = materialise(tables.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "mix-salted")
    rows = df.select(*columns).withColumns({"_u": uniform(seed, F.col(id_col)), "_salt": F.expr(f"CAST(pmod(xxhash64(`{id_col}`), {SALTS}) AS INT)")})
    rows = rows.join(salted, (F.col(source_col).eqNullSafe(F.col("_source"))) & (rows["_salt"] == salted["_salt"]))
    rows = rows.withColumn("_n", F.size(F.filter("_cdf", lambda c: c <= F.col("_u")))).where("_n > 0")
    rows = rows.select(*columns, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy"))
    rows = rows.withColumn("mix_key", uniform(seed + 1, F.col(id_col), F.col("copy")))
    return rows.repartition(partitions(df.sparkSession), "mix_key").sortWithinPartitions("mix_key")


ORACLE = f"""
WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, 1.0::DOUBLE / (SELECT count(*) FROM s) * (SELECT sum(n) FROM s)::DOUBLE / n AS rate FROM s),
k AS (SELECT source, rate, unnest(range(0, (ceil(rate + 12 * sqrt(rate) + 30) + 1)::BIGINT)) AS k FROM r),
c AS (SELECT source, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c FROM k),
u AS (SELECT doc_id, source, ('0x' || substr(md5('{SEED}:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
m AS (SELECT u.doc_id, u.source, count(*) AS n FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source AND c.c <= u.u GROUP BY ALL)
SELECT doc_id, source, unnest(range(1, n + 1))::INTEGER AS copy FROM m
"""
