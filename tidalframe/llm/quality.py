"""Quality classifier: perplexity under a character model of trusted text, limits by language."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidalframe.llm.blocks import unpack, write_blocks
from tidalframe.llm.common import materialise
from tidalframe.llm.kneser_ney import estimate, score_grams, text_grams

ORDER = 3
# Share of a language's trusted texts under its limit, and the room above it.
QUANTILE = 0.99
ROOM = 1.1
# A text counts as so many units of its language's average besides its own, so that a few rare letters don't reject it.
PRIOR_UNITS = 60
# Steps a nat in which scores are counted for the quantiles.
STEPS = 1000
# Texts whose grams are looked up together.
_TEXTS = 200

_IDS = pa.schema([("block", pa.int64()), ("row", pa.int32()), ("id", pa.int64())])
_SENT = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())])
_SCORES = pa.schema([("block", pa.int64()), ("row", pa.int32()), ("lang", pa.string()), ("nats", pa.float64()), ("units", pa.int64()), ("trusted", pa.bool_())])


def _texts(table: pa.Table, text: str) -> list[str]:
    return [t or "" for t in table.column(text).cast(pa.string()).to_pylist()]


def _payloads(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


def _send_ids(batches, id_col: str):
    for row in _payloads(batches):
        ids = unpack(row["payload"]).column(id_col).cast(pa.int64()).combine_chunks()
        yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(ids), pa.int64()), pa.array(range(len(ids)), pa.int32()), ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids], schema=_IDS)


def _send_grams(batches, text: str, order: int, shards: int):
    """Distinct grams of each block by shard, and how often they stand in its trusted texts."""
    for row in _payloads(batches):
        texts = _texts(unpack(row["payload"]), text)
        found, bounds = text_grams(texts, order)
        grams, place = np.unique(found, return_inverse=True)
        mark = np.zeros(len(texts), bool)
        mark[row["trusted"] or []] = True
        counts = np.bincount(place[np.repeat(mark, np.diff(bounds))], minlength=len(grams))
        shard = grams % shards
        by = np.argsort(shard, kind="stable")
        grams, counts, shard = grams[by], counts[by], shard[by]
        names, begin = np.unique(shard, return_index=True)
        ends = np.append(begin[1:], len(shard))
        yield pa.RecordBatch.from_arrays([
            pa.array(names), pa.array([row["block"]] * len(names), pa.int64()), pa.array([grams[a:b].tobytes() for a, b in zip(begin, ends)], pa.binary()),
            pa.array([counts[a:b].astype(np.int32).tobytes() for a, b in zip(begin, ends)], pa.binary()),
        ], schema=_SENT)


def _sum_counts(frame: pd.DataFrame) -> pd.DataFrame:
    grams, place = np.unique(np.concatenate([np.frombuffer(g, np.int64) for g in frame["grams"]]), return_inverse=True)
    counts = np.bincount(place, np.concatenate([np.frombuffer(c, np.int32) for c in frame["counts"]]), len(grams))
    return pd.DataFrame({"model": "trusted", "gram": grams, "n": counts.astype(np.int64)})


def _answer(sent: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """Log probabilities of the grams each block asked for."""
    known = known.sort_values("gram")
    keys, logs = known["gram"].to_numpy(), known["logp"].to_numpy(np.float64)
    return pd.DataFrame({"block": sent["block"], "grams": sent["grams"], "logs": [logs[np.searchsorted(keys, np.frombuffer(g, np.int64))].astype(np.float32).tobytes() for g in sent["grams"]]})


def _score(batches, text: str, lang: str, order: int):
    for row in _payloads(batches):
        table = unpack(row["payload"])
        texts, langs = _texts(table, text), table.column(lang).cast(pa.string()).to_pylist()
        answers = row["answers"] or []
        keys = np.concatenate([np.frombuffer(a["grams"], np.int64) for a in answers] or [np.zeros(0, np.int64)])
        logs = np.concatenate([np.frombuffer(a["logs"], np.float32) for a in answers] or [np.zeros(0, np.float32)])
        by = np.argsort(keys)
        keys, logs = keys[by], logs[by].astype(np.float64)
        nats, units = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for at in range(0, len(texts), _TEXTS):
            found, bounds = text_grams(texts[at : at + _TEXTS], order)
            sums = np.concatenate(([0.0], np.cumsum(logs[np.searchsorted(keys, found)]))) if len(found) else np.zeros(1)
            nats[at : at + _TEXTS] = sums[bounds[:-1]] - sums[bounds[1:]]
            units[at : at + _TEXTS] = np.diff(bounds)
        mark = np.zeros(len(texts), bool)
        mark[row["trusted"] or []] = True
        yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(texts), pa.int64()), pa.array(range(len(texts)), pa.int32()), pa.array(langs, pa.string()), pa.array(nats), pa.array(units), pa.array(mark)], schema=_SCORES)


def _attach(batches, fields: list[str]):
    """Rows of a block with what was found for each: columns as in ``fields`` after the block's own."""
    for row in _payloads(batches):
        table = unpack(row["payload"])
        found = {x["row"]: x for x in row["found"]}
        rows = sorted(found)
        table = table.take(rows)
        for name in fields:
            kind = pa.bool_() if name == "keep" else pa.float64()
            values = pa.array([found[r][name] for r in rows], kind)
            table = table.drop_columns([name]).append_column(name, values) if name in table.column_names else table.append_column(name, values)
        yield from table.combine_chunks().to_batches()


class QualityClassifier:
    """A table in blocks with the score, limit and decision of each row."""

    def __init__(self, df: DataFrame, blocks: DataFrame, scores: DataFrame):
        self._schema, self._blocks, self.scores = df.schema, blocks, scores

    def rows(self) -> DataFrame:
        """All rows with perplexity, its limit (both of the smoothed score) and keep; columns of these names are replaced."""
        fields = ["perplexity", "perplexity_limit", "keep"]
        found = self.scores.groupBy("block").agg(F.collect_list(F.struct("row", *fields)).alias("found"))
        schema = self._schema
        schema = type(schema)([f for f in schema.fields if f.name not in fields]).add("perplexity", "double").add("perplexity_limit", "double").add("keep", "boolean")
        return self._blocks.join(materialise(found, "quality-found"), "block").mapInArrow(partial(_attach, fields=fields), schema)

    def kept(self) -> DataFrame:
        """The rows that are not rejected, with the columns they came with."""
        found = self.scores.where("keep").groupBy("block").agg(F.collect_list(F.struct("row")).alias("found"))
        return self._blocks.join(materialise(found, "quality-kept"), "block").mapInArrow(partial(_attach, fields=[]), self._schema)


def _limits(scores: DataFrame, quantile: float, room: float, prior: float) -> DataFrame:
    """Scores with perplexity, limit and keep."""
    trusted = scores.where("trusted AND units > 0")
    means = trusted.groupBy("lang").agg(F.sum("nats").alias("nats"), F.sum("units").alias("units"))
    whole = means.agg((F.sum("nats") / F.sum("units")).alias("mean"))
    mean = F.coalesce(F.col("mean"), F.lit(whole.first()["mean"]), F.lit(0.0))
    means = materialise(means.select(F.col("lang").alias("_lang"), (F.col("nats") / F.col("units")).alias("mean")), "quality-means")
    scored = scores.join(means, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")
    scored = scored.withColumn("entropy", (F.col("nats") + prior * mean) / (F.col("units") + prior)).drop("mean")
    steps = scored.where("trusted AND units > 0").groupBy("lang", F.ceil(F.col("entropy") * STEPS).alias("step")).agg(F.count("*").alias("n"))
    steps = materialise(steps, "quality-steps")

    def reached(groups: list[str]) -> DataFrame:
        """The least step at or under which the share of texts is the quantile or more: steps are few, texts are not."""
        one = steps.groupBy(*groups, "step").agg(F.sum("n").alias("n"))
        order = Window.partitionBy(*groups)
        one = one.withColumns({"below": F.sum("n").over(order.orderBy("step")), "all": F.sum("n").over(order)})
        return one.where(F.col("below") >= F.lit(quantile) * F.col("all")).groupBy(*groups).agg(F.min("step").alias("step"))

    pooled = reached([]).first()
    limits = materialise(reached(["lang"]).select(F.col("lang").alias("_lang"), "step"), "quality-limits")
    scored = scored.join(limits, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    step = F.coalesce(F.col("step"), F.lit(pooled["step"] if pooled else None).cast("bigint"))
    limit = F.exp(step / STEPS) * room
    perplexity = F.exp("entropy")
    return scored.select("block", "row", perplexity.alias("perplexity"), limit.alias("perplexity_limit"), F.coalesce(perplexity <= limit, F.lit(True)).alias("keep"))


def quality_classifier(
    df: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER,
    quantile: float = QUANTILE, room: float = ROOM, prior_units: float = PRIOR_UNITS,
) -> QualityClassifier:
    """Train an interpolated modified Kneser-Ney model on the rows of ``df`` whose id is in ``trusted`` (first column), score all rows.

    Counts cover every trusted text. Grams are counted in blocks and summed by shard; every block asks the shards of its
    distinct grams for their probabilities, so no model is broadcast and what is gathered grows with the input.

    A row is rejected if its smoothed perplexity is over ``room`` times the ``quantile`` of the trusted rows of its
    language; a language without trusted text has the limit of all trusted rows. Null languages are a language of their own.
    Null and empty texts have the average score and stay. Without trusted text everything stays. Rows with equal ids are
    trusted alike, a null id never. An empty table gives an empty result.
    """
    blocks = write_blocks(df, text_col, "quality")
    shards = max(1, -(-blocks.count() // 8))
    ids = blocks.mapInArrow(partial(_send_ids, id_col=id_col), "block bigint, row int, id bigint")
    good = trusted.select(F.col(trusted.columns[0]).cast("bigint").alias("id")).where("id IS NOT NULL").distinct()
    marks = materialise(ids.join(good, "id").groupBy("block").agg(F.collect_list("row").alias("trusted")), "quality-trusted")
    marked = blocks.join(marks, "block", "left")
    sent = marked.mapInArrow(partial(_send_grams, text=text_col, order=order, shards=shards), "shard bigint, block bigint, grams binary, counts binary")
    sent = materialise(sent, "quality-grams")
    counts = materialise(sent.groupBy("shard").applyInPandas(_sum_counts, "model string, gram bigint, n bigint"), "quality-counts")
    model = estimate(counts.where("n > 0"), order, "quality")
    known = score_grams(counts.select("model", "gram"), *model, order).select("gram", "logp", F.pmod("gram", F.lit(shards)).alias("shard"))
    answers = sent.select("shard", "block", "grams").groupBy("shard").cogroup(known.groupBy("shard")).applyInPandas(_answer, "block bigint, grams binary, logs binary")
    answers = materialise(answers.groupBy("block").agg(F.collect_list(F.struct("grams", "logs")).alias("answers")), "quality-answers")
    scores = marked.join(answers, "block", "left").mapInArrow(partial(_score, text=text_col, lang=lang_col, order=order), "block bigint, row int, lang string, nats double, units bigint, trusted boolean")
    scores = materialise(scores, "quality-scores")
    return QualityClassifier(df, blocks, materialise(_limits(scores, quantile, room, prior_units), "quality-decisions"))
