"""SimHash near-deduplication by similarity: a fingerprint long enough to tell a shingle similarity of 0.8 from less.

Three of 64 bits find only the closest copies. Here a text has ``SEGMENTS`` segments of ``SEGMENT_BITS`` bits. Near copies
nearly always have a segment that differs in one bit at most, and that bit nearly always lies among the ``WILDCARDS`` bits
whose counts are nearest to a tie in both texts. So every segment gives one exact key and one key per wildcard on such a bit.
Pairs near the limit share no segment more often, so a text also has ``BANDS`` keys of ``BAND_ROWS`` least shingle hashes
each: a pair at 0.8 shares one with a chance above 0.9999. Keys depend on the text alone, so which pairs meet does not depend
on the table. A pair that meets is linked if its shingles have the similarity, and only then; the fingerprints decide
whose shingles are looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidalframe.llm.common import known_id, materialise, remove_scratch, table_path
from tidalframe.llm.components import components
from tidalframe.llm.simhash import keep_rows

SHINGLE_WORDS = 5
SIMILARITY = 0.8
SEGMENTS = 16
SEGMENT_BITS = 32
BITS = SEGMENT_BITS * SEGMENTS
WORDS = BITS // 64
WILDCARDS = 5
# Keys of least hashes: a pair of similarity s misses all with a chance of (1 - s ** BAND_ROWS) ** BANDS, 0.00007 at 0.8.
BANDS = 24
BAND_ROWS = 5
# Buckets up to this size make their pairs by a join, larger ones in pairs of chunks.
BUCKET_ROWS = 64
# Shingles of a chunk of a large bucket (8 bytes each): two chunks meet in one task.
CHUNK_SHINGLES = 500_000
# Pairs of texts with at least so many shingles must agree in bits before their shingles are compared, within so many
# deviations of what the similarity gives.
FILTER_SHINGLES = 64
DEVIATIONS = 6

_LANES = np.uint64(0x0101010101010101)


def filter_bits(similarity: float) -> int:
    """Differing bits that a pair of this similarity practically never passes."""
    part = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(BITS * part + DEVIATIONS * math.sqrt(BITS * part * (1 - part)))


def shingle_hashes(text: str | None, shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of the different word shingles, A-Z lower-cased; fewer words than a shingle are one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = np.concatenate(([0], ends[:-1]))
    size = min(shingle, len(words))
    spans = zip(begins[: len(words) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist())
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in spans), np.uint64))


def _spread(x: np.ndarray) -> np.ndarray:
    """Mix the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many shingles set each of the ``BITS`` bits; byte lanes of up to 255 rows are added at once."""
    counts = np.zeros((8 * WORDS, 8), np.int64)
    steps = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), 255 * 64):
        part = _spread(hashes[at : at + 255 * 64, None] + steps)
        starts = np.arange(0, len(part), 255)
        for k in range(8):
            lanes = np.add.reduceat((part >> np.uint64(k)) & _LANES, starts, axis=0)
            counts[:, k] += lanes.view(np.uint8).reshape(len(starts), -1).sum(axis=0, dtype=np.int64)
    return counts.ravel()


_FACTORS = _spread(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key of each band: a hash of ``BAND_ROWS`` least values, each under an order of the shingles of its own."""
    least = np.full(BANDS * BAND_ROWS, np.uint64(2**64 - 1))
    for at in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[at : at + 2048, None] * _FACTORS).min(axis=0))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, BAND_ROWS).T:
        keys = _spread(keys ^ row) * np.uint64(0x9E3779B97F4A7C15)
    return keys.view(np.int64)


def sketch(text: str | None, shingle: int = SHINGLE_WORDS) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(number of different shingles, fingerprint as 64-bit words, wildcard bits of each segment, band keys) of a text.

    A bit is set if over half of the shingles set it.
    """
    hashes = shingle_hashes(text, shingle)
    lean = 2 * bit_counts(hashes) - len(hashes)
    words = np.packbits(lean > 0, bitorder="little").view(np.int64)
    wild = np.argsort(np.abs(lean.reshape(SEGMENTS, SEGMENT_BITS)), axis=1, kind="stable")[:, :WILDCARDS]
    return len(hashes), words, wild.astype(np.int8).ravel(), band_keys(hashes)


_SKETCH = "id bigint, node bigint, n bigint, words array<bigint>, wild array<tinyint>, bands array<bigint>"


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows)))


def _sketches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            piece = batch.slice(at, 500)
            sizes, *lists = zip(*(sketch(t.as_py(), shingle) for t in piece.column("text")))
            columns = [piece.column("id"), piece.column("node"), pa.array(sizes, pa.int64()), *map(_lists, lists)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "node", "n", "words", "wild", "bands"])


def _shingles(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            piece = batch.slice(at, 500)
            found = [shingle_hashes(t.as_py(), shingle).view(np.int64) for t in piece.column("text")]
            yield pa.RecordBatch.from_arrays([piece.column("node"), _lists(found)], names=["node", "shingles"])


def texts_by_node(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, node, text): ``node`` is a hash of the text."""
    text = F.col(text_col).cast("string")
    return df.select(known_id(id_col).alias("id"), F.xxhash64(text).alias("node"), text.alias("text"))


def sketches(texts: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """Table (node, id, n, words, wild, bands), one row per different text with its least id. Sketches are shuffled, texts are not."""
    every = texts.mapInArrow(partial(_sketches, shingle=shingle), _SKETCH)
    rest = [F.first(c).alias(c) for c in ("n", "words", "wild", "bands")]
    return every.groupBy("node").agg(F.min("id").alias("id"), *rest)


def shingle_lists(texts: DataFrame, table: DataFrame, nodes: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """Table (node, shingles) of some nodes, read from the texts again: only of texts that are compared are shingles moved."""
    wanted = materialise(table.select("node", "id").join(nodes, "node", "left_semi"), "similar-wanted")
    found = texts.join(wanted, ["node", "id"], "left_semi").select("node", "text").mapInArrow(partial(_shingles, shingle=shingle), "node bigint, shingles array<bigint>")
    return materialise(found.groupBy("node").agg(F.first("shingles").alias("shingles")), "similar-shingles")


def similar_keys(table: DataFrame) -> DataFrame:
    """Rows (node, key): of every segment its bits, whole and with a wildcard on each of its wildcard bits."""
    rows = table.select("node", "words", "wild", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS * (WILDCARDS + 1) - 1))).alias("j"))
    rows = rows.selectExpr(
        "node", f"CAST(j div {WILDCARDS + 1} AS INT) AS segment", "words",
        f"IF(j % {WILDCARDS + 1} = {WILDCARDS}, 63, CAST(get(wild, CAST(j div {WILDCARDS + 1} AS INT) * {WILDCARDS} + j % {WILDCARDS + 1}) AS INT)) AS bit",
    )
    rows = rows.selectExpr("node", "segment", "bit", f"shiftrightunsigned(get(words, CAST(segment div 2 AS INT)), segment % 2 * 32) & {(1 << SEGMENT_BITS) - 1}L AS value")
    # bit 63 is never set in a value, so that "no wildcard" clears nothing
    return rows.selectExpr("node", "(value & ~shiftleft(1L, bit)) | shiftleft(CAST(bit AS BIGINT), 32) | shiftleft(CAST(segment AS BIGINT), 40) AS key")


def shared_keys(table: DataFrame) -> DataFrame:
    """Rows (key, node, size, least, x, y) of the keys that several nodes have; ``x`` and ``y`` are hashes of all members.

    Nearly all keys are one node's own, so every row is shuffled once, as two numbers, and those rows end there.
    """
    keys = similar_keys(table).unionByName(table.select("node", F.explode("bands").alias("key")))
    # hashes are made behind the shuffle
    dealt = keys.repartition("key").select("key", "node", F.xxhash64("node").alias("h"), F.xxhash64("node", F.lit(1)).alias("g"))
    bucket = Window.partitionBy("key")
    sums = {"size": F.count("*"), "least": F.min("node"), "x": F.bit_xor("h"), "y": F.bit_xor("g")}
    return dealt.select("key", "node", *[e.over(bucket).alias(c) for c, e in sums.items()]).where("size > 1")


def _close(pairs: DataFrame, texts: DataFrame, table: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The pairs (a, b) whose shingles have this Jaccard similarity or more."""
    left, right = (table.selectExpr(f"node AS {end}", f"n AS {end}_n", f"words AS {end}_words") for end in "ab")
    differ = reduce(lambda x, y: x + y, [F.bit_count(F.get("a_words", F.lit(k)).bitwiseXOR(F.get("b_words", F.lit(k)))) for k in range(WORDS)])
    sizes = F.least("a_n", "b_n") + 1e-9 >= similarity * F.greatest("a_n", "b_n")
    bits = (F.least("a_n", "b_n") < FILTER_SHINGLES) | (differ <= filter_bits(similarity))
    near = materialise(pairs.join(left, "a").join(right, "b").where(sizes & bits).select("a", "b"), "similar-near")
    lists = shingle_lists(texts, table, near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), shingle)
    left, right = (lists.selectExpr(f"node AS {end}", f"shingles AS {end}_shingles") for end in "ab")
    both = near.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("a_shingles", "b_shingles")))
    return both.where(F.col("common") + 1e-9 >= similarity * (F.size("a_shingles") + F.size("b_shingles") - F.col("common"))).select("a", "b")


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _chunk_links(table: pa.Table, similarity: float) -> pa.Table:
    """Links that join what is connected by pairs of a chunk, or of two: every member reached meets all not yet reached.

    Members of a class are connected already.
    """
    table = table.combine_chunks()
    node, of, side = (table.column(c).to_numpy() for c in ("node", "class", "chunk"))
    lists, prints = (pa.concat_arrays(table.column(c).chunks) for c in ("shingles", "words"))
    words = prints.flatten().to_numpy().view(np.uint64).reshape(len(node), WORDS)
    ends = np.concatenate(([0], np.cumsum(np.diff(lists.offsets.to_numpy()))))
    ids = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
    n, limit, one = np.diff(ends), filter_bits(similarity), (side == side[0]).all()
    mark, waiting, out = np.zeros(len(ids), bool), np.ones(len(node), bool), []
    for seed in range(len(node)):
        queue = np.flatnonzero(waiting & (of == of[seed])).tolist() if waiting[seed] else []
        waiting[queue] = False
        while queue:
            x = queue.pop()
            rest = np.flatnonzero(waiting if one else waiting & (side != side[x]))
            rest = rest[np.minimum(n[rest], n[x]) + 1e-9 >= similarity * np.maximum(n[rest], n[x])]
            differ = np.bitwise_count(words[rest] ^ words[x]).sum(axis=1)
            near = (np.minimum(n[rest], n[x]) < FILTER_SHINGLES) | (differ <= limit)
            mark[ids[ends[x] : ends[x + 1]]] = True
            for y in rest[near].tolist():
                if not waiting[y]:
                    continue
                common = np.count_nonzero(mark[ids[ends[y] : ends[y + 1]]])
                if common + 1e-9 >= similarity * (n[x] + n[y] - common):
                    out.append((int(node[x]), int(node[y])))
                    more = np.flatnonzero(waiting & (of == of[y])).tolist()
                    waiting[more] = False
                    queue += more
            mark[ids[ends[x] : ends[x + 1]]] = False
    return pa.Table.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], schema=_LINKS)


def _large_links(rows: DataFrame, texts: DataFrame, table: DataFrame, similarity: float, chunk_shingles: int, shingle: int) -> DataFrame:
    """Links between the classes of each large bucket: all pairs of its chunks, each in a group of two chunks at most."""
    lists = shingle_lists(texts, table, rows.select("node").distinct(), shingle)
    rows = rows.join(table.select("node", "n", "words"), "node").join(lists, "node")
    counts = rows.groupBy("key").agg(F.ceil(F.sum(F.col("n") + 1) / chunk_shingles).alias("chunks"))
    rows = rows.join(counts, "key").withColumn("chunk", F.expr("pmod(xxhash64(node, key), chunks)"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
    rows = rows.select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "node", "class", "chunk", "words", "shingles")

    def links(group: pa.Table) -> pa.Table:
        return _chunk_links(group, similarity)

    return rows.groupBy("key", "i", "j").applyInArrow(links, "a bigint, b bigint")


def similar_links(
    texts: DataFrame, table: DataFrame, similarity: float = SIMILARITY, bucket_rows: int = BUCKET_ROWS, chunk_shingles: int = CHUNK_SHINGLES, shingle: int = SHINGLE_WORDS,
) -> DataFrame:
    """Links (a, b) that connect what all pairs of nodes connect that share a key and have the similarity.

    First every bucket compares its members with its least one, so near copies cost a row each and not all their pairs.
    Then members that are not connected so far meet in every bucket, those of up to ``bucket_rows`` members in a join
    and larger ones chunk by chunk: no pair of a bucket stays unseen unless its ends are connected anyway.
    """
    spark = table.sparkSession
    shared = materialise(shared_keys(table), "similar-shared", path := table_path(spark, "similar-shared"))
    # of buckets with the same members one is enough
    groups = shared.where("node = least").groupBy("size", "least", "x", "y").agg(F.min("key").alias("key"))
    rows = shared.join(materialise(groups.select("key"), "similar-groups"), "key", "left_semi").select("key", "node", "size", "least")
    rows = materialise(rows, "similar-buckets")
    remove_scratch(spark, path)
    met = rows.where("node <> least").selectExpr("least AS a", "node AS b").distinct()
    links = materialise(_close(met, texts, table, similarity, shingle), "similar-links")
    linked = components(links, "a", "b", "similar-first")
    rows = rows.where("size > 2").join(linked, "node", "left").select("key", "node", "size", "least", F.coalesce("component", "node").alias("class"))
    several = rows.groupBy("key").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x < y").select("key")
    rows = materialise(rows.join(several, "key", "left_semi"), "similar-open")
    small = rows.where(F.col("size") <= bucket_rows).where("node <> least")
    a, b = (small.selectExpr("key", f"node AS {end}", f"class AS {end}_class") for end in "ab")
    pairs = a.join(b, "key").where("a < b AND a_class <> b_class").select("a", "b").distinct()
    more = _close(pairs, texts, table, similarity, shingle).unionByName(_large_links(rows.where(F.col("size") > bucket_rows), texts, table, similarity, chunk_shingles, shingle))
    return links.unionByName(materialise(more, "similar-links")).distinct()


def similar_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``df`` that stay: of each component of similar texts the one with the least id, null ids last.

    Equal texts always link. Null and wordless texts link with each other; fewer words than a shingle are one shingle, so
    such texts link when all their words are equal. Of rows with equal ids the one whose text has the least hash stays, of
    rows equal in id and text any one. All columns stay as they are; an empty table gives none.
    """
    texts = texts_by_node(df, id_col, text_col)
    table = materialise(sketches(texts, shingle), "similar-sketches")
    linked = components(similar_links(texts, table, similarity, shingle=shingle), "a", "b", "similar")
    classes = table.select("node", "id").join(linked, "node", "left").withColumn("class", F.coalesce("component", "node"))
    first = classes.groupBy("class").agg(F.min(F.struct("id", "node")).alias("first"))
    return keep_rows(df, first.selectExpr("first.id AS id", "first.node AS mark"), id_col, text_col)
