"""SimHash near-deduplication with deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalframe.llm.common import known_id, materialise
from tidalframe.llm.components import components

SHINGLE_WORDS = 3
MAX_BITS = 3
# A bucket with more fingerprints is cut again by its remaining bits.
BUCKET_ROWS = 64


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of the word shingles of a text, A-Z lower-cased; zero without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        begins = np.concatenate(([0], ends[:-1]))
        grams = [joined[a:b] for a, b in zip(begins[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist())]
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64, len(grams))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * counts > len(hashes)).astype(np.uint8), bitorder="little").view(np.int64)[0])


_FINGERPRINTS = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("fingerprint", pa.int64())])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(t.as_py(), shingle) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), pa.array(prints, pa.int64())], schema=_FINGERPRINTS)


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """Table (id, mark, fingerprint), one row per row; ``mark`` is a hash of the text."""
    text = F.col(text_col).cast("string")
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    return rows.mapInArrow(partial(_fingerprints, shingle=shingle), "id bigint, mark bigint, fingerprint bigint")


def _variants(rows: DataFrame, width: int) -> DataFrame:
    """Keys of every one-wildcard variant of both halves of the free bits lo..lo+width of a fingerprint.

    ``side`` is the bit under the wildcard; a variant without wildcard has side 2. ``rest`` is where the bits start
    that are still free inside the bucket.
    """
    half = width // 2
    rows = rows.select("fp", "bucket", "lo", F.explode(F.sequence(F.lit(0), F.lit(2 * half + 1))).alias("j"))
    rows = rows.selectExpr("fp", "bucket", f"lo + {half} * (j div {half + 1}) AS cut", f"lo + {half} * (1 - j div {half + 1}) AS rest", f"CAST(j % {half + 1} AS INT) AS wild")
    rows = rows.selectExpr("fp", "bucket", "cut", "CAST(rest AS INT) AS rest", "wild", f"shiftrightunsigned(fp, CAST(cut AS INT)) & {(1 << half) - 1}L AS segment")
    return rows.selectExpr(
        "fp", "rest", f"IF(wild = {half}, 2, CAST(shiftright(segment, wild) & 1 AS INT)) AS side",
        f"xxhash64(bucket, cut, wild, IF(wild = {half}, segment, segment & ~shiftleft(1L, wild))) AS key",
    )


def near_links(prints: DataFrame, max_bits: int = MAX_BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Pairs (a, b) of distinct 64-bit fingerprints that differ in ``max_bits`` (at most 3) bits or fewer.

    Of two halves, one differs in at most one bit, so both fingerprints have an equal half or an equal one-wildcard
    variant with different bits under the wildcard. A bucket with more than ``bucket_rows`` members is indexed again by
    its 32 free bits, and then by the 16 free of those, where at most 2^11 fingerprints can share a key.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments with one wildcard each find at most 3 differing bits")
    rows = prints.select(F.col("fingerprint").alias("fp"), F.lit(0).cast("bigint").alias("bucket"), F.lit(0).alias("lo"))
    found = []
    for width in (64, 32, 16):
        keyed = _variants(rows, width)
        sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        # Spark takes an exploded table for as small as what it is made from and would broadcast it: neither side may be
        keyed = materialise(keyed.join(sizes.hint("merge"), "key"), "simhash-buckets")
        small = keyed if width == 16 else keyed.where(F.col("n") <= bucket_rows)
        left = small.where("side <> 1").select("key", "side", F.col("fp").alias("a"))
        right = small.where("side <> 0").select("key", F.col("side").alias("other"), F.col("fp").alias("b"))
        close = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits) & (F.when(F.col("side") == 2, (F.col("other") == 2) & (F.col("a") < F.col("b"))).otherwise(F.col("other") == 1))
        found.append(left.join(right.hint("merge"), (left["key"] == right["key"]) & close).select("a", "b"))
        rows = keyed.where(F.col("n") > bucket_rows).selectExpr("fp", "key AS bucket", "rest AS lo").distinct()
        if width == 16 or rows.isEmpty():
            break
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links.distinct()


def _classes(df: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows, and by fingerprint the least id and the first row (known id, mark) of its component."""
    prints = materialise(fingerprints(df, id_col, text_col, shingle), "simhash-prints")
    row = F.struct(known_id("id").alias("id"), F.col("mark").alias("mark"))
    distinct = materialise(prints.groupBy("fingerprint").agg(F.min("id").alias("least"), F.min(row).alias("row")), "simhash-distinct")
    linked = components(near_links(distinct, max_bits), "a", "b", "simhash")
    classes = distinct.join(linked, distinct["fingerprint"] == linked["node"], "left").select("fingerprint", "least", "row", F.coalesce("component", "fingerprint").alias("class"))
    firsts = classes.groupBy("class").agg(F.min("least").alias("component"), F.min("row").alias("first"))
    return prints, classes.join(firsts, "class").select("fingerprint", "component", "first")


def simhash_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row: id, fingerprint, component (least id reachable over links of ``max_bits`` bits or fewer).

    Null and wordless texts have fingerprint zero and link like any other; fewer words than a shingle are one shingle.
    Equal texts and repeated rows share a fingerprint and so a component. A null id stays null and is never the least,
    unless no other is there (then the component is null). Other columns are ignored; an empty table gives none.
    """
    prints, classes = _classes(df, id_col, text_col, shingle, max_bits)
    return prints.join(classes, "fingerprint").select("id", "fingerprint", "component")


def simhash_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``df`` that stay: of each component the one with the least id, null ids last.

    Of rows with equal ids the one whose text has the least hash; of rows equal in id and text any one.
    """
    classes = _classes(df.select(id_col, text_col), id_col, text_col, shingle, max_bits)[1]
    return keep_rows(df, classes.select("first.id", "first.mark").distinct(), id_col, text_col)


def keep_rows(df: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``df`` for every chosen (id, mark): the id with nulls last and the hash of the text."""
    first = materialise(chosen.withColumnsRenamed({"id": "_id", "mark": "_mark"}), "simhash-kept")
    row = F.struct(*df.columns).alias("_row")
    marked = df.select(known_id(id_col).alias("_id"), F.xxhash64(F.col(text_col).cast("string")).alias("_mark"), row)
    kept = marked.join(first, ["_id", "_mark"], "left_semi")
    return kept.groupBy("_id", "_mark").agg(F.first("_row").alias("_row")).select("_row.*")
