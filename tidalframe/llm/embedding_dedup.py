"""Embedding near-deduplication with spherical-cap filters."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalframe.llm.common import materialise, partitions
from tidalframe.llm.components import components

THRESHOLD = 0.93
# Directions of each of the two codes; filters are all pairs of them.
CODE = 256
# Filters that a vector exceeds on average. The README states the measured recall at cosine 0.93.
FILTERS = 24
# A vector that exceeds fewer filters takes so many of its best ones.
FLOOR = 24
LEAST_DIM = 16
CHUNK = 512
_SEED = 7


@lru_cache(maxsize=8)
def product_code(dim: int, code: int, filters: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Rotation, both codes and the cap height that a random vector exceeds for ``filters`` of code^2 directions on average.

    Short vectors are turned inside a larger space, so that neither half holds nearly all of one.
    """
    rng = np.random.Generator(np.random.PCG64([_SEED, dim]))
    size = max(LEAST_DIM, dim + dim % 2)
    rotation = np.linalg.qr(rng.normal(size=(size, size)))[0]
    codes = rng.normal(size=(2, code, size // 2))
    codes /= np.linalg.norm(codes, axis=2, keepdims=True) * np.sqrt(2)
    scores = []
    for x in rng.normal(size=(200, dim)):
        x = (x / np.linalg.norm(x)) @ rotation[:dim]
        scores.append(((codes[0] @ x[: size // 2])[:, None] + (codes[1] @ x[size // 2 :])[None, :]).ravel().astype(np.float32))
    return rotation[:dim], codes[0], codes[1], float(np.quantile(np.concatenate(scores), 1 - min(1.0, filters / code**2)))


def decode(vectors: np.ndarray, code: int = CODE, filters: int = FILTERS) -> list[np.ndarray]:
    """List-decode unit vectors: for each, all filters (i * code + j) whose direction it exceeds, ascending; ``FLOOR`` at least."""
    rotation, first, second, height = product_code(vectors.shape[1], code, filters)
    turned, half = vectors @ rotation, rotation.shape[1] // 2
    a, b = turned[:, :half] @ first.T, turned[:, half:] @ second.T
    order = np.argsort(-b, axis=1)
    out = []
    for x, y, o in zip(a, b, order):
        # partners of direction i are a prefix of the second code in falling order
        reach = np.searchsorted(-y[o], x - height, side="right")
        if reach.sum() < FLOOR:
            # the best sums are of i-th and j-th best with i * j <= FLOOR
            i, j = np.argsort(-x)[:FLOOR], o[:FLOOR]
            best = np.argpartition(-(x[i][:, None] + y[j][None, :]).ravel(), FLOOR)[:FLOOR]
            out.append(np.sort(i[best // len(j)] * code + j[best % len(j)]))
        else:
            out.append(np.sort(np.concatenate([i * code + o[: reach[i]] for i in np.flatnonzero(reach)])))
    return out


# Up to so many members, the pairs of all buckets are looked at together before a bucket is worked on its own.
SMALL = 24


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length, without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _with_links(x: np.ndarray, norm: np.ndarray, cuts: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the runs between the cuts hold a close pair; runs longer than SMALL may always do."""
    size = np.diff(cuts)
    group = np.repeat(np.arange(len(size)), size)
    found = size > SMALL
    for step in range(1, min(SMALL, int(size.max(initial=1)))):
        i = np.flatnonzero(group[step:] == group[:-step])
        i = i[~found[group[i]]]
        for at in range(0, len(i), 1 << 14):
            a = i[at : at + (1 << 14)]
            close = np.einsum("ij,ij->i", x[a], x[a + step]) >= (threshold - 1e-9) * norm[a] * norm[a + step]
            found[group[a[close]]] = True
    return found


_FILTERS = pa.schema([("rep", pa.int64()), ("space", pa.int64()), ("filter", pa.int32())])


def _filters(batches: Iterator[pa.RecordBatch], code: int, filters: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            part = batch.filter(pa.array(dims == dim))
            for at in range(0, part.num_rows, 2000):
                piece = part.slice(at, 2000)
                x = _matrix(piece.column("vec"))
                lists = decode(x / np.linalg.norm(x, axis=1, keepdims=True), code, filters)
                n = [len(f) for f in lists]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(piece.column("rep").to_numpy(), n)), pa.array(np.repeat(piece.column("space").to_numpy(), n)),
                    pa.array(np.concatenate(lists).astype(np.int32)),
                ], schema=_FILTERS)


_FOUND = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _verify_group(f: int, halves: np.ndarray, x: np.ndarray, norm: np.ndarray, reps: np.ndarray, copies: np.ndarray, lists: list, threshold: float):
    """Links of one bucket, or of two chunks of a large one: per vector its links first met here, and a root it reaches."""
    n = len(reps)
    close = (x @ x.T) / np.outer(norm, norm) >= threshold
    np.fill_diagonal(close, False)
    if halves.any() and not halves.all():
        close &= halves[:, None] != halves[None, :]
    if not close.any():
        return None
    # a pair is counted by the least filter that both exceed
    smaller = [[g for g in one if g < f] for one in lists]
    names = {g: k for k, g in enumerate(sorted({g for one in smaller for g in one}))}
    seen = np.zeros((n, max(1, len(names))), np.float32)
    for i, one in enumerate(smaller):
        seen[i, [names[g] for g in one]] = 1
    links = (close & (seen @ seen.T == 0)) @ copies
    root, before = np.arange(n), None
    while before is None or (root != before).any():
        before = root
        root = np.minimum(root, np.where(close, root[None, :], n).min(axis=1))
    on = np.flatnonzero(close.any(axis=1))
    return reps[on], links[on], reps[root[on]]


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Batches come sorted by (space, filter, pair); a group may run on into the next batch."""
    rest = None

    def work(table: pa.Table):
        keys = np.stack([table.column(c).to_numpy() for c in ("space", "filter", "pair")])
        cuts = np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [table.num_rows]))
        columns = table.combine_chunks()
        reps, copies, halves = (columns.column(c).to_numpy() for c in ("rep", "copies", "half"))
        vectors, lists = columns.column("vec").combine_chunks(), columns.column("filters").combine_chunks()
        lengths = pc.list_value_length(vectors).to_numpy()
        # runs of one vector length; a bucket never mixes lengths
        same = np.concatenate(([0], np.flatnonzero(np.diff(lengths)) + 1, [len(lengths)]))
        out = []
        for lo, hi in zip(same[:-1].tolist(), same[1:].tolist()):
            x = _matrix(vectors.slice(lo, hi - lo))
            norm = np.linalg.norm(x, axis=1)
            own = cuts[(cuts >= lo) & (cuts <= hi)] - lo
            for g in np.flatnonzero(_with_links(x, norm, own, threshold)).tolist():
                a, b = int(own[g]), int(own[g + 1])
                got = _verify_group(int(keys[1, lo + a]), halves[lo + a : lo + b], x[a:b], norm[a:b], reps[lo + a : lo + b], copies[lo + a : lo + b], lists.slice(lo + a, b - a).to_pylist(), threshold)
                if got is not None:
                    out.append(got)
        return [pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], schema=_FOUND)] if out else []

    for batch in batches:
        for at in range(0, batch.num_rows, 10000):
            piece = pa.Table.from_batches([batch.slice(at, 10000)])
            table = pa.concat_tables([rest, piece]) if rest is not None else piece
            last = [table.column(c)[-1].as_py() for c in ("space", "filter", "pair")]
            same = np.all([table.column(c).to_numpy() == v for c, v in zip(("space", "filter", "pair"), last)], axis=0)
            keep = table.num_rows - (int(np.argmin(same[::-1])) if not same.all() else table.num_rows)
            if keep:
                yield from work(table.slice(0, keep))
            rest = table.slice(keep)
    if rest is not None and rest.num_rows:
        yield from work(rest)


def embedding_classes(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    threshold: float = THRESHOLD, code: int = CODE, filters: int = FILTERS,
) -> DataFrame:
    """One row per row: id, n_links (other vectors linked directly), component (least id reachable, itself included).

    Vectors with equal non-null labels and equal length link at a double-precision cosine of ``threshold`` or more.
    Every vector is decoded to all filters it exceeds; pairs that share a filter are verified, so no false link exists
    and a true one is missed only if both share no filter. Null, empty and zero vectors and those with null or
    non-finite components link with nothing, as do null labels. Equal vectors stand for each other once and count as
    links of each other. A null id has a null component unless it is linked to another id. Other columns are ignored.
    """
    spark = df.sparkSession
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("vec"))
    finite = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("vec", lambda c: c != 0)
    rows = rows.withColumn("vec", F.when(F.coalesce(finite, F.lit(False)) & F.col("label").isNotNull(), F.col("vec")))
    distinct = rows.where("vec IS NOT NULL").groupBy("label", "vec").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    distinct = materialise(distinct.withColumns({"rep": F.monotonically_increasing_id(), "dim": F.size("vec"), "space": F.xxhash64("label", F.size("vec"))}), "caps-vectors")
    met = distinct.select("rep", "space", "dim", "vec").mapInArrow(partial(_filters, code=code, filters=filters), "rep bigint, space bigint, filter int")
    met = materialise(met, "caps-filters")
    # large buckets are cut into chunks, and pairs of chunks are compared
    sizes = met.groupBy("space", "filter").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / CHUNK).cast("int"))
    wanted = met.join(sizes, ["space", "filter"]).groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("filter", "parts"))).alias("caps"))
    sent = distinct.join(wanted, "rep").select("rep", "space", "vec", "copies", F.col("caps.filter").alias("filters"), F.explode("caps").alias("cap"))
    part = F.expr("CAST(pmod(xxhash64(rep), cap.parts) AS INT)")
    sent = sent.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cap.parts") - 1)))
    sent = sent.select(
        "rep", "space", "vec", "copies", "filters", F.col("cap.filter").alias("filter"),
        (F.least("part", "other") * F.col("cap.parts") + F.greatest("part", "other")).alias("pair"), F.expr("CAST(part > other AS INT)").alias("half"),
    )
    keys = ["space", "filter", "pair"]
    found = sent.repartition(partitions(spark), *keys).sortWithinPartitions(*keys).mapInArrow(partial(_verify, threshold=threshold), "rep bigint, links bigint, root bigint")
    found = materialise(found, "caps-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found, "rep", "root", "caps")
    known = distinct.join(links, "rep", "left").join(groups, distinct["rep"] == groups["node"], "left")
    known = known.select("label", "vec", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("group"))
    least = known.groupBy("group").agg(F.min("least").alias("component"))
    known = known.join(least, "group").select("label", "vec", "n_links", "component")
    out = rows.join(known, ["label", "vec"], "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"))
