"""Repeated windows of a fixed length, found without sending every window.

Every window of ``length`` units (bytes or words) names one anchor: the leftmost of its ``gram``-unit grams with the
least hash. Equal windows name equal grams at equal offsets, so only windows with the same anchor gram can be equal.
Consecutive windows with one anchor form a fragment, whose text holds all of them.

1. Each block sends its distinct anchor grams; grams seen only once in the corpus are dropped. Grams with more distinct
   fragments than a set number are hot: their fragments are cut into single windows, each an anchor of its own by its
   hash, and windows seen only once are dropped as well. So a phrase that stands in a third of all texts in
   other surroundings is spread over all shards.
2. Each block sends its distinct fragments on the remaining anchors, with the first place (id, start) of each, to the
   shard of the anchor. A solver compares the windows of a shard and answers one bit per window: does it start
   earlier than this first place?
3. Each block marks the windows of all its fragments: later copies within the block, and those with the bit set.

A gram, fragment or copy that fills a third of the corpus is sent once per block. All windows are judged on the input.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalframe.llm.blocks import unpack, write_blocks
from tidalframe.llm.common import known_id, materialise

_BASE = 0x9E3779B97F4A7C15 | 1
_PLACE_BITS = np.uint64(30)
_WRAP = (1 << 64) - 1


@dataclass
class Units:
    """Documents of one block as a run of hashed units; document i holds units bounds[i]:bounds[i + 1].

    ``cut`` gives the texts of unit runs, ``kept`` what a mask leaves of a document.
    """

    hashes: np.ndarray
    bounds: np.ndarray
    cut: Callable[[np.ndarray, np.ndarray], list[bytes]]
    kept: Callable[[int, np.ndarray], bytes]


@dataclass
class Fragments:
    """Fragments of a shard: distinct per block, ordered as they came."""

    anchor: np.ndarray
    offset: np.ndarray
    windows: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    texts: list[bytes] = field(default_factory=list)


def read_octets(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each begins and the last one ends."""
    column = table.column("text").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def rolling(x: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash (modulo 2^64) of every run of ``length`` values."""
    out, held, power, size = None, 0, x, 1
    with np.errstate(over="ignore"):
        while size <= length:
            factor = np.uint64(pow(_BASE, size, 1 << 64))
            if length & size:
                if out is None:
                    out = power
                else:
                    n = len(x) - held - size + 1
                    out = out[:n] * factor + power[held : held + n]
                held += size
            power = power[: len(power) - size] * factor + power[size:] if len(power) > size else power[:0]
            size *= 2
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def find_fragments(units: Units, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """First and last window start, anchor gram, anchor offset, content hash of every fragment, in text order."""
    n = len(units.hashes)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none.astype(np.uint64), none, none.astype(np.uint64)
    grams = rolling(units.hashes, gram)
    with np.errstate(over="ignore"):
        order = grams * np.uint64(0xD6E8FEB86659FD93)
        order ^= order >> np.uint64(32)
        order *= np.uint64(0xD6E8FEB86659FD93)
    order = (order >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
    place = (sliding_min(order, length - gram + 1) & np.uint64((1 << int(_PLACE_BITS)) - 1)).astype(np.int64)
    ends = np.repeat(units.bounds[1:], np.diff(units.bounds))[: len(place)]
    starts = np.flatnonzero(np.arange(len(place)) + length <= ends)
    if not len(starts):
        return none, none, none.astype(np.uint64), none, none.astype(np.uint64)
    place = place[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(place) != 0) | (np.diff(starts) != 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    lo, hi, at = starts[first], starts[last], place[first]
    return lo, hi, grams[at], at - lo, _content(rolling(units.hashes, length), lo, hi, at)


def _content(whole: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the fragments from window ``lo`` to window ``hi`` with the anchor at ``at``."""
    with np.errstate(over="ignore"):
        content = whole[lo] * np.uint64(0xC2B2AE3D27D4EB4F) + whole[hi] * np.uint64(0x165667B19E3779F9)
        return (content ^ (content >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (hi - lo).astype(np.uint64) * np.uint64(1 << 7 | 1) + (at - lo).astype(np.uint64)


def _holds(wanted: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``wanted``."""
    if not len(wanted):
        return np.zeros(len(x), bool)
    return wanted[np.minimum(np.searchsorted(wanted, x), len(wanted) - 1)] == x


def single_windows(units: Units, lo: np.ndarray, hi: np.ndarray, offset: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Every window of the given fragments as a fragment: start, anchor offset, content hash."""
    n = hi - lo + 1
    at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place = np.repeat(lo + offset, n)
    return at, place - at, _content(rolling(units.hashes, length), at, at, place) if len(at) else np.zeros(0, np.uint64)


class Block:
    """Fragments of one block on wanted anchors, and which of them are distinct. Wanted windows of hot anchors are fragments."""

    def __init__(self, ids: np.ndarray, units: Units, told: dict, length: int, gram: int, shards: int):
        found = find_fragments(units, length, gram)
        on = _holds(_wanted(told["grams"]), found[2])
        hot = _holds(_wanted(told["hot"]), found[2])
        lo, hi, anchor, offset, content = (x[on & ~hot] for x in found)
        if hot.any():
            at, place, key = single_windows(units, found[0][hot], found[1][hot], found[3][hot], length)
            one = _holds(_wanted(told["windows"]), key)
            at, place, key = at[one], place[one], key[one]
            lo, hi, offset = np.append(lo, at), np.append(hi, at), np.append(offset, place)
            anchor, content = np.append(anchor, key), np.append(content, key)
        self.lo, self.hi = lo, hi
        self.row = np.searchsorted(units.bounds, self.lo, side="right") - 1
        self.doc = ids[self.row]
        start = self.lo - units.bounds[self.row]
        order = np.lexsort((start, self.doc))
        _, index, inverse = np.unique(content[order], return_index=True, return_inverse=True)
        shard = (anchor[order[index]] % np.uint64(shards)).astype(np.int64)
        by_shard = np.argsort(shard, kind="stable")
        place = np.empty(len(index), np.int64)
        place[by_shard] = np.arange(len(index))
        self.first = order[index][by_shard]  # distinct fragments by shard, each at its first place
        self.distinct = np.empty(len(order), np.int64)
        self.distinct[order] = place[inverse]
        self.shard = shard[by_shard]
        self.windows = self.hi - self.lo + 1
        self.anchor, self.offset, self.start = anchor, offset, start


def _wanted(lists) -> np.ndarray:
    return np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in lists])) if lists else np.zeros(0, np.uint64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_GRAMS = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())])
_SENT = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("fragments", pa.binary())])
_RESULT = pa.schema([
    ("id", pa.int64()), ("n_units", pa.int64()), ("n_removed", pa.int64()),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary()),
])
RESULT = "id bigint, n_units bigint, n_removed bigint, spans array<struct<start: bigint, end: bigint>>, kept binary"


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("id").to_numpy().astype(np.int64)


def _by_shard(block: int, keys: np.ndarray, counts: np.ndarray, shards: int) -> pa.RecordBatch:
    shard = (keys % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    keys, counts, shard = keys[order], counts[order].astype(np.uint32), shard[order]
    names, begin = np.unique(shard, return_index=True)
    parts = list(zip(begin, np.append(begin[1:], len(shard))))
    return _batch(_GRAMS, names.tolist(), [block] * len(parts), [keys[a:b].tobytes() for a, b in parts], [counts[a:b].tobytes() for a, b in parts])


def _send_grams(batches, read: Callable, length: int, gram: int, shards: int):
    """Anchor grams with twice the number of their distinct fragments, plus one if they occur again in the block."""
    for row in _rows(batches):
        _, _, anchor, _, content = find_fragments(read(unpack(row["payload"])), length, gram)
        grams, again = np.unique(anchor, return_counts=True)
        one = np.unique(content, return_index=True)[1]
        distinct = np.bincount(np.searchsorted(grams, anchor[one]), minlength=len(grams))
        yield _by_shard(row["block"], grams, distinct * 2 + (again > 1), shards)


def _send_windows(batches, read: Callable, length: int, gram: int, shards: int):
    """Windows of hot anchors by their hash."""
    for row in _rows(batches):
        units, hot = read(unpack(row["payload"])), _wanted(row["hot"])
        lo, hi, anchor, offset, _ = find_fragments(units, length, gram)
        on = _holds(hot, anchor)
        keys, again = np.unique(single_windows(units, lo[on], hi[on], offset[on], length)[2], return_counts=True)
        yield _by_shard(row["block"], keys, again > 1, shards)


def _repeated(frame: pd.DataFrame, most: int) -> pd.DataFrame:
    """Grams of a shard that occur twice or more, for each block that holds them; hot are those with over ``most`` fragments."""
    grams = np.concatenate([np.frombuffer(x, np.uint64) for x in frame["grams"]])
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in frame["counts"]]).astype(np.int64)
    owner = np.repeat(np.arange(len(frame)), [len(x) // 8 for x in frame["grams"]])
    order = np.argsort(grams, kind="stable")
    new = np.concatenate(([True], grams[order][1:] != grams[order][:-1]))
    group, first = np.cumsum(new) - 1, np.flatnonzero(new)
    again = ((np.add.reduceat(counts[order] % 2, first) > 0) | (np.bincount(group) > 1))[group]
    hot = np.zeros(len(grams), bool)
    hot[order] = (np.add.reduceat(counts[order] // 2, first) > most)[group]
    found = np.sort(order[again])
    names, begin = np.unique(owner[found], return_index=True)
    parts = [found[a:b] for a, b in zip(begin, np.append(begin[1:], len(found)))]
    return pd.DataFrame({
        "block": frame["block"].to_numpy()[names],
        "grams": [grams[x].tobytes() for x in parts],
        "hot": [grams[x[hot[x]]].tobytes() or None for x in parts],
    })


def _send_fragments(batches, read: Callable, length: int, gram: int, shards: int):
    for row in _rows(batches):
        table = unpack(row["payload"])
        units = read(table)
        block = Block(_ids(table), units, row, length, gram, shards)
        names, begin = np.unique(block.shard, return_index=True)
        out = []
        for a, b in zip(begin, np.append(begin[1:], len(block.shard))):
            f = block.first[a:b]
            texts = units.cut(block.lo[f], block.hi[f] + length)
            sent = (block.anchor[f], block.offset[f].astype(np.int32), block.windows[f].astype(np.int32), block.doc[f], block.start[f], np.array([len(t) for t in texts], np.int32), b"".join(texts))
            out.append(zstandard.ZstdCompressor(3).compress(pickle.dumps(sent)))
        yield _batch(_SENT, names.tolist(), [row["block"]] * len(names), out)


def _solve(frame: pd.DataFrame, solver: Callable[[Fragments, int], list[np.ndarray]], length: int) -> pd.DataFrame:
    """Answers of one shard, as packed bits per block."""
    parts = [pickle.loads(zstandard.ZstdDecompressor().decompress(x)) for x in frame["fragments"]]
    texts = []
    for part in parts:
        ends = np.cumsum(part[5]).tolist()
        texts += [part[6][b - n : b] for b, n in zip(ends, part[5].tolist())]
    bits = solver(Fragments(*(np.concatenate([p[i] for p in parts]) for i in range(5)), texts), length)
    out, at = [], 0
    for part in parts:
        out.append(np.packbits(np.concatenate(bits[at : at + len(part[0])])).tobytes())
        at += len(part[0])
    return pd.DataFrame({"block": frame["block"], "shard": frame["shard"], "bits": out})


def _remove(batches, read: Callable, length: int, gram: int, shards: int, same_doc: bool):
    for row in _rows(batches):
        table = unpack(row["payload"])
        ids, units = _ids(table), read(table)
        block = Block(ids, units, row, length, gram, shards)
        cover = np.zeros(len(units.hashes) + 1, np.int64)
        if len(block.lo):
            answers = {x["shard"]: x["bits"] for x in row["answers"]}
            names, begin = np.unique(block.shard, return_index=True)
            flags = []
            for s, a, b in zip(names.tolist(), begin, np.append(begin[1:], len(block.shard))):
                flags.append(np.unpackbits(np.frombuffer(answers[s], np.uint8), count=int(block.windows[block.first[a:b]].sum())).astype(bool))
            flags, counts = np.concatenate(flags), block.windows[block.first]
            begins = np.cumsum(counts) - counts
            n = block.windows
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            first = block.first[block.distinct]
            later = block.doc > block.doc[first] if not same_doc else (block.doc > block.doc[first]) | ((block.doc == block.doc[first]) & (block.start > block.start[first]))
            gone = flags[np.repeat(begins[block.distinct], n) + step] | np.repeat(later, n)
            at = (np.repeat(block.lo, n) + step)[gone]
            cover += np.bincount(at, minlength=len(cover)) - np.bincount(at + length, minlength=len(cover))
        removed = np.cumsum(cover[:-1]) > 0
        out = [[], [], [], [], []]
        for i, (a, b) in enumerate(zip(units.bounds[:-1].tolist(), units.bounds[1:].tolist())):
            mask = removed[a:b]
            edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0])))).tolist() if mask.any() else []
            out[0].append(int(ids[i]))
            out[1].append(b - a)
            out[2].append(int(mask.sum()))
            out[3].append([{"start": x, "end": y} for x, y in zip(edges[::2], edges[1::2])])
            out[4].append(units.kept(i, ~mask))
        yield _batch(_RESULT, *out)


def remove_repeats(
    df: DataFrame, id_col: str, text_col: str, length: int, gram: int, read: Callable[[pa.Table], Units], solver: Callable[[Fragments, int], list[np.ndarray]], name: str, same_doc: bool, most: int,
) -> DataFrame:
    """One row per row of ``df``: id, number of units, units removed, removed spans (in units), what is kept.

    ``same_doc``: a window that starts earlier in the same document counts as earlier too. ``most``: an anchor
    with more fragments (distinct ones of each block) is split by window; the result is the same.
    """
    spark = df.sparkSession
    blocks = write_blocks(df.select(known_id(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")), "text", name)
    shards = max(1, -(-blocks.count() // 4))
    run = dict(read=read, length=length, gram=gram, shards=shards)
    table = "shard bigint, block bigint, grams binary, counts binary"
    repeated = partial(_repeated, most=most)
    found = "block bigint, grams binary, hot binary"
    grams = blocks.mapInArrow(partial(_send_grams, **run), table).groupBy("shard").applyInPandas(repeated, found)
    # of a null in every shard collect_list keeps an empty list
    grams = materialise(grams.groupBy("block").agg(F.collect_list("grams").alias("grams"), F.collect_list("hot").alias("hot")), f"{name}-grams")
    hot = blocks.join(grams.where(F.size("hot") > 0).select("block", "hot"), "block")
    windows = hot.mapInArrow(partial(_send_windows, **run), table).groupBy("shard").applyInPandas(repeated, found)
    windows = windows.groupBy("block").agg(F.collect_list("grams").alias("windows"))
    hits = materialise(grams.join(windows, "block", "left"), f"{name}-windows")
    sent = blocks.join(hits, "block").mapInArrow(partial(_send_fragments, **run), "shard bigint, block bigint, fragments binary")
    answers = sent.groupBy("shard").applyInPandas(partial(_solve, solver=solver, length=length), "block bigint, shard bigint, bits binary")
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("shard", "bits")).alias("answers"))
    told = materialise(hits.join(answers, "block"), f"{name}-answers")
    return blocks.join(told, "block", "left").mapInArrow(partial(_remove, same_doc=same_doc, **run), RESULT)
