"""Periodic run detection: Lyndon arrays by Baier grouping, Lyndon roots extended into maximal runs.

A run is a stretch with a smallest period of at most half its length that cannot be extended. By the runs theorem, in the
order of symbols in which the symbol behind a run is less than the one a period before it (or in the opposite order), a
Lyndon root of the run is the longest Lyndon word at its position. So the longest Lyndon words of all positions under both
orders, each extended to both sides as far as its period goes, are all runs there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalframe.llm.common import CRC32_SQL, crc32_sql

LEAST_WORDS = 12
_MIX, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def lyndon_lengths(codes: list[int], symbols: int) -> list[int]:
    """Length of the longest Lyndon word at each position; ``codes`` are 0 to ``symbols`` - 1.

    Phase one of Baier's suffix sorting: groups of suffixes with a common context, at first one symbol, are taken from the
    highest to the lowest. The nearest suffix to the left of a member that is in a lower group gets the member's context
    behind its own, so it moves to a new group just above its own; one with more such members moves higher. When a group's
    turn comes, its context is the longest Lyndon word of its members.
    """
    n = len(codes)
    members: list[list[int]] = [[] for _ in range(symbols)]
    for i, c in enumerate(codes, 1):
        members[c].append(i)
    group = [-1, *codes]
    size = [1] * symbols
    left_in = [len(m) for m in members]
    lower, upper = list(range(-1, symbols - 1)), list(range(1, symbols + 1))
    # the positions whose group has not had its turn, linked; 0 and n + 1 are the ends
    left, right = list(range(-1, n + 1)), list(range(1, n + 3))
    out = [0] * (n + 1)
    g = symbols - 1
    while g >= 0:
        length, before, many = size[g], [], False
        for i in members[g]:
            if group[i] != g:
                continue
            out[i] = length
            a, b = left[i], right[i]
            right[a] = b
            left[b] = a
            if a:
                if before and before[-1] == a:
                    many = True
                before.append(a)
        if many:
            counts: dict[int, int] = {}
            for a in before:
                counts[a] = counts.get(a, 0) + 1
            moves: dict[tuple[int, int], list[int]] = {}
            for a, k in counts.items():
                moves.setdefault((-k, group[a]), []).append(a)
            moving = [(h, -k, at) for (k, h), at in sorted(moves.items())]
        elif len(before) == 1:
            moving = [(group[before[0]], 1, before)]
        else:
            single: dict[int, list[int]] = {}
            for a in before:
                single.setdefault(group[a], []).append(a)
            moving = [(h, 1, at) for h, at in single.items()]
        for h, k, at in moving:
            if len(at) == left_in[h]:  # nothing stays behind: the group itself gets the longer context
                size[h] += k * length
                continue
            new, above = len(members), upper[h]
            left_in[h] -= len(at)
            left_in.append(len(at))
            members.append(at)
            size.append(size[h] + k * length)
            lower.append(h)
            upper.append(above)
            upper[h] = new
            if above < len(lower):
                lower[above] = new
            for a in at:
                group[a] = new
        g = lower[g]
    return out[1:]


class _Extensions:
    """Common extensions of pairs of positions, by prefix hashes and a binary search."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        with np.errstate(over="ignore"):
            mixed = (codes.astype(np.uint64) + np.uint64(1)) * _MIX
            mixed ^= mixed >> np.uint64(29)
            self.powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _BASE))), dtype=np.uint64)
            self.sums = np.concatenate(([np.uint64(0)], np.cumsum(mixed * self.powers[:n], dtype=np.uint64)))
        self.n = n

    def _equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[a + length] - self.sums[a]) * self.powers[b - a] == self.sums[b + length] - self.sums[b]

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal symbols from a and b (a < b) on."""
        return self._search(self.n - b, lambda at, length: self._equal(a[at], b[at], length))

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal symbols that end just before a and b (a < b)."""
        return self._search(a, lambda at, length: self._equal(a[at] - length, b[at] - length, length))

    @staticmethod
    def _search(most: np.ndarray, equal) -> np.ndarray:
        found = np.zeros(len(most), np.int64)
        for shift in range(int(most.max(initial=0)).bit_length() - 1, -1, -1):
            tried = found + (1 << shift)
            at = np.flatnonzero(tried <= most)
            at = at[equal(at, tried[at])]
            found[at] = tried[at]
        return found


def _exact(codes: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The stretch around ``at`` with this period, symbol by symbol."""
    odd = np.flatnonzero(codes[:-period] != codes[period:])
    k = int(np.searchsorted(odd, at))
    return (int(odd[k - 1]) + 1 if k else 0), (int(odd[k]) if k < len(odd) else len(codes) - period) + period


def find_runs(codes: np.ndarray, least: int = LEAST_WORDS) -> np.ndarray:
    """All runs of ``least`` symbols or more as rows (start, length, period), by start, then period.

    A run repeats each stretch of half its least length one period on, so only what lies between the first and the last
    stretch that is found twice is sorted.
    """
    none = np.zeros((0, 3), np.int64)
    gram = (least + 1) // 2
    grams = len(codes) - gram + 1
    if grams < 2:
        return none
    with np.errstate(over="ignore"):
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * _MIX
        mixed ^= mixed >> np.uint64(29)
        hashes = mixed[:grams].copy()
        for k in range(1, gram):
            hashes = hashes * _BASE + mixed[k : k + grams]
    ordered = np.sort(hashes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return none
    at = np.flatnonzero(np.isin(hashes, twice))
    first = int(at[0])
    inner = codes[first : int(at[-1]) + gram]
    ranks = np.unique(inner, return_inverse=True)[1]
    symbols = int(ranks.max()) + 1
    starts = np.arange(len(inner))
    periods = [np.array(lyndon_lengths(order.tolist(), symbols)) for order in (ranks, symbols - 1 - ranks)]
    begin, period = np.concatenate((starts, starts)), np.concatenate(periods)
    # one of both sides has to go on for half of what is missing
    need = (np.maximum(period, least - period) + 1) // 2
    lce = _Extensions(inner)
    fits = (begin + period + need <= len(inner)) & lce._equal(begin, np.minimum(begin + period, len(inner)), np.where(begin + period + need <= len(inner), need, 0))
    fits |= (begin >= need) & lce._equal(np.maximum(begin - need, 0), np.maximum(begin - need, 0) + period, np.where(begin >= need, need, 0))
    begin, period = begin[fits], period[fits]
    start = begin - lce.backward(begin, begin + period)
    end = begin + period + lce.forward(begin, begin + period)
    long = end - start >= np.maximum(least, 2 * period)
    found = np.unique(np.stack((start[long], period[long], end[long], begin[long]), axis=1), axis=0)
    runs = {}
    for s, p, e, b in found.tolist():
        if (s, p) in runs:
            continue
        if not (np.array_equal(inner[s : e - p], inner[s + p : e]) and (s == 0 or inner[s - 1] != inner[s - 1 + p]) and (e == len(inner) or inner[e] != inner[e - p])):
            s, e = _exact(inner, b, p)  # hashes were equal by chance
        if e - s >= max(least, 2 * p):
            runs[s, p] = e - s
    return np.array([(s + first, length, p) for (s, p), length in sorted(runs.items())], np.int64).reshape(-1, 3)


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_SCHEMA = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("runs", _RUNS), ("collapsed", pa.binary())])


def _solve(text: bytes | None, least: int) -> tuple[int, list[dict], bytes]:
    words = (text or b"").split()
    known: dict[bytes, int] = {}
    codes = np.fromiter(map(known.setdefault, words, count()), np.int64, len(words))
    runs = find_runs(codes, least)
    if len(runs):
        edges = np.zeros(len(words) + 1, np.int64)
        np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
    return len(codes), [{"start": s, "length": n, "period": p} for s, n, p in runs.tolist()], b" ".join(words)


def _solve_rows(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        solved = [_solve(t.as_py(), least) for t in batch.column("text")]
        n, runs, kept = zip(*solved) if solved else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(runs, _RUNS), pa.array(kept, pa.binary())], schema=_SCHEMA)


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per row: id, n_words, runs (array of start, length, period in words, by start, then period), collapsed.

    Words are what ASCII white space parts. A run is a maximal stretch of words with a smallest period q and at least
    max(``least_words``, 2 q) words. ``collapsed`` holds the words that no run contains after its first q words, joined by
    one space, as UTF-8 bytes. Texts are judged one by one and whole, so nothing is shuffled. A null, empty or blank
    text has no words and no runs; null ids stay null; repeated rows give repeated results. Other columns are ignored,
    whatever their names; an empty table gives an empty one.
    """
    if least_words < 2:
        raise ValueError("a run has two words at least")
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(partial(_solve_rows, least=least_words), "id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary")


def with_repeats(df: DataFrame) -> DataFrame:
    """Documents of which a tenth, by a checksum of the id, goes on periodically from some word on."""
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    checksum = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def repeated(w):
        n, g = F.size(w).cast("bigint"), F.floor(checksum / 10)
        a = g % F.nullif(n, F.lit(0))
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), at), " "))

    # the words are bound once: as a plain column they would be worked out for every word
    text = F.when(checksum % 10 == 0, F.coalesce(F.get(F.transform(F.array(words), repeated), 0), F.col("text"))).otherwise(F.col("text"))
    return df.select("doc_id", text.alias("text"))


# Runs from pairs of equal grams of six words: consecutive pairs at one distance are a stretch with that period.
ORACLE = f"""
WITH RECURSIVE {CRC32_SQL},
d AS (SELECT doc_id, {crc32_sql("doc_id::VARCHAR")} AS h, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents, crc_table),
e AS (SELECT *, len(w)::BIGINT AS n, h // 10 AS g FROM d),
f AS (SELECT *, CASE WHEN n > 0 AND h % 10 = 0 THEN g % n ELSE n END AS a, CASE WHEN n > 0 THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM e),
r AS (SELECT doc_id, n, list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) AS w FROM f),
grams AS (SELECT doc_id, unnest(range(n - 5)) AS i, w FROM r WHERE n > 5),
keyed AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 6], ' ') AS gram FROM grams),
pairs AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM keyed a JOIN keyed b ON a.doc_id = b.doc_id AND a.gram = b.gram AND a.i < b.i),
stretches AS (SELECT doc_id, q, min(i) AS s, count(*) + 5 + q AS l
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pairs) GROUP BY doc_id, q, k),
runs AS (SELECT doc_id, s, l, min(q) AS q FROM stretches WHERE l >= greatest({LEAST_WORDS}, 2 * q) GROUP BY doc_id, s, l),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
best AS (SELECT doc_id, count(*) AS n_runs, arg_min(s, (-l, s, q)) AS start, max(l) AS length, arg_min(q, (-l, s, q)) AS period,
  string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS said FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM (SELECT doc_id, unnest(range(n)) AS i, unnest(w) AS word FROM r)
  ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT r.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
  (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM r LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

