"""Substring and suffix-array deduplication against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tidalframe.llm import substring_dedup as substring_module
from tidalframe.llm.common import NULL_ID
from tidalframe.llm.fragments import Fragments, Units, find_fragments, single_windows
from tidalframe.llm.queries import QUERIES
from tidalframe.llm.substring_dedup import SuffixAutomaton, read_words, solve, substring_dedup
from tidalframe.llm.suffix_dedup import suffix_dedup

SMALL = "/root/testdata/sf0.001"


def brute(rows, window, split, same_doc):
    """rows: (id, text); every window's earliest place, then the covered units of each row."""
    first = {}
    docs = [(i, split(t)) for i, t in rows]
    for i, units in docs:
        for s in range(len(units) - window + 1):
            key, place = tuple(units[s : s + window]), (i, s if same_doc else 0)
            first[key] = min(first.get(key, place), place)
    out = []
    for i, units in docs:
        gone = [False] * len(units)
        for s in range(len(units) - window + 1):
            if first[tuple(units[s : s + window])] < (i, s if same_doc else 0):
                gone[s : s + window] = [True] * window
        out.append((i, units, gone))
    return out


def digest(rows, joiner):
    out = set()
    for i, units, gone in rows:
        kept = joiner([u for u, g in zip(units, gone) if not g])
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.add((i, len(units), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def words(text):
    return (text or "").encode().split()


def octets(text):
    return list((text or "").encode())


def texts(seed, n, letters="ab ", size=60):
    rng = random.Random(seed)
    out = ["".join(rng.choice(letters) for _ in range(rng.randrange(size))) for _ in range(n)]
    return out + [None, "", " \t\n", "a" * 500, "b a " * 200, out[0] * 5, out[0] * 5, "é ü " * 90]


@pytest.mark.parametrize("window", [1, 2, 5, 13])
def test_substring_equals_brute_force(spark, window):
    rows = [(k * 7 % 1009, t) for k, t in enumerate(texts(window, 60))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'clash' AS id", "1 AS block")
    got = {(r.id, r.n_units, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in substring_dedup(df, window=window).collect()}
    assert got == digest(brute(rows, window, words, False), b" ".join)


@pytest.mark.parametrize("length", [3, 8, 21, 100])
def test_suffix_equals_brute_force(spark, length):
    rows = [(k * 7 % 1009, t) for k, t in enumerate(texts(length, 60))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.id, r.n_units, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_dedup(df, length=length).collect()}
    assert got == digest(brute(rows, length, octets, True), bytes)


@pytest.mark.parametrize("op,window,split,joiner,same", [(substring_dedup, 13, words, b" ".join, False), (suffix_dedup, 100, octets, bytes, True)])
@pytest.mark.parametrize("most", [0, 20])
def test_hot_anchors_equal_brute_force(spark, op, window, split, joiner, same, most):
    """One phrase in every text in other surroundings, repeated passages around it in some."""
    rng = random.Random(most)
    some = lambda n: " ".join(rng.choice(["sea", "reef", "coral", "tide", "kelp", "sand"]) + str(rng.randrange(50)) for _ in range(n))
    phrase, passage = "all of the rights in this text are reserved by us", some(40)
    rows = [(k * 7 % 1009, f"{some(9)} {phrase} {some(9)}") for k in range(120)]
    rows += [(2000 + k, f"{some(k % 5)} {passage} {phrase} {passage} {some(6)}") for k in range(20)]
    rows += [(3000 + k, rows[k][1]) for k in range(10)]
    got = op(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), most=most)
    got = {(r.id, r.n_units, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got.collect()}
    assert got == digest(brute(rows, window, split, same), joiner)


def test_hot_anchor_is_spread_over_shards():
    """The windows of one anchor in other surroundings have keys of their own."""
    rng = np.random.default_rng(5)
    phrase = rng.integers(1, 1 << 62, 5, dtype=np.uint64)
    parts = [np.concatenate((rng.integers(1, 1 << 62, 8, dtype=np.uint64), phrase, rng.integers(1, 1 << 62, 8, dtype=np.uint64))) for _ in range(300)]
    units = Units(np.concatenate(parts), np.arange(301) * 21, lambda a, b: b"", lambda i, m: b"")
    lo, hi, _, offset, _ = find_fragments(units, 13, 5)
    keys = single_windows(units, lo, hi, offset, 13)[2]
    assert len(keys) == 2700 == len(set(keys.tolist()))
    assert np.bincount((keys % np.uint64(10)).astype(int)).max() < 400


@pytest.mark.parametrize("op", [substring_dedup, suffix_dedup])
def test_defined_results(spark, op):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert op(empty).count() == 0
    odd = spark.createDataFrame([(None, None), (1, None), (1, "x"), (1, "x")], "doc_id bigint, text string")
    assert sorted((r.n_units, r.n_removed) for r in op(odd).collect()) == [(0, 0), (0, 0), (1, 0), (1, 0)]
    long = "word number " * 3000
    twice = spark.createDataFrame([(None, long), (5, long)], "doc_id bigint, text string")
    kept = {r.id: len(r.kept) for r in op(twice).collect()}
    assert kept[5] > 0 and kept[max(kept)] == 0


def test_automaton_owners():
    a = SuffixAutomaton()
    a.add("abcab", 7)
    a.add("xabc", 3)
    a.close()
    assert a.least_owners("zabcabx", 3) == [NULL_ID, 3, 7, 7, NULL_ID]


def test_words_are_read_together(monkeypatch):
    """Words as bytes.split() has them, equal hashes for equal words only; no call for each word but very long ones."""
    calls, one = [], substring_module.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(substring_module.xxhash, "xxh3_64_intdigest", lambda x: calls.append(1) or one(x))
    rng = random.Random(3)
    docs = ["", "end", "begin next", " \t\n\x0b\x0c\r ", "a\x1cb\x85c\u00a0d  e\n", "\0 \0\0 \0a a a\0 \0a\0", "last"]
    docs += [" ".join("x" * n + end for n in range(200) for end in ("", "y", "\0"))]
    docs += ["".join(rng.choice("ab\0é \t\n") for _ in range(rng.randrange(90))) for _ in range(300)]
    table = pa.table({"text": pa.array(docs)}).slice(1)
    units = read_words(table)
    split = [t.encode().split() for t in docs[1:]]
    flat = [w for doc in split for w in doc]
    assert units.bounds.tolist() == np.cumsum([0] + [len(doc) for doc in split]).tolist()
    assert units.cut(np.arange(len(flat)), np.arange(1, len(flat) + 1)) == flat
    assert len(set(units.hashes.tolist())) == len(set(flat)) == len(set(zip(units.hashes.tolist(), flat)))
    for i, doc in enumerate(split):
        assert units.kept(i, np.ones(len(doc), bool)) == b" ".join(doc)
        assert units.kept(i, np.arange(len(doc)) % 3 == 1) == b" ".join(doc[1::3])
    assert len(calls) == sum(len(w) > 64 for w in flat)


def test_automata_hold_one_anchor(monkeypatch):
    """Fragments of other anchors cannot share a window, so they do not share an automaton."""
    built = []

    class Seen(SuffixAutomaton):
        def __init__(self):
            super().__init__()
            built.append([])

        def add(self, sequence, owner):
            built[-1].append(b" ".join(sequence))
            super().add(sequence, owner)

    monkeypatch.setattr(substring_module, "SuffixAutomaton", Seen)
    texts = [b"a b c d", b"x b c d", b"p q r", b"a b c d", b"p q r"]
    anchor, doc = np.array([7, 7, 9, 7, 9], np.uint64), np.array([5, 3, 8, 4, NULL_ID])
    windows = np.array([2, 2, 1, 2, 1], np.int32)
    late = solve(Fragments(anchor, windows, windows, doc, doc, texts), 3)
    assert [x.tolist() for x in late] == [[True, True], [False, False], [False], [False, True], [True]]
    assert sorted(map(sorted, built)) == [[b"a b c d", b"x b c d"], [b"p q r"]]


@pytest.mark.parametrize("name,window,split,joiner,same", [("op4_substring_dedup", 13, words, b" ".join, False), ("op8_suffix_array_dedup", 100, octets, bytes, True)])
def test_queries_equal_brute_force(spark, name, window, split, joiner, same):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    out = QUERIES[name](spark, SMALL)
    want = digest(brute(rows, window, split, same), joiner)
    if "n_spans" in out.columns:
        assert {tuple(r) for r in out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()} == want
    else:
        assert {tuple(r) for r in out.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()} == {(a, b, c, e) for a, b, c, _, e in want}
