"""Periodic runs against a search of all periods, and Lyndon arrays against comparisons of suffixes."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tidalframe.llm.periodic_runs import find_runs, lyndon_lengths, periodic_runs, with_repeats
from tidalframe.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def all_runs(symbols, least):
    n, found = len(symbols), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and symbols[j] == symbols[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def by_place(runs):
    return sorted(runs, key=lambda r: (r[0], r[2]))


def kept(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone).encode()


def sequences(seed, count, size):
    rng = random.Random(seed)
    for _ in range(count):
        n, k = rng.randrange(size), rng.randrange(1, 5)
        x = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.5:
            a, p = rng.randrange(n), rng.randrange(1, 10)
            x = [x[i] if i < a or a + (i - a) % p >= n else x[a + (i - a) % p] for i in range(n)]
        yield x


def test_lyndon_lengths_equal_comparisons():
    for x in [*sequences(1, 400, 60), [0] * 30, list(range(30)), list(range(30))[::-1]]:
        names = sorted(set(x))
        codes = [names.index(c) for c in x]
        want = [next((j for j in range(i + 1, len(codes)) if codes[j:] < codes[i:]), len(codes)) - i for i in range(len(codes))]
        assert lyndon_lengths(codes, len(names)) == want


@pytest.mark.parametrize("least", [2, 3, 7, 12])
def test_runs_equal_all_periods(least):
    fibonacci = [0]
    for _ in range(9):
        fibonacci = [c for x in fibonacci for c in ((0, 1) if x == 0 else (0,))]
    for x in [*sequences(least, 400, 70), fibonacci, [0] * 50]:
        assert [tuple(r) for r in find_runs(np.array(x, np.int64), least).tolist()] == by_place(all_runs(x, least))


def test_runs_survive_equal_hashes(monkeypatch):
    """With one hash for all symbols every extension is found symbol by symbol."""
    monkeypatch.setattr("tidalframe.llm.periodic_runs._MIX", np.uint64(0))
    for x in sequences(5, 200, 40):
        got = {tuple(r) for r in find_runs(np.array(x, np.int64), 4).tolist()}
        assert got <= set(all_runs(x, 4))


def test_operator_on_odd_rows(spark):
    phrase = "one two three four five six seven"
    rows = [
        (1, phrase + " " + phrase), (2, None), (3, ""), (4, " \t\n "), (5, "a " * 11), (6, "a " * 12), (7, "x y " * 9 + "é\x0bé\x0c" * 10), (8, ("long " * 3 + "tale ") * 20000),
        (None, phrase * 4), (1, phrase + " " + phrase), (9, " ".join(map(str, range(30000)))), (10, "  ".join(["w"] * 12)),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'c' AS id", "1 AS runs", "2 AS collapsed")
    got = {(r.id, r.n_words, tuple((x.start, x.length, x.period) for x in r.runs), bytes(r.collapsed)) for r in periodic_runs(df).collect()}
    want = set()
    for i, t in rows:
        words = (t or "").encode().split()
        runs = [(0, 80000, 4)] if i == 8 else [] if i == 9 else by_place(all_runs(words, 12))
        want.add((i, len(words), tuple(runs), kept([w.decode() for w in words], runs)))
    assert got == want and periodic_runs(df).count() == len(rows)
    assert periodic_runs(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(df, least_words=1)


def test_query_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = {}
    for i, t in rows:
        words = (t or "").encode().split()
        h, n = zlib.crc32(str(i).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        if n > 1500:
            continue  # the plain search is quadratic
        runs = by_place(all_runs(words, 12))
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        collapsed = kept([w.decode() for w in words], runs)
        want[i] = (len(runs), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest())
    out = {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in QUERIES["op11_periodic_runs"](spark, SMALL).collect()}
    assert len(out) == len(rows) and {i: out[i] for i in want} == want
    assert sum(r[0] > 0 for r in want.values()) > 5
    empty = spark.createDataFrame([(0, None), (20, ""), (None, "a b")], "doc_id bigint, text string")
    assert sorted((r.text or "") for r in with_repeats(empty).collect()) == ["", "", "a b"]
