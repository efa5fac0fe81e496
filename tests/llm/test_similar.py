"""SimHash near-deduplication by similarity against brute force and true shingle similarity."""

import random

import numpy as np
import pytest
import xxhash

from tests.llm.test_near import classes
from tidalframe.llm.simhash_similar import (
    BITS, SEGMENTS, WILDCARDS, WORDS, bit_counts, shared_keys, shingle_hashes, similar_dedup, similar_keys, similar_links, sketch, sketches, texts_by_node,
)

SMALL = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1


def shingles(text, size=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def plain_sketch(text):
    """Number of shingles and fingerprint as one number, with plain integers."""
    grams = {xxhash.xxh64_intdigest(" ".join(s), 42) for s in shingles(text)}
    lean = [0] * BITS
    for g in grams:
        for w in range(WORDS):
            x = (g + (w + 1) * 0x9E3779B97F4A7C15) & MASK
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
            x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
            x ^= x >> 31
            for b in range(64):
                lean[64 * w + b] += 1 if x >> b & 1 else -1
    return len(grams), sum(1 << b for b in range(BITS) if lean[b] > 0)


def similar_brute(texts):
    """Index of the first member of each text's class: links are all pairs with a shingle similarity of 0.8 or more."""
    known = [shingles(t) for t in texts]
    links = []
    for a, x in enumerate(known):
        for b, y in enumerate(known[:a]):
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
                links.append((a, b))
    return classes(len(texts), links)


def links_of(df, **options):
    """Pairs of ids."""
    texts = texts_by_node(df, "doc_id", "text")
    table = sketches(texts).cache()
    number = {r.node: r.id for r in table.select("id", "node").collect()}
    return [tuple(sorted((number[r.a], number[r.b]))) for r in similar_links(texts, table, **options).collect()]


def test_sketch_equals_plain_integers():
    rng = random.Random(2)
    for words in (0, 1, 4, 5, 30, 700):
        text = " ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(words))
        n, value = sketch(text)[0], sum((int(w) & MASK) << 64 * k for k, w in enumerate(sketch(text)[1]))
        assert (n, value) == plain_sketch(text)
    # more rows than one byte lane and one part hold
    hashes = np.arange(255 * 64 * 2 + 7, dtype=np.uint64)
    assert bit_counts(hashes).tolist() == sum(bit_counts(hashes[i : i + 100]) for i in range(0, len(hashes), 100)).tolist()


def test_dedup_equals_brute_force(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    root = similar_brute([t for _, t in rows])
    got = sorted(r.doc_id for r in similar_dedup(spark.read.parquet(f"{SMALL}/documents.parquet")).collect())
    assert got == [i for k, (i, _) in enumerate(rows) if root[k] == k]


def test_copies_of_every_similarity(spark):
    """Edited copies: nearly all from 0.9 on are found, none below 0.7, and unlike texts stay."""
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(4000)]
    bands, rows = {"high": [], "low": []}, []
    for base in range(300):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(150, 500))]
        copy = list(words)
        for _ in range(max(1, int(len(words) * rng.choice([0.003, 0.008, 0.06, 0.1])))):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        a, b = " ".join(words), " ".join(copy)
        same = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
        rows += [(2 * base, a), (2 * base + 1, b)]
        bands["high" if same >= 0.9 else "low" if same < 0.7 else "between"].append(2 * base + 1) if same >= 0.9 or same < 0.7 else None
    kept = {r.doc_id for r in similar_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {i for i, _ in rows if i % 2 == 0} <= kept
    assert len(bands["high"]) > 60 and len(bands["low"]) > 60
    assert sum(i not in kept for i in bands["high"]) >= 0.95 * len(bands["high"])
    assert all(i in kept for i in bands["low"])


@pytest.mark.parametrize("bucket_rows", [1, 8, 64])
def test_large_groups_of_near_copies(spark, bucket_rows):
    """Near copies of two texts, and unlike texts, whatever a bucket may hold."""
    rng = random.Random(5)
    rows = []
    for base in range(2):
        words = [f"b{base}x{k}" for k in range(300)]
        for c in range(120):
            rows.append((len(rows), " ".join(words[:c] + [f"c{c}"] + words[c + 1 :])))
    rows += [(len(rows) + k, " ".join(rng.choice("abcdefgh") + str(rng.randrange(99)) for _ in range(80))) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    root = classes(len(rows), links_of(df, bucket_rows=bucket_rows))
    assert root == [0] * 120 + [120] * 120 + list(range(240, 280))
    table = sketches(texts_by_node(df, "doc_id", "text"))
    assert similar_keys(table).groupBy("node").count().where(f"count <> {SEGMENTS * (WILDCARDS + 1)}").isEmpty()


def edited(rng, words, changes, name):
    """The words with changes far from each other, so that each change alters five shingles."""
    copy = list(words)
    for at in rng.sample(range(len(words) // 6), changes):
        copy[6 * at + 3] = f"{name}at{at}"
    return " ".join(copy)


def test_star_of_edits_equals_all_pairs(spark):
    """One page and 3,000 edits of it: each is like the page, few are like each other; no edit is lost."""
    rng = random.Random(9)
    words = [f"p{k}" for k in range(400)]
    texts = [" ".join(words)] + [edited(rng, words, 7, f"e{c}") for c in range(3000)]
    same = lambda a, b: len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    assert same(texts[0], texts[1]) > 0.82 and same(texts[1], texts[2]) < 0.76
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    root = classes(len(texts), links_of(df, chunk_shingles=300_000))
    assert root == [0] * 3001


def test_links_are_the_pairs_from_0_8_on(spark):
    """Pairs with a true shingle similarity of 0.8 or more, and none below, however near."""
    rng, rows, true = random.Random(3), [], []
    for base in range(300):
        words = [f"b{base}x{k}" for k in range(404)]
        a, b = " ".join(words), edited(rng, words, 1 + base % 14, "e")
        rows += [(2 * base, a), (2 * base + 1, b)]
        true.append(len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)))
    found = set(links_of(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert found == {(2 * k, 2 * k + 1) for k in range(300) if true[k] >= 0.8}
    assert sum(0.8 <= t < 0.83 for t in true) > 15 and sum(0.76 < t < 0.8 for t in true) > 15


def test_defined_results(spark):
    rows = [(5, None), (3, ""), (9, " \n"), (7, "A b"), (2, "a B"), (2, "a B"), (8, "É x y z " * 4000), (None, "alone in the world"), (4, "one"), (2, "two"), (1, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'c' AS id", "1 AS node", "2 AS n", "3 AS words", "4 AS key")
    kept = similar_dedup(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()), key=repr) == sorted(
        [(1, None), (2, "a B"), (2, "two"), (8, "É x y z " * 4000), (None, "alone in the world"), (4, "one")], key=repr
    )
    assert similar_dedup(df.where("false")).count() == 0
    assert len(shingle_hashes("a b c d e f a b c d e")) == 6  # seven windows, one twice


def test_keys_are_shuffled_once(spark, capsys):
    """Buckets with all their members, by one shuffle of (node, key)."""
    rng = random.Random(4)
    rows = [(k, " ".join(["a b c d e f g h"] * 3 + [rng.choice("xyz")])) for k in range(12)] + [(50, "alone"), (51, None), (52, "")]
    table = sketches(texts_by_node(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text"))
    table = spark.createDataFrame(table.collect(), table.schema)
    nodes = {}
    for r in similar_keys(table).collect() + [r for t in table.collect() for r in [(t.node, k) for k in t.bands]]:
        nodes.setdefault(r[1], set()).add(r[0])
    want = {k: v for k, v in nodes.items() if len(v) > 1}
    found = shared_keys(table)
    found.explain()
    assert capsys.readouterr().out.count("Exchange") == 1
    got = {}
    for r in found.collect():
        got.setdefault(r.key, set()).add(r.node)
        assert (r["size"], r.least) == (len(want[r.key]), min(want[r.key]))
    assert got == want and len(want) > 20
