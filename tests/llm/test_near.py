"""SimHash and embedding near-deduplication against brute force."""

import random

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from tidalframe.llm import simhash
from tidalframe.llm.components import SALTS, components
from tidalframe.llm.embedding_dedup import embedding_classes
from tidalframe.llm.queries import QUERIES
from tidalframe.llm.simhash import near_links, simhash_classes, simhash_dedup

SMALL = "/root/testdata/sf0.001"


def classes(n, links):
    """Least member reachable, by index."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes) > 0)


def simhash_brute(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    root = classes(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min(x for x in (least.get(r), i) if x is not None) if (i is not None or r in least) and not (i is None and least.get(r) is None) else None
    return sorted(((i, f"{p:016x}", least[r]) for (i, _), p, r in zip(rows, prints, root)), key=repr)


def test_simhash_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op1_simhash_dedup"](spark, SMALL).collect()), key=repr) == simhash_brute(rows)


def test_simhash_defined_results(spark):
    rows = [(5, None), (3, ""), (9, " \n"), (7, "A b"), (2, "a B"), (2, "a B"), (8, "É x y z " * 4000), (None, "alone in the world"), (4, "one")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'c' AS id", "1 AS fingerprint", "2 AS component")
    got = sorted(((r.id, f"{r.fingerprint & (1 << 64) - 1:016x}", r.component) for r in simhash_classes(df).collect()), key=repr)
    assert got == simhash_brute(rows)
    kept = simhash_dedup(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([3, 2, 8, 4, None], key=repr)
    empty = df.where("false")
    assert simhash_classes(empty).count() == 0 and simhash_dedup(empty).count() == 0


@pytest.mark.parametrize("bucket_rows", [1, 4, 64])
def test_near_links_of_dense_fingerprints(spark, bucket_rows):
    """Balls of fingerprints around a few centres: buckets overflow and are cut again."""
    rng = random.Random(bucket_rows)
    prints = set()
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(150):
            x = centre
            for _ in range(rng.randrange(6)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fingerprint bigint")
    mask = (1 << 64) - 1
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & mask).bit_count() <= 3}
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in near_links(df, 3, bucket_rows).collect()} == want


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(60)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(80)] + [(5, 5), (None, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b", "t").collect()}
    pairs = [(a, b) for a, b in edges if a is not None and a != b]
    root = classes(500, pairs)
    assert got == {x: root[x] for p in pairs for x in p}


def test_components_of_a_star(spark):
    """Edges of a hub are dealt to many tasks, whether it is the least or the largest node."""
    n = 20_000
    for hub in (-1, n):
        edges = spark.range(n).selectExpr(f"{hub} AS a", "id AS b")
        got = components(edges, "a", "b", "t").groupBy("component").count().collect()
        assert [(r[0], r[1]) for r in got] == [(min(hub, 0), n + 1)]
    dealt = spark.range(n).selectExpr("-1L AS u", "id AS v").groupBy("u", F.pmod(F.xxhash64("v"), F.lit(SALTS))).count()
    assert dealt.count() == SALTS and dealt.agg(F.max("count")).first()[0] < 2 * n / SALTS


def embedding_brute(rows, threshold=0.93):
    def good(v):
        return v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v)

    links = []
    for i, (_, a, x) in enumerate(rows):
        for j, (_, b, y) in enumerate(rows[:i]):
            if a is not None and a == b and good(x) and good(y) and len(x) == len(y):
                p, q = np.array(x, float), np.array(y, float)
                if p @ q / np.linalg.norm(p) / np.linalg.norm(q) >= threshold:
                    links.append((i, j))
    root = classes(len(rows), links)
    count = np.bincount(np.array(links, int).ravel(), minlength=len(rows))
    least = {}
    for (i, _, _), r in zip(rows, root):
        least[r] = min(i, least.get(r, i))
    return sorted((i, int(n), least[r]) for (i, _, _), n, r in zip(rows, count, root))


@pytest.mark.parametrize("dim", [3, 16, 64])
def test_embedding_recall(spark, dim):
    rng = np.random.default_rng(dim)
    rows = []
    for k in range(60):
        centre = rng.normal(size=dim)
        centre /= np.linalg.norm(centre)
        for _ in range(4):
            noise = rng.normal(size=dim) / np.sqrt(dim)
            rows.append((len(rows) * 3 % 991, k % 3, (centre + 0.25 * noise).tolist()))
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    want = embedding_brute(rows)
    got = sorted(tuple(r) for r in embedding_classes(df).collect())
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[1] for g in got) >= 0.97 * sum(w[1] for w in want)


def test_embedding_defined_results(spark):
    x, nan = [1.0, 0.0, 0.5], float("nan")
    rows = [(1, 1, x), (2, 1, x), (3, 1, [2.0, 0.0, 1.0]), (4, 2, x), (5, None, x), (6, 1, None), (7, 1, [0.0, 0.0, 0.0]), (8, 1, [nan, 1.0, 0.0]), (9, 1, [float("inf"), 1.0, 0.0]), (10, 1, []), (11, 1, [1.0, 0.0]), (2, 1, x)]
    df = spark.createDataFrame(rows + [(12, 1, [None, 1.0, 2.0])], "vec_id bigint, label int, embedding array<double>").selectExpr("*", "'z' AS id", "0 AS rep", "0 AS space")
    assert sorted(tuple(r) for r in embedding_classes(df).collect()) == embedding_brute(rows + [(12, 1, [None, 1.0, 2.0])])
    assert embedding_classes(df.where("false")).count() == 0
    # more equal-direction vectors than a chunk holds
    many = [(i, 1, [1.0 + i / 1000, 0.001 * i, 0.2]) for i in range(1200)]
    got = embedding_classes(spark.createDataFrame(many, "vec_id bigint, label int, embedding array<double>")).collect()
    p = np.array([m[2] for m in many])
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    want = ((p @ p.T) >= 0.93).sum(axis=1) - 1
    assert {r.component for r in got} == {0}
    assert sum(r.n_links for r in got) >= 0.99 * want.sum() and all(r.n_links <= want[r.id] for r in got)


def test_embedding_query(spark):
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in QUERIES["op7_embedding_dedup"](spark, SMALL).collect())
    assert [(a, b, c) for a, b, c, _ in got] == embedding_brute(rows)
    assert all(k == (a == c) for a, _, c, k in got)


def test_exploded_tables_are_not_broadcast(spark, monkeypatch):
    """Spark sizes a table of many variants a row like the rows themselves, so small ones would all look fit for a broadcast."""
    plans, kept = [], simhash.materialise

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, name)

    monkeypatch.setattr(simhash, "materialise", seen)
    prints = spark.range(300).selectExpr("shiftleft(id * 7919, 20) AS fingerprint")
    links = simhash.near_links(prints, bucket_rows=16)
    plans.append(links._jdf.queryExecution().executedPlan().toString())
    assert len(plans) >= 2 and "SortMergeJoin" in plans[0]
    assert not [p for p in plans if "Broadcast" in p]
