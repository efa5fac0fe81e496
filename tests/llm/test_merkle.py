"""Merkle manifests against trees built level by level."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidalframe.llm.merkle import fold, leaf_digest, merkle_manifest, proof_text

SCHEMA = "doc_id bigint, lang string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes, fanout):
    """The root, and for every node its siblings by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = i // fanout * fanout
            paths[k].append((i - run, [n for j, n in enumerate(nodes[run : run + fanout], run) if j != i]))
        nodes = [sha("".join(nodes[j : j + fanout])) for j in range(0, len(nodes), fanout)]
        at = [i // fanout for i in at]
    return (nodes or [None])[0], paths


def manifest(rows, fanout):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is None, r[0] or 0, leaf(r), r[0]))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], fanout) for g in order}
    root, tops = tree([subs[g][0] for g in order], fanout)
    out = []
    for g, above in zip(order, tops):
        for x, path in zip(sorted(groups[g], key=lambda x: x[:3]), subs[g][1]):
            out.append((x[3], x[2], subs[g][0], root, [(p, s) for p, s in path + above]))
    return out


@pytest.mark.parametrize(("fanout", "size"), [(2, 1), (2, 2), (2, 300), (3, 33), (20, 300)])
def test_manifest_equals_plain_trees(spark, fanout, size):
    rng = random.Random(size * fanout)
    rows = [(rng.randrange(10**6), rng.choice(["en", "en", "en", "de", "Ä", "", None]), rng.choice(["a", "é😀", "", None, "x" * 3000])) for _ in range(size)]
    rows += [(None, "en", "n"), (None, "en", None), (7, "en", "z"), (7, "en", "y"), (7, "en", "y")] * (size > 2)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'a' AS leaf", "1 AS root", "2 AS `group`", "3 AS pos").repartition(5)
    out = merkle_manifest(df, ["doc_id", "lang", "text"], fanout=fanout, claims={"wrong": F.when(F.col("doc_id") % 2 == 0, F.sha2(F.lit(b"x"), 256))})
    assert out.columns == ["id", "leaf", "subroot", "root", "proof", "wrong"]
    out = out.withColumns({"again": fold(F.col("leaf"), F.col("proof")), "other": fold(F.col("wrong"), F.col("proof")), "text": proof_text(F.col("proof"))})
    got = out.collect()
    plain = [(r.id, r.leaf, r.subroot, r.root, [(s.place, s.siblings) for s in r.proof]) for r in got]
    assert sorted(plain, key=repr) == sorted(manifest(rows, fanout), key=repr)
    for r in got:
        assert r.again == r.root and r.text == "".join(n for s in r.proof for n in s.siblings)
        assert r.other is None if r.wrong is None else r.other != r.root


def test_empty_and_one_group_per_row(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle_manifest(empty, ["text"]).count() == 0
    rows = [(i, f"g{i}", None) for i in range(70)]
    got = [(r.id, r.leaf, r.subroot, r.root, [(s.place, s.siblings) for s in r.proof]) for r in merkle_manifest(spark.createDataFrame(rows, SCHEMA), ["doc_id", "lang", "text"]).collect()]
    assert sorted(got, key=repr) == sorted(manifest(rows, 2), key=repr)
    with pytest.raises(ValueError):
        merkle_manifest(empty, ["text"], fanout=1)


def test_null_and_empty_leaves_differ(spark):
    df = spark.createDataFrame([(None, "", "-"), (1, "0:", None)], SCHEMA)
    assert [r[0] for r in df.select(leaf_digest([F.col(c) for c in df.columns])).collect()] == [leaf((None, "", "-")), leaf((1, "0:", None))]


def test_most_rows_in_one_group_and_one_id(spark):
    """Rows equal in all they have are told apart and dealt out over all ranges."""
    rows = spark.range(20000).selectExpr("CASE WHEN id % 2 = 0 THEN 5 ELSE id END AS doc_id", "'en' AS lang", "'same' AS text")
    out = merkle_manifest(rows, ["doc_id", "lang", "text"])
    assert out.where(fold(F.col("leaf"), F.col("proof")) == F.col("root")).count() == 20000
    assert out.select("subroot").distinct().count() == 1
    assert out.where("id = 5").select("proof.place").distinct().count() == 10001
