"""The pipeline against a brute-force version of each stage, and what holds for every stage."""

import glob

import corpus_pipeline
import __spark_entry__ as contract
from tests.llm.test_models import plain_quality
from tests.llm.test_rows import chunks, md5, plain_quantile
from tests.llm.test_similar import similar_brute

SMALL = "/root/testdata/sf0.001"


def brute_lines(rows):
    first = {}
    for i, t in sorted(rows):
        for pos, c in enumerate(chunks(t)):
            first.setdefault(tuple(c), (i, pos))
    return [(i, "\n".join("\n".join(c) for pos, c in enumerate(chunks(t)) if len(c) < 2 or first[tuple(c)] == (i, pos))) for i, t in rows]


def test_run_equals_brute_force(spark):
    docs = [(r.doc_id, r.lang, r.source, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    trusted = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect() if r.quality == 1 and r.toxic == 0}
    keep = {i for i, _, _, k in plain_quality([(i, lang, t) for i, lang, _, t in docs], trusted) if k}
    source = {i: s for i, _, s, _ in docs}
    rows = brute_lines([(i, t) for i, _, _, t in docs if i in keep])
    rows.sort(key=lambda r: r[0])
    root = similar_brute([t for _, t in rows])
    rows = [r for k, r in enumerate(rows) if root[k] == k]
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    rows = [(i, t) for i, t in rows if not any(" ".join(q.split()) in " ".join(t.split()) for q in items)]
    sizes = {s: sum(source[i] == s for i, _ in rows) for s in {source[i] for i, _ in rows}}
    want = sorted((i, c + 1, md5(t)) for i, t in rows for c in range(plain_quantile(i, len(rows) / len(sizes) / sizes[source[i]])))
    out = corpus_pipeline.run(spark, SMALL)
    got = sorted((r.doc_id, r.copy, md5(r.text)) for r in out.collect())
    assert got == want
    assert contract.queries()["pipeline"] is corpus_pipeline.run and corpus_pipeline.ORACLE_SQL is None


def test_stages_keep_columns_and_take_odd_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(20)
    odd = spark.createDataFrame([(None, None, None, None, None), (5000, "", "en", "src1", 0), (5001, "one two\nthree", None, None, 13), (5001, "one two\nthree", None, None, 13)], docs.schema)
    docs = docs.unionByName(odd).selectExpr("*", "1 AS block", "'k' AS keep", "2 AS id")
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for table in (docs, docs.where("false")):
            out = stage(spark, table, SMALL)
            assert k == 4 or out.columns == docs.columns
            assert out.count() == 0 if table is not docs else out.count() > 0


def test_tables_of_finished_stages_are_removed(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    quality, lines = corpus_pipeline.quality_stage, corpus_pipeline.line_stage
    first = quality(spark, docs, SMALL)
    made = [folder for _, folder in corpus_pipeline._made]
    assert len(made) == 1 and glob.glob(f"{made[0].removeprefix('file:')}/*")
    second = lines(spark, first, SMALL)  # not written in between: still read from the first stage's tables
    assert made[0] in [folder for _, folder in corpus_pipeline._made]
    assert second.count() == first.count()
    corpus_pipeline.release(spark, docs)
    assert corpus_pipeline._made == [] and not glob.glob(f"{made[0].removeprefix('file:')}*")
    out = corpus_pipeline.run(spark, SMALL)
    assert corpus_pipeline._made == [] and out.count() > 0
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("blocks_quality")]
