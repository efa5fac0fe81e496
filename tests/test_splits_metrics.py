import pytest
from pyspark.sql import functions as F

from tidalframe.operators import history, metrics, profiling, selection, splitting


@pytest.fixture(scope="module")
def items(spark):
    """One class holds most rows, one holds a single row, some have none."""
    cls = F.when(F.col("id") % 10 < 7, "big").when(F.col("id") == 8, "one").when(F.col("id") % 10 == 9, None).otherwise("small")
    return spark.range(2000).withColumn("cls", cls)


def brute_order(df):
    rows = df.withColumn("h", splitting.key_hash(F.col("id"))).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.cls, []).append((r.h, r.id))
    return {c: [k for _, k in sorted(v)] for c, v in groups.items()}


def test_stratified_split_like_a_full_sort(items):
    got = {r.id: r.split for r in splitting.stratified_split(items, "id", "cls").collect()}
    assert len(got) == 2000
    for keys in brute_order(items).values():
        n = len(keys)
        a, b = int(n * 0.8), int(n * 0.8) + int(n * 0.1)
        assert [got[k] for k in keys] == ["train"] * a + ["val"] * (b - a) + ["test"] * (n - b)


def test_folds_are_even_in_every_class(items):
    got = {r.id: r.fold for r in splitting.stratified_folds(items, "id", "cls", 3).collect()}
    for keys in brute_order(items).values():
        sizes = [sum(got[k] == f for k in keys) for f in range(3)]
        assert sum(sizes) == len(keys) and max(sizes) - min(sizes) <= 1


def test_split_does_not_sort_the_table(items):
    plan = splitting.stratified_split(items, "id", "cls")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_more_classes_than_the_small_limit(spark, monkeypatch):
    """Beyond the size check the cut table joins the ordinary way, with the same rows."""
    df = spark.range(600).withColumn("cls", F.col("id") % 5)
    small = {r.id: r.fold for r in splitting.stratified_folds(df, "id", "cls").collect()}
    monkeypatch.setattr(splitting, "pin_small", lambda d: d)
    assert {r.id: r.fold for r in splitting.stratified_folds(df, "id", "cls").collect()} == small


def test_random_split_is_stable(spark):
    df = spark.range(5000)
    first = splitting.random_split(df, "id")
    second = splitting.random_split(df.repartition(3), "id")
    assert first.exceptAll(second).count() == 0
    assert 0.17 < first.where("split = 'test'").count() / 5000 < 0.23


def test_metrics_edges(spark):
    none = spark.createDataFrame([(1, 0), (0, 0)], "label int, pred int")
    row = metrics.binary_metrics(none).first()
    assert (row.accuracy, row.precision, row.recall, row.f1) == (0.5, 0.0, 0.0, 0.0)
    cells = {(r.label, r.pred): r.n for r in metrics.confusion_matrix(none).collect()}
    assert cells == {(0, 0): 1, (0, 1): 0, (1, 0): 1, (1, 1): 0}
    sure = spark.createDataFrame([(1, 0.0)], "label int, p double")
    assert metrics.log_loss(sure).first()[0] == pytest.approx(16.118095, abs=1e-5)


def brute_stop(values, patience):
    best, at = None, 0
    for i, v in enumerate(values, 1):
        if best is None or v > best:
            best, at = v, i
        if i - at >= patience:
            return at, i, True
    return at, len(values), False


@pytest.mark.parametrize("block", [3, 1000])
def test_early_stop_across_blocks(spark, block):
    runs = {1: [0.1, 0.2, 0.2, 0.1, 0.2, 0.3], 2: [0.5, 0.4, 0.4, 0.4, 0.9], 3: [0.1, 0.2, 0.3], 4: [0.3, 0.3, 0.1, 0.31, 0.2, 0.2, 0.2, 0.9]}
    rows = [(r, i, v) for r, vs in runs.items() for i, v in enumerate(vs, 1)]
    df = spark.createDataFrame(rows, "run_id int, epoch bigint, val_accuracy double")
    got = {r.run_id: (r.best_epoch, r.stopped_epoch, r.stopped_early) for r in history.early_stop(df, 3, block=block).collect()}
    assert got == {r: brute_stop(vs, 3) for r, vs in runs.items()}


def test_histories_are_renumbered(spark):
    one = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.2)], "run_id int, epoch bigint, val_accuracy double")
    two = spark.createDataFrame([(1, 2, 0.3), (1, 9, 0.4), (1, 5, 0.35)], "run_id int, epoch bigint, val_accuracy double")
    got = history.concat_history(one, two, block=4).orderBy("epoch").collect()
    assert [(r.epoch, r.val_accuracy) for r in got] == [(1, 0.1), (2, 0.2), (3, 0.3), (4, 0.35), (5, 0.4)]


def test_best_and_first_of_results(spark):
    df = spark.createDataFrame([(0, 50, 0.9), (1, 30, 0.9), (2, 10, 0.8), (3, 10, 0.95)], "seq int, k int, f1 double")
    assert selection.best_result(df.where("seq < 3")).first().seq == 0
    assert selection.pick_by_k(df, 10).first().seq == 2
    assert [r.seq for r in selection.sweep_stop(df, 0.9, 0.05).orderBy("seq").collect()] == [0, 1, 2]
    assert selection.sweep_stop(df, 0.5, 0.05).count() == 4


def test_hash_sample_is_bounded_and_keeps_shares(spark):
    df = spark.range(50_000).selectExpr("id", "id % 5 = 0 AS rare")
    got = splitting.hash_sample(df, "id", 2_000)
    n, rare = got.count(), got.where("rare").count()
    assert 1_800 < n < 2_200 and 0.17 < rare / n < 0.23
    assert splitting.hash_sample(df, "id", 2_000, 50_000).exceptAll(got).count() == 0
    assert splitting.hash_sample(df, "id", 60_000).count() == 50_000
    assert splitting.hash_sample(df.limit(0), "id", 10).count() == 0


def test_class_counts_by_table(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "c string")
    classes = spark.createDataFrame([("a",), ("b",)], "c string")
    got = {r.c: r.n for r in profiling.class_counts(df, "c", classes).collect()}
    assert got == {"a": 2, "b": 0} == {r.c: r.n for r in profiling.class_counts(df, "c", ["a", "b"]).collect()}
