"""Queries on splits, folds, classification metrics and training curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidalframe.functions import labels
from tidalframe.operators import history as curves
from tidalframe.operators import metrics, splitting
from tidalframe.plans.catalog import query
from tidalframe.plans.ordering import METRICS_SQL
from tidalframe.plans.standins import HISTORY_CTE, SCORES_CTE, history, r6, scores, table

_HASH = "CAST(('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8)) AS BIGINT)"
_ORDERED = f"ordered AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {_HASH}, event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)"


@query("w1_stratified_split", f"WITH {_ORDERED} SELECT event_id, event_type, CASE WHEN i <= floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' WHEN i <= floor(n * CAST(0.8 AS DOUBLE)) + floor(n * CAST(0.1 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM ordered")
def _(spark: SparkSession, d: str) -> DataFrame:
    return splitting.stratified_split(table(spark, d, "events").select("event_id", "event_type"), "event_id", "event_type")


@query("w2_stratified_folds", f"SELECT event_id, event_type, CAST(ntile(3) OVER (PARTITION BY event_type ORDER BY {_HASH}, event_id) - 1 AS INTEGER) AS fold FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return splitting.stratified_folds(table(spark, d, "events").select("event_id", "event_type"), "event_id", "event_type", 3)


@query("m6_random_split", f"SELECT event_id, CASE WHEN {_HASH} % 100 < 80 THEN 'train' ELSE 'test' END AS split FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return splitting.random_split(table(spark, d, "events").select("event_id"), "event_id", 20)


@query("j6_pair_truth_pred", f"WITH {SCORES_CTE} SELECT t.item_id, t.label, s.p, s.pred FROM score_pairs t JOIN score_pairs s ON t.item_id = s.item_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    base = scores(spark, d)
    return metrics.pair_truth_pred(base.select("item_id", "label"), base.select("item_id", "p", "pred"), "item_id")


@query("a18_confusion_matrix", f"WITH {SCORES_CTE} SELECT CAST(a.c AS INTEGER) AS label, CAST(b.c AS INTEGER) AS pred, CAST(count(item_id) AS BIGINT) AS n FROM (VALUES (0), (1)) a(c) CROSS JOIN (VALUES (0), (1)) b(c) LEFT JOIN score_pairs s ON s.label = a.c AND s.pred = b.c GROUP BY a.c, b.c")
def _(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion_matrix(scores(spark, d))


@query("a19_binary_metrics", f"WITH {SCORES_CTE} SELECT round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM ({METRICS_SQL})")
def _(spark: SparkSession, d: str) -> DataFrame:
    return metrics.binary_metrics(scores(spark, d)).select(r6("accuracy"), r6("precision"), r6("recall"), r6("f1"))


@query("a21_log_loss", f"WITH {SCORES_CTE}, clipped AS (SELECT label, least(greatest(p, CAST(1e-7 AS DOUBLE)), 1 - CAST(1e-7 AS DOUBLE)) AS p FROM score_pairs) SELECT round(avg(-(label * ln(p) + (1 - label) * ln(1 - p))), 6) AS log_loss FROM clipped")
def _(spark: SparkSession, d: str) -> DataFrame:
    return metrics.log_loss(scores(spark, d)).select(r6("log_loss"))


@query("c9_binary_prediction", f"WITH {SCORES_CTE} SELECT item_id, CAST(p >= CAST(0.02 AS DOUBLE) AS INTEGER) AS pred_inclusive, CAST(p > CAST(0.02 AS DOUBLE) AS INTEGER) AS pred_strict FROM score_pairs")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p")
    return scores(spark, d).select(
        "item_id", labels.binary_prediction(p, 0.02).alias("pred_inclusive"), labels.binary_prediction(p, 0.02, inclusive=False).alias("pred_strict")
    )


@query("c10_class_probabilities", f"WITH {SCORES_CTE} SELECT item_id, round(1 - p, 6) AS probability_bleached, round(p, 6) AS probability_unbleached FROM score_pairs")
def _(spark: SparkSession, d: str) -> DataFrame:
    both = scores(spark, d).select("item_id", labels.class_probabilities(F.col("p"), 0).alias("s")).select("item_id", "s.*")
    return both.select("item_id", r6("probability_bleached"), F.round(F.col("probability_unbleached"), 6).alias("probability_unbleached"))


@query("c11_confidence", f"WITH {SCORES_CTE} SELECT item_id, round(greatest(p, 1 - p), 6) AS confidence FROM score_pairs")
def _(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).select("item_id", labels.confidence(F.col("p")).alias("confidence")).select("item_id", r6("confidence"))


@query("w4_concat_history", f"WITH {HISTORY_CTE}, both_phases AS (SELECT run_id, epoch, val_accuracy, 1 AS phase FROM history WHERE epoch <= 10 UNION ALL SELECT run_id, epoch - 10, val_accuracy, 2 FROM history WHERE epoch > 10) SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY phase, epoch) AS BIGINT) AS epoch, CAST(epoch AS BIGINT) AS phase_epoch, phase, val_accuracy FROM both_phases")
def _(spark: SparkSession, d: str) -> DataFrame:
    h = history(spark, d)
    return curves.concat_history(h.where("epoch <= 10"), h.where("epoch > 10").withColumn("epoch", F.col("epoch") - 10))


@query("w5_early_stop", f"""WITH RECURSIVE {HISTORY_CTE}, walk AS (
SELECT run_id, epoch, epoch AS best_epoch, val_accuracy AS best FROM history WHERE epoch = 1
UNION ALL SELECT h.run_id, h.epoch, CASE WHEN h.val_accuracy > w.best THEN h.epoch ELSE w.best_epoch END, greatest(h.val_accuracy, w.best)
FROM walk w JOIN history h ON h.run_id = w.run_id AND h.epoch = w.epoch + 1 WHERE w.epoch - w.best_epoch < 10)
SELECT run_id, CAST(max(best_epoch) AS BIGINT) AS best_epoch, CAST(max(epoch) AS BIGINT) AS stopped_epoch, max(epoch) - max(best_epoch) >= 10 AS stopped_early FROM walk GROUP BY run_id""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return curves.early_stop(history(spark, d), patience=10)
