"""Queries on ranks, quantiles, rank correlation and quantile plots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidalframe.functions.normal import inverse_normal_sql
from tidalframe.operators import metrics, ordering
from tidalframe.plans.catalog import query
from tidalframe.plans.standins import FEATURES, MEASURES, OBS_CTE, SCORES_CTE, obs, obs_kept, r6, scores


@query("w3_average_rank", f"WITH {OBS_CTE} SELECT obs_no, depth_m, CASE WHEN depth_m IS NULL THEN NULL ELSE rank() OVER (ORDER BY depth_m NULLS LAST) + (count(*) OVER (PARTITION BY depth_m) - 1) / 2.0 END AS depth_rank FROM obs")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ordering.average_rank(obs_kept(spark, d, ["obs_no", "depth_m"]), "depth_m", "depth_rank")


@query("a10_describe_exact", f"WITH {OBS_CTE} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(count({c}) AS BIGINT) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, "
    f"round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, max({c}) AS max FROM obs" for c in MEASURES))
def _(spark: SparkSession, d: str) -> DataFrame:
    found = ordering.describe_exact(obs_kept(spark, d, MEASURES), MEASURES)
    return found.select("column", "count", r6("mean"), r6("std"), "min", r6("p25"), r6("p50"), r6("p75"), "max")


@query("a13_median_iqr", f"WITH {OBS_CTE} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q3 FROM obs" for c in FEATURES))
def _(spark: SparkSession, d: str) -> DataFrame:
    return ordering.median_iqr(obs_kept(spark, d, FEATURES), FEATURES).select("column", r6("q1"), r6("median"), r6("q3"))


def _pair_sql(a: str, b: str) -> str:
    rank = "(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"
    return (f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(abs(corr(ra, rb)), 6) AS rho FROM (SELECT {rank.format(c=a)} AS ra, {rank.format(c=b)} AS rb "
            f"FROM obs WHERE {a} IS NOT NULL AND {b} IS NOT NULL)")


SPEARMAN_SQL = " UNION ALL ".join(_pair_sql(a, b) for a in MEASURES for b in MEASURES)


@query("a14_spearman_matrix", f"WITH {OBS_CTE} {SPEARMAN_SQL}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ordering.spearman_matrix(obs(spark, d), MEASURES).select("col_a", "col_b", r6("rho"))


@query("a15_high_corr_pairs", f"WITH {OBS_CTE}, pairs AS ({SPEARMAN_SQL}) SELECT * FROM pairs WHERE col_a < col_b AND rho > 0.7")
def _(spark: SparkSession, d: str) -> DataFrame:
    matrix = ordering.spearman_matrix(obs(spark, d), MEASURES)
    return ordering.high_corr_pairs(matrix, 0.7).select("col_a", "col_b", r6("rho"))


_QQ_CTE = f"""{OBS_CTE}, placed AS (SELECT depth_m, row_number() OVER (ORDER BY depth_m) AS i, count(*) OVER () AS n FROM obs WHERE depth_m IS NOT NULL),
places AS (SELECT i, depth_m, CASE WHEN i = n THEN pow(CAST(0.5 AS DOUBLE), 1.0 / n) WHEN i = 1 THEN 1 - pow(CAST(0.5 AS DOUBLE), 1.0 / n) ELSE (i - CAST(0.3175 AS DOUBLE)) / (n + CAST(0.365 AS DOUBLE)) END AS p FROM placed),
qq AS (SELECT CAST(i AS BIGINT) AS position, {inverse_normal_sql('p')} AS theoretical, depth_m AS observed FROM places)"""


@query("a16_normal_qq", f"WITH {_QQ_CTE} SELECT position, round(theoretical, 6) AS theoretical, observed FROM qq")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ordering.normal_qq(obs(spark, d), "depth_m").select("position", r6("theoretical"), "observed")


@query("a16_normal_qq_fit", f"WITH {_QQ_CTE} SELECT round(regr_slope(observed, theoretical), 6) AS slope, round(regr_intercept(observed, theoretical), 6) AS intercept, round(corr(observed, theoretical), 6) AS r FROM qq")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ordering.normal_qq_fit(ordering.normal_qq(obs(spark, d), "depth_m")).select(r6("slope"), r6("intercept"), r6("r"))


AUC_SQL = """SELECT (sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) AS roc_auc FROM
 (SELECT label, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM score_pairs)"""


@query("a20_roc_auc", f"WITH {SCORES_CTE} SELECT round(roc_auc, 6) AS roc_auc FROM ({AUC_SQL})")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ordering.roc_auc(scores(spark, d), "label", "p").select(r6("roc_auc"))


METRICS_SQL = """SELECT avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END) AS accuracy,
 coalesce(sum(label * pred) / nullif(CAST(sum(pred) AS DOUBLE), 0), 0) AS precision, coalesce(sum(label * pred) / nullif(CAST(sum(label) AS DOUBLE), 0), 0) AS recall,
 coalesce(2 * sum(label * pred) / nullif(CAST(sum(label) + sum(pred) AS DOUBLE), 0), 0) AS f1 FROM score_pairs"""


@query("a23_compare_models", " UNION ALL ".join(
    f"SELECT '{name}' AS model, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(roc_auc, 6) AS roc_auc "
    f"FROM (WITH {SCORES_CTE.replace('value / 500', expr)} SELECT * FROM ({METRICS_SQL}), ({AUC_SQL}))"
    for name, expr in (("value over 500", "value / 500"), ("value over 250", "value / 250"))))
def _(spark: SparkSession, d: str) -> DataFrame:
    base = scores(spark, d)
    doubled = base.select("item_id", "label", (F.col("p") * 2).alias("p")).withColumn("pred", (F.col("p") >= 0.1).cast("int"))
    found = metrics.compare_models({"value over 500": base, "value over 250": doubled})
    return found.select("model", r6("accuracy"), r6("precision"), r6("recall"), r6("f1"), r6("roc_auc"))
