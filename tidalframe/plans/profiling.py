"""Queries for cleaning, selection and profiling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidalframe.functions.labels import bleach_class
from tidalframe.functions.missing import obs_year, to_numeric
from tidalframe.operators import cleaning, profiling
from tidalframe.plans.catalog import query
from tidalframe.plans.standins import MEASURES, OBS_CTE, OBS_RAW_CTE, TABLES, obs, obs_dup, obs_raw, r6, table

RAW_COLUMNS = ["obs_no", "site_id", "obs_date", "country_name", "realm_name", "exposure", "percent_bleaching",
               "depth_m", "turbidity", "percent_cover", "distance_to_shore", "data_source"]
TEXTS = ["percent_bleaching", "depth_m", "turbidity", "percent_cover", "distance_to_shore", "data_source"]
GROUPS = ["realm_name", "country_name", "obs_year", "obs_month", "data_source", "exposure"]
_CLEAN = ", ".join(f"CASE WHEN {c} IN ('nd', 'ND', '') THEN NULL ELSE {c} END AS {c}" if c in TEXTS else c for c in RAW_COLUMNS)
CLEAN_CTE = f"{OBS_RAW_CTE}, clean AS (SELECT {_CLEAN} FROM reef_obs_raw)"


@query("c1_clean_missing", f"WITH {CLEAN_CTE} SELECT * FROM clean")
def _(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.clean_missing(obs_raw(spark, d))


_TYPED = ", ".join(f"TRY_CAST({c} AS DOUBLE) AS {c}" if c in MEASURES else c for c in RAW_COLUMNS)


@query("c2_infer_numeric", f"WITH {CLEAN_CTE} SELECT {_TYPED} FROM clean")
def _(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.infer_numeric(cleaning.clean_missing(obs_raw(spark, d)))


@query("c3_to_numeric", f"WITH {OBS_RAW_CTE} SELECT obs_no, depth_m, data_source AS source_text, TRY_CAST(depth_m AS DOUBLE) AS depth_value, TRY_CAST(data_source AS DOUBLE) AS source_value FROM reef_obs_raw")
def _(spark: SparkSession, d: str) -> DataFrame:
    return obs_raw(spark, d).select(
        "obs_no", "depth_m", F.col("data_source").alias("source_text"),
        to_numeric(F.col("depth_m")).alias("depth_value"), to_numeric(F.col("data_source")).alias("source_value"),
    )


@query("c4_obs_year", """
WITH dated AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'nd' WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d')
 ELSE concat(month(o_orderdate), '/', day(o_orderdate), '/', year(o_orderdate)) END AS date_text FROM orders)
SELECT o_orderkey, date_text, CAST(year(coalesce(try_strptime(date_text, '%Y-%m-%d'), try_strptime(date_text, '%m/%d/%Y'))) AS BIGINT) AS obs_year FROM dated""")
def _(spark: SparkSession, d: str) -> DataFrame:
    text = (
        F.when(F.col("o_orderkey") % 9 == 0, "nd")
        .when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .otherwise(F.date_format("o_orderdate", "M/d/yyyy"))
    )
    dated = table(spark, d, "orders").select("o_orderkey", text.alias("date_text"))
    return dated.withColumn("obs_year", obs_year(F.col("date_text")).cast("bigint"))


@query("p1_select_columns", f"WITH {OBS_CTE} SELECT site_id, obs_date, country_name, depth_m, exposure, turbidity, percent_bleaching FROM obs")
def _(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.select_columns(obs(spark, d), ["site_id", "obs_date", "country_name", "depth_m", "exposure", "turbidity", "percent_bleaching"])


@query("p2_drop_columns", f"WITH {OBS_CTE} SELECT obs_no, site_id, realm_name, exposure, percent_bleaching, depth_m, turbidity, percent_cover, distance_to_shore, obs_year, obs_month FROM obs")
def _(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.drop_columns(obs(spark, d), ["country_name", "data_source", "obs_date"])


@query("p3_drop_sparse_columns", f"WITH {OBS_CTE} SELECT obs_no, site_id, obs_date, country_name, realm_name, exposure, percent_bleaching, depth_m, turbidity, distance_to_shore, data_source, obs_year, obs_month FROM obs")
def _(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.drop_sparse_columns(obs(spark, d), 0.30)


@query("p4_drop_missing_target", f"WITH {OBS_CTE} SELECT * FROM obs WHERE percent_bleaching IS NOT NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.drop_missing_target(obs(spark, d))


@query("p5_region_filter", f"WITH {OBS_CTE} SELECT obs_no, site_id, country_name, exposure, depth_m FROM obs WHERE country_name = (SELECT min(n_name) FROM nation) AND coalesce(contains(lower(exposure), 'high'), false)")
def _(spark: SparkSession, d: str) -> DataFrame:
    first_country = table(spark, d, "nation").agg(F.min("n_name")).scalar()
    found = cleaning.region_filter(obs(spark, d), first_country, "High", region_col="exposure")
    return found.select("obs_no", "site_id", "country_name", "exposure", "depth_m")


@query("p6_healthy_sites", f"WITH {OBS_CTE} SELECT * FROM obs WHERE percent_bleaching = 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.healthy_sites(obs(spark, d))


_SUMMARY_CTE = OBS_CTE + ", summary AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(count(*) - count({c}) AS BIGINT) AS null_count, round((count(*) - count({c})) * 100.0 / count(*), 6) AS null_percent FROM obs"
    for c in [*RAW_COLUMNS, "obs_year", "obs_month"]
) + ")"


@query("p7_columns_over", f"WITH {_SUMMARY_CTE} SELECT \"column\", round(null_percent / 100, 6) AS missing_fraction FROM summary WHERE null_percent > 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    return profiling.columns_over(obs(spark, d), 0.0).select("column", r6("missing_fraction"))


@query("a1_shape", """
SELECT 'before dedup' AS step, CAST(count(*) + sum(CASE WHEN o_custkey % 10 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_rows, CAST(12 AS BIGINT) AS n_columns
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey
UNION ALL
SELECT 'after dedup', CAST(count(*) AS BIGINT), CAST(12 AS BIGINT) FROM (WITH """ + OBS_RAW_CTE + " SELECT DISTINCT * FROM reef_obs_raw)")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = obs_dup(spark, d)
    before = profiling.shape(rows).select(F.lit("before dedup").alias("step"), "*")
    after = profiling.shape(cleaning.drop_duplicate_rows(rows)).select(F.lit("after dedup").alias("step"), "*")
    return before.unionByName(after)


@query("a2_null_percent_total", f"WITH {_SUMMARY_CTE} SELECT round(sum(null_count) * 100.0 / (14 * (SELECT count(*) FROM obs)), 6) AS null_percent FROM summary")
def _(spark: SparkSession, d: str) -> DataFrame:
    return profiling.null_percent_total(obs(spark, d)).select(r6("null_percent"))


@query("a3_null_summary", f"WITH {_SUMMARY_CTE} SELECT * FROM summary")
def _(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.sort_desc(profiling.null_summary(obs(spark, d)), "null_percent", "column").select("column", "null_count", r6("null_percent"))


@query("a4_missing_by_group", f"WITH {OBS_CTE} " + " UNION ALL ".join(
    f"SELECT '{g}' AS group_column, CAST({g} AS VARCHAR) AS group_value, CAST(count(*) AS BIGINT) AS n_rows, '{c}' AS \"column\", round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_share FROM obs WHERE {g} IS NOT NULL GROUP BY {g}"
    for g in GROUPS for c in MEASURES))
def _(spark: SparkSession, d: str) -> DataFrame:
    shares = profiling.missing_by_group(obs(spark, d), GROUPS, MEASURES)
    return shares.select("group_column", "group_value", "n_rows", "column", r6("missing_share"))


@query("a5_years_per_site", f"WITH {OBS_CTE} SELECT site_id, CAST(count(DISTINCT obs_year) AS BIGINT) AS n_years FROM obs GROUP BY site_id HAVING count(DISTINCT obs_year) > 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return profiling.years_per_site(obs(spark, d), "site_id", "obs_year")


@query("a6_distinct_counts", f"WITH {OBS_CTE} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct FROM obs" for c in ["country_name", "realm_name", "exposure", "data_source"]))
def _(spark: SparkSession, d: str) -> DataFrame:
    return profiling.distinct_counts(obs(spark, d))


@query("a7_value_counts", f"WITH {OBS_CTE} SELECT percent_bleaching, CAST(count(*) AS BIGINT) AS n FROM obs WHERE percent_bleaching IS NOT NULL GROUP BY percent_bleaching")
def _(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.sort_desc(profiling.value_counts(obs(spark, d), "percent_bleaching"), "n", "percent_bleaching")


@query("a8_site_year_distribution", f"WITH {OBS_CTE}, sites AS (SELECT site_id, count(DISTINCT obs_year) AS n_years FROM obs GROUP BY site_id HAVING count(DISTINCT obs_year) > 1) SELECT CAST(n_years AS BIGINT) AS n_years, CAST(count(*) AS BIGINT) AS n_sites FROM sites GROUP BY n_years")
def _(spark: SparkSession, d: str) -> DataFrame:
    return profiling.site_year_distribution(obs(spark, d), "site_id", "obs_year").orderBy("n_years")


HISTOGRAM_SQL = """lim AS (SELECT min(percent_bleaching) AS lo, max(percent_bleaching) AS hi FROM obs),
filled AS (SELECT least(CAST(floor((percent_bleaching - lo) / (hi - lo) * 30) AS BIGINT), 29) AS bin, count(*) AS n FROM obs, lim WHERE percent_bleaching IS NOT NULL GROUP BY 1),
hist AS (SELECT CAST(b.bin AS BIGINT) AS bin, round(lo + b.bin * ((hi - lo) / 30), 6) AS bin_start, round(lo + (b.bin + 1) * ((hi - lo) / 30), 6) AS bin_end, CAST(coalesce(n, 0) AS BIGINT) AS n
 FROM (SELECT unnest(range(30)) AS bin) b CROSS JOIN lim LEFT JOIN filled f ON f.bin = b.bin)"""


@query("a9_histogram", f"WITH {OBS_CTE}, {HISTOGRAM_SQL} SELECT * FROM hist")
def _(spark: SparkSession, d: str) -> DataFrame:
    return profiling.histogram(obs(spark, d), "percent_bleaching", 30).select("bin", r6("bin_start"), r6("bin_end"), "n")


@query("a11_healthy_share", f"WITH {OBS_CTE} SELECT realm_name, round(avg(CASE WHEN percent_bleaching = 0 THEN 100.0 ELSE 0.0 END), 6) AS percent_of_rows, round(avg(CASE WHEN percent_bleaching IS NULL THEN NULL WHEN percent_bleaching = 0 THEN 100.0 ELSE 0.0 END), 6) AS percent_of_known FROM obs GROUP BY realm_name")
def healthy_share_by_realm(spark: SparkSession, d: str) -> DataFrame:
    shares = profiling.healthy_share(obs(spark, d), "percent_bleaching", "realm_name")
    return shares.select("realm_name", r6("percent_of_rows"), r6("percent_of_known"))


CLASSES_SQL = """classes AS (SELECT CASE WHEN percent_bleaching = 0 THEN 'healthy' ELSE 'bleached' END AS class, CAST(count(*) AS BIGINT) AS n,
 round(count(*) * 100.0 / (SELECT count(percent_bleaching) FROM obs), 6) AS percent FROM obs WHERE percent_bleaching IS NOT NULL GROUP BY 1)"""


@query("a12_class_balance", f"WITH {OBS_CTE}, {CLASSES_SQL} SELECT * FROM classes")
def _(spark: SparkSession, d: str) -> DataFrame:
    labelled = obs(spark, d).select(bleach_class(F.col("percent_bleaching")).alias("class"))
    return profiling.class_balance(labelled, "class").select("class", "n", r6("percent"))


@query("a17_class_counts", """
SELECT c.event_type, CAST(count(e.event_id) AS BIGINT) AS n FROM (SELECT DISTINCT event_type FROM events UNION ALL SELECT 'never seen') c
LEFT JOIN events e ON e.event_type = c.event_type GROUP BY c.event_type""")
def _(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    classes = events.select("event_type").distinct().unionByName(spark.range(1).select(F.lit("never seen").alias("event_type")))
    return profiling.class_counts(events, "event_type", classes)


@query("a22_missing_flags", f"WITH {OBS_CTE} SELECT obs_no, " + ", ".join(
    f"{c}, CAST({c} IS NULL AS INT) AS {c}_missing" for c in MEASURES) + " FROM obs")
def _(spark: SparkSession, d: str) -> DataFrame:
    return profiling.missing_flags(obs(spark, d).select("obs_no", *MEASURES), MEASURES)


@query("m20_balance_report", f"""WITH {OBS_CTE}, {HISTOGRAM_SQL}, {CLASSES_SQL}
SELECT 'histogram' AS part, CAST(bin AS VARCHAR) AS item, CAST(n AS DOUBLE) AS value FROM hist
UNION ALL SELECT 'healthy_percent', 'all rows', round(avg(CASE WHEN percent_bleaching = 0 THEN 100.0 ELSE 0.0 END), 6) FROM obs
UNION ALL SELECT 'healthy_percent', 'known target', round(avg(CASE WHEN percent_bleaching = 0 THEN 100.0 ELSE 0.0 END), 6) FROM obs WHERE percent_bleaching IS NOT NULL
UNION ALL SELECT 'class_percent', class, percent FROM classes""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return profiling.balance_report(obs(spark, d)).select("part", "item", r6("value"))


@query("u1_drop_duplicate_rows", f"WITH {OBS_RAW_CTE} SELECT DISTINCT * FROM (SELECT * FROM reef_obs_raw UNION ALL SELECT * FROM reef_obs_raw WHERE site_id % 10 = 0)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.drop_duplicate_rows(obs_dup(spark, d))


@query("u2_union_rows", "SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier")
def _(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").selectExpr("c_custkey AS key", "c_name AS name", "c_acctbal AS balance", "c_mktsegment AS segment")
    suppliers = table(spark, d, "supplier").selectExpr("s_suppkey AS key", "s_name AS name", "s_acctbal AS balance")
    return cleaning.union_rows(customers, suppliers)
