"""Queries on feature preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array

from tidalframe.functions import labels, timefeatures
from tidalframe.operators import cleaning, dictionary, features
from tidalframe.operators.preprocessor import ObservationPreprocessor
from tidalframe.plans.catalog import query
from tidalframe.plans.standins import FEATURES, OBS_CTE, obs, obs_kept, r6, table
from tidalframe.session import scratch_path
from tidalframe.sources.tables import load_model, save_model

CATEGORIES = ["realm_name", "exposure"]
KEYS = ["obs_no"]


@query("c5_month_cycle", f"WITH {OBS_CTE} SELECT obs_no, obs_month, round(sin(2 * pi() * obs_month / 12), 6) + 0.0 AS month_sin, round(cos(2 * pi() * obs_month / 12), 6) + 0.0 AS month_cos FROM obs")
def _(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("obs_month")
    return obs(spark, d).select(
        "obs_no", "obs_month", (F.round(timefeatures.month_sin(m), 6) + 0.0).alias("month_sin"), (F.round(timefeatures.month_cos(m), 6) + 0.0).alias("month_cos")
    )


@query("c6_year_norm", f"WITH {OBS_CTE} SELECT obs_no, obs_year, round((obs_year - (SELECT avg(obs_year) FROM obs)) / (SELECT stddev_samp(obs_year) FROM obs), 6) AS year_norm FROM obs")
def _(spark: SparkSession, d: str) -> DataFrame:
    base = obs(spark, d).select("obs_no", "obs_year")
    return base.withColumn("year_norm", F.round(timefeatures.year_norm(base, "obs_year"), 6))


@query("c7_bleach_class", f"WITH {OBS_CTE} SELECT obs_no, percent_bleaching, CASE WHEN percent_bleaching IS NULL THEN NULL WHEN percent_bleaching = 0 THEN 'healthy' ELSE 'bleached' END AS class FROM obs")
def _(spark: SparkSession, d: str) -> DataFrame:
    return obs(spark, d).select("obs_no", "percent_bleaching", labels.bleach_class(F.col("percent_bleaching")).alias("class"))


@query("c8_encode_label", f"WITH {OBS_CTE} SELECT obs_no, CASE WHEN percent_bleaching IS NULL THEN NULL WHEN percent_bleaching = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS label FROM obs")
def _(spark: SparkSession, d: str) -> DataFrame:
    return obs(spark, d).select("obs_no", labels.encode_label(labels.bleach_class(F.col("percent_bleaching"))).alias("label"))


_Q_CTE = ", q AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.5) AS {c}_q2, quantile_cont({c}, 0.75) AS {c}_q3" for c in FEATURES) + " FROM obs)"


def _scaled(c: str, imputed: bool) -> str:
    x = f"coalesce({c}, {c}_q2)" if imputed else c
    return f"({x} - {c}_q2) / CASE WHEN {c}_q3 = {c}_q1 THEN 1 ELSE {c}_q3 - {c}_q1 END"


@query("m1_impute_median", f"WITH {OBS_CTE}{_Q_CTE} SELECT obs_no, " + ", ".join(f"round(coalesce({c}, {c}_q2), 6) AS {c}" for c in FEATURES) + " FROM obs, q")
def _(spark: SparkSession, d: str) -> DataFrame:
    return features.impute_median(obs_kept(spark, d, ["obs_no", *FEATURES]), FEATURES).select("obs_no", *[r6(c) for c in FEATURES])


@query("m2_robust_scale", f"WITH {OBS_CTE}{_Q_CTE} SELECT obs_no, " + ", ".join(f"round({_scaled(c, False)}, 6) AS {c}" for c in FEATURES) + " FROM obs, q")
def _(spark: SparkSession, d: str) -> DataFrame:
    return features.robust_scale(obs_kept(spark, d, ["obs_no", *FEATURES]), FEATURES).select("obs_no", *[r6(c) for c in FEATURES])


@query("m3_one_hot", f"""WITH {OBS_CTE}, rows AS (SELECT obs_no, realm_name, exposure FROM obs),
flags AS (SELECT r.obs_no, 'realm_name_' || v.realm_name AS feature, CAST(coalesce(r.realm_name = v.realm_name, false) AS DOUBLE) AS flag FROM rows r, (SELECT DISTINCT realm_name FROM rows) v
UNION ALL SELECT r.obs_no, 'exposure_' || coalesce(v.exposure, 'None'), CAST(r.exposure IS NOT DISTINCT FROM v.exposure AS DOUBLE) FROM rows r, (SELECT DISTINCT exposure FROM rows) v)
SELECT feature, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(flag) AS BIGINT) AS n_hot, CAST(sum(flag * (obs_no % 1000)) AS BIGINT) AS key_sum FROM flags GROUP BY feature""")
def _(spark: SparkSession, d: str) -> DataFrame:
    base = obs_kept(spark, d, ["obs_no", *CATEGORIES])
    encoded = features.one_hot(base, CATEGORIES)
    flags = [c for c in encoded.columns if c != "obs_no"]
    sums = encoded.agg(*[
        F.struct(
            F.lit(c).alias("feature"), F.count(F.lit(1)).alias("n_rows"), F.sum(f"`{c}`").cast("bigint").alias("n_hot"),
            F.sum(F.col(f"`{c}`") * (F.col("obs_no") % 1000)).cast("bigint").alias("key_sum"),
        ).alias(f"s{i}") for i, c in enumerate(flags)
    ])
    return sums.select(F.inline(F.array(*[f"s{i}" for i in range(len(flags))])))


_NUM_SQL = " UNION ALL ".join(f"SELECT {i} AS idx, {_scaled(c, True)} AS v FROM obs, q" for i, c in enumerate(FEATURES))
_REALM_SQL = f"SELECT {len(FEATURES)} + v.i, CAST(coalesce(r.realm_name = v.realm_name, false) AS DOUBLE) FROM obs r, (SELECT realm_name, row_number() OVER (ORDER BY realm_name) - 1 AS i FROM (SELECT DISTINCT realm_name FROM obs)) v"
_EXPO_SQL = f"SELECT {len(FEATURES)} + (SELECT count(DISTINCT realm_name) FROM obs) + v.i, CAST(r.exposure IS NOT DISTINCT FROM v.exposure AS DOUBLE) FROM obs r, (SELECT exposure, row_number() OVER (ORDER BY exposure NULLS LAST) - 1 AS i FROM (SELECT DISTINCT exposure FROM obs)) v"


@query("m4_fit_preprocessor", f"WITH {OBS_CTE}{_Q_CTE}, vals AS ({_NUM_SQL} UNION ALL {_REALM_SQL} UNION ALL {_EXPO_SQL}) SELECT CAST(idx AS BIGINT) AS idx, CAST(count(*) AS BIGINT) AS n, round(avg(v), 6) AS mean, round(min(v), 6) AS lowest, round(max(v), 6) AS highest FROM vals GROUP BY idx")
def _(spark: SparkSession, d: str) -> DataFrame:
    base = obs_kept(spark, d, [*KEYS, *FEATURES, *CATEGORIES])
    model = features.fit_preprocessor(base, FEATURES, CATEGORIES, keep=KEYS)
    positions = model.transform(base).select(F.posexplode(vector_to_array("features")).alias("idx", "v"))
    return positions.groupBy(F.col("idx").cast("bigint").alias("idx")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.min("v"), 6).alias("lowest"), F.round(F.max("v"), 6).alias("highest")
    )


_NAMES_SQL = " UNION ALL ".join([f"SELECT CAST({i} AS INTEGER) AS idx, '{c}' AS name" for i, c in enumerate(FEATURES)])


@query("m5_feature_names", f"WITH {OBS_CTE} {_NAMES_SQL} UNION ALL SELECT CAST({len(FEATURES)} + row_number() OVER (ORDER BY realm_name) - 1 AS INTEGER), 'realm_name_' || realm_name FROM (SELECT DISTINCT realm_name FROM obs) UNION ALL SELECT CAST({len(FEATURES)} + (SELECT count(DISTINCT realm_name) FROM obs) + row_number() OVER (ORDER BY exposure NULLS LAST) - 1 AS INTEGER), 'exposure_' || coalesce(exposure, 'None') FROM (SELECT DISTINCT exposure FROM obs)")
def _(spark: SparkSession, d: str) -> DataFrame:
    base = obs_kept(spark, d, [*KEYS, *FEATURES, *CATEGORIES])
    return features.feature_names(features.fit_preprocessor(base, FEATURES, CATEGORIES, keep=KEYS), base)


# Years up to this one are fitted on, later ones are prepared by what was stored.
LAST_FITTED_YEAR = 1996
_STORED_CATEGORIES = ["realm_name", "exposure", "site_id"]


def _stored_entries_sql() -> str:
    """(obs_no, idx, value) of the later rows, by numbers and categories of the earlier ones."""
    fitted = ", ".join(f"quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.5) AS {c}_q2, quantile_cont({c}, 0.75) AS {c}_q3" for c in FEATURES)
    parts = [f"SELECT obs_no, {i} AS idx, {_scaled(c, True)} AS value FROM later, q" for i, c in enumerate(FEATURES)]
    n = len(FEATURES)
    parts += [f"SELECT obs_no, {n}, sin(2 * pi() * obs_month / 12) FROM later", f"SELECT obs_no, {n + 1}, cos(2 * pi() * obs_month / 12) FROM later", f"SELECT obs_no, {n + 2}, (obs_year - year_mean) / year_std FROM later, q"]
    begin = f"{n + 3}"
    for c in _STORED_CATEGORIES:
        ranked = f"(SELECT v, row_number() OVER (ORDER BY v NULLS LAST) - 1 AS i FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM fitted))"
        parts.append(f"SELECT obs_no, {begin} + i, CAST(1 AS DOUBLE) FROM later JOIN {ranked} ON CAST({c} AS VARCHAR) IS NOT DISTINCT FROM v")
        begin += f" + (SELECT count(*) FROM (SELECT DISTINCT {c} FROM fitted))"
    return (f"WITH {OBS_CTE}, fitted AS (SELECT * FROM obs WHERE obs_year <= {LAST_FITTED_YEAR}), later AS (SELECT * FROM obs WHERE obs_year > {LAST_FITTED_YEAR}), "
            f"q AS (SELECT {fitted}, avg(obs_year) AS year_mean, stddev_samp(obs_year) AS year_std FROM fitted) "
            f"SELECT obs_no, CAST(idx AS BIGINT) AS idx, round(value, 6) + 0.0 AS value FROM ({' UNION ALL '.join(parts)})")


@query("m4_stored_preprocessor", _stored_entries_sql())
def _(spark: SparkSession, d: str) -> DataFrame:
    """Fitted on the earlier years, stored, loaded, and applied to the later ones: the filled positions of every vector."""
    base = obs_kept(spark, d, ["obs_no", "obs_year", "obs_month", *FEATURES, *_STORED_CATEGORIES])
    stage = ObservationPreprocessor(numeric=FEATURES, categorical=_STORED_CATEGORIES, yearCol="obs_year", monthCol="obs_month")
    path = scratch_path(spark, "preprocessor")
    save_model(Pipeline(stages=[stage]).fit(base.where(F.col("obs_year") <= LAST_FITTED_YEAR)), path)
    model: PipelineModel = load_model(path)
    vectors = model.transform(base.where(F.col("obs_year") > LAST_FITTED_YEAR)).select("obs_no", F.unwrap_udt("features").alias("parts"))
    entries = vectors.select("obs_no", F.inline(F.arrays_zip(F.col("parts.indices").alias("idx"), F.col("parts.values").alias("value"))))
    return entries.toDF("obs_no", "idx", "value").select("obs_no", F.col("idx").cast("bigint").alias("idx"), (F.round("value", 6) + 0.0).alias("value"))


@query("m3_category_index", f"WITH {OBS_CTE}, keys AS (SELECT obs_no, concat(site_id, '/', obs_no) AS place FROM obs) SELECT obs_no, CAST(dense_rank() OVER (ORDER BY place) - 1 AS BIGINT) AS place_index FROM keys")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A column with nearly as many values as the table has rows, numbered by a dictionary."""
    base = obs(spark, d).select("obs_no", F.concat_ws("/", "site_id", "obs_no").alias("place"))
    known = dictionary.number_categories(base, ["place"])
    return dictionary.add_category_index(base, known, "place", "place_index").drop("place")


@query("j2_combine_columns", "SELECT p_partkey, p_size, p_retailprice, p_brand, p_type FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    numbers, texts = part.select("p_partkey", "p_size", "p_retailprice"), part.select("p_partkey", "p_brand", "p_type")
    return cleaning.combine_columns(numbers, texts, "p_partkey")
