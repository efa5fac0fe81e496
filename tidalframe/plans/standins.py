"""Stand-in views: observation, request, score, grid, history and pixel tables derived from the given tables.

Each view is one SQL text that both engines run, except pixels, where array syntax differs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidalframe.operators.cleaning import clean_missing, to_numeric_columns
from tidalframe.operators.history import number_rows
from tidalframe.session import kept

OBS_RAW = """
SELECT l.l_orderkey * 10 + l.l_linenumber AS obs_no,
 o.o_custkey AS site_id,
 CAST(o.o_orderdate AS DATE) AS obs_date,
 n.n_name AS country_name, r.r_name AS realm_name,
 CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE o.o_orderpriority END AS exposure,
 CASE WHEN (l.l_orderkey + l.l_linenumber) % 6 = 0 THEN 'nd'
      WHEN l.l_quantity <= 20 THEN '0.0'
      ELSE CAST((l.l_quantity - 20) * 3 AS VARCHAR(20)) END AS percent_bleaching,
 CASE WHEN l.l_partkey % 13 = 0 THEN 'ND' ELSE CAST(l.l_quantity + (l.l_suppkey % 7) AS VARCHAR(20)) END AS depth_m,
 CASE WHEN l.l_partkey % 17 = 0 THEN '' ELSE CAST(l.l_discount AS VARCHAR(20)) END AS turbidity,
 CASE WHEN l.l_suppkey % 5 < 2 THEN 'nd' ELSE CAST(l.l_tax AS VARCHAR(20)) END AS percent_cover,
 CAST(l.l_extendedprice / 1000 AS VARCHAR(20)) AS distance_to_shore,
 CASE WHEN l.l_suppkey % 10 = 0 THEN 'src?' ELSE CAST(l.l_suppkey AS VARCHAR(20)) END AS data_source
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {nation} n ON c.c_nationkey = n.n_nationkey
JOIN {region} r ON n.n_regionkey = r.r_regionkey
"""

# The same rows, for many orders: sites get their country before the lines come, so that the lines are shuffled by order only.
_SITES_FIRST = (
    "JOIN ({orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey "
    "JOIN {region} r ON n.n_regionkey = r.r_regionkey) ON l.l_orderkey = o.o_orderkey"
)
MANY_ORDERS = 1_000_000

SCORE_PAIRS = """
SELECT event_id AS item_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label,
 value / 500 AS p, CASE WHEN value / 500 >= 0.1 THEN 1 ELSE 0 END AS pred
FROM {events}
"""

REQUESTS = """
SELECT event_id AS request_id,
 CASE event_id % 5 WHEN 0 THEN 'Multi-Modal Fusion (Image + Data)' WHEN 1 THEN 'Image-Only (VGG Augmented)'
  WHEN 2 THEN 'Tabular-Only' WHEN 3 THEN 'Manual Data Entry Only (No NOAA Pull)' ELSE 'other' END AS prediction_type,
 CASE WHEN event_id % 7 = 0 THEN NULL ELSE props END AS tabular_json,
 CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'image/png' END AS content_type,
 CASE WHEN event_id % 7 = 0 THEN NULL ELSE value / 500 END AS tabular_score,
 CASE WHEN event_id % 3 = 0 THEN NULL ELSE (event_id % 100) / CAST(100 AS DOUBLE) END AS image_score
FROM {events}
"""

GRID_CELLS = """
SELECT CAST(l_shipdate AS DATE) AS grid_date, l_suppkey % 5 AS iy, l_partkey % 4 AS ix,
 MAX(20 + l_discount * 100) AS sst, MAX(25 + l_tax * 10) AS clim_sst
FROM {lineitem} GROUP BY CAST(l_shipdate AS DATE), l_suppkey % 5, l_partkey % 4
"""

SITE_POINTS = """
SELECT o_orderkey AS point_id, CAST(o_orderdate AS DATE) AS grid_date,
 CAST(-89.975 + 0.05 * (o_custkey % 5) + 0.01 AS DOUBLE) AS lat, CAST(-179.975 + 0.05 * (o_orderkey % 4) - 0.01 AS DOUBLE) AS lon
FROM {orders}
"""

HISTORY = """
SELECT user_id AS run_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch,
 value / 500 AS val_accuracy
FROM {events}
"""

# A scoring payload per event: numbers, numbers as text, texts, null data; some are no objects or cut off and don't parse.
PAYLOADS = """
SELECT event_id AS request_id,
 CASE WHEN event_id % 13 = 0 THEN '{{"prediction_type": "Tab' WHEN event_id % 37 = 0 THEN '[1, 2]'
  WHEN event_id % 7 = 0 THEN concat('{{"prediction_type": "', prediction_type, '"}}')
  WHEN event_id % 31 = 0 THEN concat('{{"prediction_type": "', prediction_type, '", "tabular_data": null}}')
  WHEN event_id % 11 = 0 THEN concat('{{"prediction_type": "', prediction_type, '", "tabular_data": {{"Realm_Name": "Central Indo-Pacific, west", ', substring(props, 2, length(props) - 1), '}}')
  WHEN event_id % 19 = 0 THEN concat('{{"prediction_type": "', prediction_type, '", "tabular_data": {{"Realm_Name": "Tethys", "k": "', CAST(event_id % 50 AS VARCHAR(20)), '"}}}}')
  WHEN event_id % 41 = 0 THEN concat('{{"prediction_type": "', prediction_type, '", "tabular_data": {{"Realm_Name": "none"}}}}')
  ELSE concat('{{"prediction_type": "', prediction_type, '", "tabular_data": ', props, '}}') END AS payload,
 CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 17 = 0 THEN 'text/plain' ELSE 'image/png' END AS content_type, ts AS sent
FROM (SELECT event_id, ts, props, CASE event_id % 5 WHEN 0 THEN 'Multi-Modal Fusion (Image + Data)' WHEN 1 THEN 'Image-Only (VGG Augmented)'
  WHEN 2 THEN 'Tabular-Only' WHEN 3 THEN 'Manual Data Entry Only (No NOAA Pull)' ELSE 'other' END AS prediction_type FROM {events}) e
"""

# The image content of every request that names an image; for some there is none.
IMAGES = """
SELECT event_id AS request_id, ts AS sent, embedding AS image
FROM {events} JOIN {embeddings} ON vec_id = event_id % 200
WHERE event_id % 3 <> 0 AND event_id % 17 <> 0 AND event_id % 23 <> 0
"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

MEASURES = ["percent_bleaching", "depth_m", "turbidity", "percent_cover", "distance_to_shore"]
FEATURES = ["depth_m", "turbidity", "distance_to_shore"]


_plans: dict[tuple[str, str, str], DataFrame] = {}


def _once(spark: SparkSession, folder: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The same lazy plan for every use in a session: footers and listings are read once."""
    at = (spark.sparkContext.applicationId, folder, name)
    if at not in _plans or _plans[at].sparkSession is not spark:
        _plans[at] = make()
    return _plans[at]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return _once(spark, folder, name, lambda: spark.read.parquet(f"{folder}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Use every core on an input with fewer splits than cores; an input with more is left as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def view(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """Run a view text over the parquet tables it names."""
    used = {t: table(spark, folder, t) for t in TABLES if "{" + t + "}" in sql}
    if sql.startswith(OBS_RAW[:40]):
        used["lineitem"] = spread(used["lineitem"])
    return spark.sql(sql, **used)


def plain(sql: str) -> str:
    """The view text with bare table names, as the checking engine sees it."""
    return sql.format(**{t: t for t in TABLES}).strip()


def _raw(spark: SparkSession, folder: str) -> DataFrame:
    if table(spark, folder, "orders").count() <= MANY_ORDERS:
        return view(spark, folder, OBS_RAW)
    return view(spark, folder, OBS_RAW[: OBS_RAW.index("JOIN {orders}")] + _SITES_FIRST)


def obs_raw(spark: SparkSession, folder: str) -> DataFrame:
    return _once(spark, folder, "reef_obs_raw", lambda: _raw(spark, folder))


def obs_dup(spark: SparkSession, folder: str) -> DataFrame:
    """Observations where every tenth site's rows are there twice."""
    raw = obs_raw(spark, folder)
    return raw.unionByName(raw.where("site_id % 10 = 0"))


def obs(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaned and typed observations, year and month included."""
    typed = to_numeric_columns(clean_missing(obs_raw(spark, folder)), MEASURES)
    return typed.withColumns({"obs_year": F.year("obs_date").cast("bigint"), "obs_month": F.month("obs_date").cast("bigint")})


def obs_kept(spark: SparkSession, folder: str, cols: Sequence[str], where: str = "TRUE") -> DataFrame:
    """Columns of the observations, joined and typed once per session: what a query reads that passes over them several times."""
    name = f"{','.join(cols)} {where}"
    return _once(spark, folder, name, lambda: kept(obs(spark, folder).where(where).select(*cols), "observations"))


OBS_RAW_CTE = f"reef_obs_raw AS ({plain(OBS_RAW)})"
OBS_CTE = f"""{OBS_RAW_CTE}, obs AS (
SELECT obs_no, site_id, obs_date, country_name, realm_name, exposure,
 TRY_CAST(percent_bleaching AS DOUBLE) AS percent_bleaching, TRY_CAST(depth_m AS DOUBLE) AS depth_m,
 TRY_CAST(turbidity AS DOUBLE) AS turbidity, TRY_CAST(percent_cover AS DOUBLE) AS percent_cover,
 TRY_CAST(distance_to_shore AS DOUBLE) AS distance_to_shore, data_source,
 CAST(year(obs_date) AS BIGINT) AS obs_year, CAST(month(obs_date) AS BIGINT) AS obs_month
FROM reef_obs_raw)"""
SCORES_CTE = f"score_pairs AS ({plain(SCORE_PAIRS)})"
REQUESTS_CTE = f"requests AS ({plain(REQUESTS)})"
PAYLOADS_CTE = f"payloads AS ({plain(PAYLOADS)}), images AS ({plain(IMAGES)})"
GRID_CTE = f"grid_cells AS ({plain(GRID_CELLS)}), site_points AS ({plain(SITE_POINTS)})"
HISTORY_CTE = f"history AS ({plain(HISTORY)})"


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    """(image_id, class, px): every vector as 64 interleaved channel values 0..255."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("image_id"),
        F.when(F.col("label") < 5, "Bleached").otherwise("Unbleached").alias("class"),
        F.transform(
            "embedding", lambda x: F.least(F.greatest((x.cast("double") + 0.5) * 255, F.lit(0.0)), F.lit(255.0))
        ).alias("px"),
    )


PIXELS_CTE = """pixels AS (
SELECT vec_id AS image_id, CASE WHEN label < 5 THEN 'Bleached' ELSE 'Unbleached' END AS class,
 CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS pos,
 least(greatest((CAST(unnest(embedding) AS DOUBLE) + 0.5) * 255, 0.0), 255.0) AS v
FROM embeddings)"""


def scores(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, SCORE_PAIRS)


def requests(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, REQUESTS)


def payloads(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, PAYLOADS)


def images(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, IMAGES)


def numbered_events(spark: SparkSession, folder: str, out: str) -> DataFrame:
    """Events with their place among the user's events in time order, from 1; numbered day by day, so a busy user is many tasks."""
    return number_rows(table(spark, folder, "events"), ["user_id"], F.to_date("ts"), ["ts", "event_id"], out)


def history(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the view text ``HISTORY``."""
    return numbered_events(spark, folder, "epoch").select(
        F.col("user_id").alias("run_id"), F.col("epoch"), (F.col("value") / 500).alias("val_accuracy")
    )


def r6(name: str):
    """Column rounded to six places, as the checking SQL does."""
    return F.round(F.col(name), 6).alias(name)
