"""Queries on joins, lookups, sorting and picking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidalframe.functions import labels
from tidalframe.operators import cleaning, enrich, profiling, scoring, selection
from tidalframe.plans.catalog import query
from tidalframe.plans.standins import (
    GRID_CELLS, GRID_CTE, OBS_CTE, REQUESTS_CTE, SITE_POINTS, numbered_events, obs, plain, r6, requests, table, view,
)
from tidalframe.session import scratch_path
from tidalframe.sources import tables


@query("j1_multi_year_rows", f"WITH {OBS_CTE} SELECT obs_no, site_id, obs_year, depth_m FROM obs WHERE site_id IN (SELECT site_id FROM obs GROUP BY site_id HAVING count(DISTINCT obs_year) > 1)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return profiling.multi_year_rows(obs(spark, d).select("obs_no", "site_id", "obs_year", "depth_m"), "site_id", "obs_year")


@query("j3_fuse_scores", f"WITH {REQUESTS_CTE}, i AS (SELECT request_id, image_score FROM requests WHERE image_score IS NOT NULL), t AS (SELECT request_id, tabular_score FROM requests WHERE tabular_score IS NOT NULL) SELECT coalesce(i.request_id, t.request_id) AS request_id, image_score, tabular_score FROM i FULL JOIN t ON i.request_id = t.request_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    r = requests(spark, d)
    image = r.where("image_score IS NOT NULL").select("request_id", "image_score")
    tabular = r.where("tabular_score IS NOT NULL").select("request_id", "tabular_score")
    return scoring.fuse_scores(image, tabular)


_FALLBACK = {
    "Distance_to_Shore": "fetched", "Turbidity": "both", "Cyclone_Frequency": "none", "Depth_m": "override",
    "ClimSST": "fetched", "Temperature_Kelvin": "both", "Temperature_Kelvin_Standard_Deviation": "none", "Windspeed": "none",
}
_OVERRIDE_SQL = {"fetched": "coalesce(f, {d})", "both": "coalesce(o, f, {d})", "none": "{d}", "override": "coalesce(o, {d})"}


@query("j4_apply_overrides", "WITH o AS (SELECT o_orderkey AS point_id, o_totalprice / 1000 AS o FROM orders WHERE o_orderkey % 3 = 0), f AS (SELECT l_orderkey AS point_id, max(l_quantity) AS f FROM lineitem GROUP BY l_orderkey) SELECT r.o_orderkey AS point_id, " + ", ".join(
    f"round({_OVERRIDE_SQL[kind].format(d=f'CAST({enrich.DEFAULT_FEATURES[c]} AS DOUBLE)')}, 6) AS {c}" for c, kind in _FALLBACK.items()) + " FROM orders r LEFT JOIN f ON r.o_orderkey = f.point_id LEFT JOIN o ON r.o_orderkey = o.point_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")

    def named(value: str, kinds: tuple[str, ...]) -> list:
        return [F.col(value).alias(c) for c, kind in _FALLBACK.items() if kind in kinds]

    fetched = lines.groupBy(F.col("l_orderkey").alias("point_id")).agg(F.max("l_quantity").alias("f")).select("point_id", *named("f", ("fetched", "both")))
    overrides = orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("point_id"), (F.col("o_totalprice") / 1000).alias("o")).select("point_id", *named("o", ("override", "both")))
    points = orders.select(F.col("o_orderkey").alias("point_id"))
    return enrich.apply_overrides(points, fetched, overrides, "point_id").select("point_id", *[r6(c) for c in enrich.DEFAULT_FEATURES])


@query("j5_grid_lookup", f"WITH {GRID_CTE} SELECT p.point_id, p.grid_date, CAST(round((lat - CAST(-89.975 AS DOUBLE)) / CAST(0.05 AS DOUBLE)) AS BIGINT) AS iy, CAST(round((lon - CAST(-179.975 AS DOUBLE)) / CAST(0.05 AS DOUBLE)) AS BIGINT) AS ix, round(sst, 6) AS sst, round(clim_sst, 6) AS clim_sst FROM site_points p LEFT JOIN grid_cells g ON g.grid_date = p.grid_date AND g.iy = CAST(round((lat - CAST(-89.975 AS DOUBLE)) / CAST(0.05 AS DOUBLE)) AS BIGINT) AND g.ix = CAST(round((lon - CAST(-179.975 AS DOUBLE)) / CAST(0.05 AS DOUBLE)) AS BIGINT)")
def _(spark: SparkSession, d: str) -> DataFrame:
    found = enrich.grid_lookup(view(spark, d, SITE_POINTS), view(spark, d, GRID_CELLS))
    return found.select("point_id", "grid_date", "iy", "ix", r6("sst"), r6("clim_sst"))


_GRID_FILE = """
SELECT CAST(l_shipdate AS DATE) AS grid_date, l_suppkey % 5 AS iy, l_partkey % 4 AS ix, l_orderkey * 10 + l_linenumber AS seq, 20 + l_discount * 100 AS sst
FROM {lineitem}"""


@query("j5_grid_file_lookup", f"""WITH {GRID_CTE}, rows AS ({plain(_GRID_FILE)}),
last AS (SELECT grid_date, iy, ix, max_by(sst, struct_pack(seq, sst)) AS sst FROM rows GROUP BY grid_date, iy, ix),
placed AS (SELECT point_id, grid_date, CAST(round((lat - CAST(-89.975 AS DOUBLE)) / CAST(0.05 AS DOUBLE)) AS BIGINT) AS iy, CAST(round((lon - CAST(-179.975 AS DOUBLE)) / CAST(0.05 AS DOUBLE)) AS BIGINT) AS ix FROM site_points)
SELECT point_id, p.grid_date, p.iy, p.ix, round(sst + CAST(273.15 AS DOUBLE), 6) AS sst FROM placed p LEFT JOIN last USING (grid_date, iy, ix)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """From the file of a grid, with coordinates, units and several rows a cell, to Kelvin at the points."""
    path = scratch_path(spark, "grid-file")
    lines = view(spark, d, _GRID_FILE).select(
        labels.grid_date_text(F.col("grid_date")).alias("time"), (F.col("iy") * enrich.CELL + enrich.FIRST_LAT).alias("latitude"),
        (F.col("ix") * enrich.CELL + enrich.FIRST_LON).alias("longitude"), "seq", "sst",
    )
    lines = lines.select(*[F.col(c).cast("string").alias(c) for c in lines.columns])
    units = spark.range(1).select(*[F.lit(u).alias(c) for c, u in zip(lines.columns, ("UTC", "degrees_north", "degrees_east", "", "degree_C"))])
    units.unionByName(lines).write.option("header", True).csv(path)
    grid = enrich.grid_cells(tables.read_grid_csv(spark, path))
    found = enrich.grid_lookup(view(spark, d, SITE_POINTS), grid, unit="C", order=["seq", "sst"])
    return found.select("point_id", "grid_date", "iy", "ix", r6("sst"))


_IMPORTANCE_SQL = "imp AS (SELECT l_partkey AS idx, avg(l_discount) - 0.05 AS importance FROM lineitem GROUP BY l_partkey)"


def _importances(spark: SparkSession, d: str) -> DataFrame:
    """Signed importance per part, rounded so that equal values stay equal in any summing order."""
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("idx")).agg(F.round(F.avg("l_discount") - 0.05, 6).alias("importance"))


def _part_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("name"))


@query("j7_name_importances", f"WITH {_IMPORTANCE_SQL} SELECT idx, p_name AS name, round(importance, 6) + 0.0 AS importance FROM imp JOIN part ON p_partkey = idx")
def _(spark: SparkSession, d: str) -> DataFrame:
    return selection.name_importances(_part_names(spark, d), _importances(spark, d))


@query("o1_sort_desc", "SELECT o_orderpriority, round(avg(o_totalprice), 6) AS mean_price FROM orders GROUP BY o_orderpriority")
def _(spark: SparkSession, d: str) -> DataFrame:
    means = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 6).alias("mean_price"))
    return cleaning.sort_desc(means, "mean_price", "o_orderpriority")


@query("o2_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.head(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 20, F.desc("o_totalprice"), "o_orderkey")


@query("o3_top_k_features", f"WITH {_IMPORTANCE_SQL}, named AS (SELECT idx, p_name AS name, round(importance, 6) + 0.0 AS importance FROM imp JOIN part ON p_partkey = idx) SELECT * FROM named ORDER BY abs(importance) DESC, idx LIMIT 20")
def _(spark: SparkSession, d: str) -> DataFrame:
    named = selection.name_importances(_part_names(spark, d), _importances(spark, d))
    return selection.top_k_features(named, 20)


@query("o4_last_row", "SELECT user_id, event_id, ts, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events) WHERE i = 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return enrich.last_row(events, ["user_id"], ["ts", "event_id"])


_SWEEPS = """sweeps AS (SELECT user_id AS run, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS seq,
 CASE (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) % 5 WHEN 0 THEN 50 WHEN 1 THEN 30 WHEN 2 THEN 20 WHEN 3 THEN 10 ELSE 5 END AS k,
 round(1 - value / 500, 2) AS f1 FROM events)"""


def _sweeps(spark: SparkSession, d: str) -> DataFrame:
    events = numbered_events(spark, d, "place")
    rows = events.select(F.col("user_id").alias("run"), (F.col("place") - 1).alias("seq"), F.round(1 - F.col("value") / 500, 2).alias("f1"))
    k = F.get(F.array(*[F.lit(x) for x in (50, 30, 20, 10, 5)]), (F.col("seq") % 5).cast("int"))
    return rows.select("run", "seq", k.alias("k"), "f1")


@query("o5_best_result", f"WITH {_SWEEPS} SELECT run, seq, k, f1 FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY f1 DESC, seq) AS i FROM sweeps) WHERE i = 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return selection.best_result(_sweeps(spark, d), "run")


@query("o6_pick_by_k", f"WITH {_SWEEPS} SELECT run, seq, k, f1 FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY seq) AS i FROM sweeps WHERE k = 10) WHERE i = 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return selection.pick_by_k(_sweeps(spark, d), 10, "run")


@query("w6_sweep_stop", f"WITH {_SWEEPS}, marked AS (SELECT *, max(CASE WHEN f1 < CAST(0.95 AS DOUBLE) - CAST(0.05 AS DOUBLE) THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gone FROM sweeps) SELECT run, seq, k, f1 FROM marked WHERE coalesce(gone, 0) = 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    return selection.sweep_stop(_sweeps(spark, d), 0.95, 0.05, "run")


@query("c12_risk_level", f"WITH {REQUESTS_CTE} SELECT request_id, CASE WHEN image_score * 100 > 70 THEN 'High Risk' WHEN image_score * 100 > 40 THEN 'Moderate Risk' WHEN image_score IS NOT NULL THEN 'Low Risk' END AS level FROM requests")
def _(spark: SparkSession, d: str) -> DataFrame:
    return requests(spark, d).select("request_id", labels.risk_level(F.col("image_score") * 100).alias("level"))


@query("c13_risk_label", f"WITH {REQUESTS_CTE} SELECT request_id, CASE WHEN image_score IS NULL THEN NULL ELSE printf('%.1f%%', image_score * 100) END AS label FROM requests")
def _(spark: SparkSession, d: str) -> DataFrame:
    percent = F.col("image_score") * 100
    return requests(spark, d).select("request_id", F.when(percent.isNotNull(), labels.risk_label(percent)).alias("label"))


@query("c14_base_name", "SELECT page_id, regexp_extract(url, '[^/]*$') AS name FROM pages")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", labels.base_name(F.col("url")).alias("name"))


@query("c17_default_features", "SELECT s_suppkey, " + ", ".join(f"CAST({v} AS DOUBLE) AS {c}" for c, v in enrich.DEFAULT_FEATURES.items()) + " FROM supplier")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Defaults given to every supplier: the one-row table is a scalar of the plan."""
    row = enrich.default_features(spark).select(F.struct("*").alias("s")).scalar()
    return table(spark, d, "supplier").select("s_suppkey", *[row[c].alias(c) for c in enrich.DEFAULT_FEATURES])


@query("c18_grid_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') AS grid_time FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", labels.grid_date_text(F.col("o_orderdate")).alias("grid_time"))
