"""Queries on image files, pixel arrays and local contrast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidalframe.functions import pixels as px
from tidalframe.operators import images
from tidalframe.plans.catalog import query
from tidalframe.plans.standins import PIXELS_CTE, obs, OBS_CTE, pixels, table
from tidalframe.sources import images as files

# Interleaved values of one stand-in image row: 7 pixels of 3 channels, three rows, one value left over.
WIDTH, HEIGHT = 7, 4


def _long(df: DataFrame, *keep: str) -> DataFrame:
    """(image_id, pos, v) rows for comparison."""
    return df.select("image_id", *keep, F.posexplode("px").alias("pos", "v")).select(
        "image_id", *keep, F.col("pos").cast("bigint").alias("pos"), F.round("v", 6).alias("v")
    )


_PATHS_SQL = """paths AS (SELECT vec_id AS image_id, concat('file:/set/', CASE WHEN label < 5 THEN 'Bleached' ELSE 'Unbleached' END, '/img_', vec_id,
 CASE vec_id % 7 WHEN 0 THEN '.JPG' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.png' WHEN 3 THEN '.bmp' WHEN 4 THEN '.tif' WHEN 5 THEN '.tiff' ELSE '.txt' END) AS path FROM embeddings)"""


def _paths(spark: SparkSession, d: str) -> DataFrame:
    """A file listing with one path per vector, as the file source would give it."""
    endings = F.array(*[F.lit(e) for e in (".JPG", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".txt")])
    folder = F.when(F.col("label") < 5, "Bleached").otherwise("Unbleached")
    path = F.concat(F.lit("file:/set/"), folder, F.lit("/img_"), F.col("vec_id").cast("string"), F.get(endings, (F.col("vec_id") % 7).cast("int")))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), path.alias("path"))


@query("s2_image_manifest", f"WITH {_PATHS_SQL} SELECT image_id, path, split_part(path, '/', 3) AS class, split_part(path, '/', 4) AS file_name, CASE WHEN split_part(path, '/', 3) = 'Bleached' THEN 0 ELSE 1 END AS class_index FROM paths")
def _(spark: SparkSession, d: str) -> DataFrame:
    return files.image_manifest(_paths(spark, d))


@query("s3_filter_image_ext", f"WITH {_PATHS_SQL} SELECT image_id, path FROM paths WHERE NOT ends_with(path, '.txt')")
def _(spark: SparkSession, d: str) -> DataFrame:
    return files.filter_image_ext(_paths(spark, d))


@query("s4_image_shapes", "SELECT h AS height, w AS width, CAST(3 AS INTEGER) AS channels, CAST(count(*) AS BIGINT) AS n FROM (SELECT CAST(CASE WHEN doc_id % 50 = 0 THEN -1 ELSE 8 + doc_id % 3 END AS INTEGER) AS h, CAST(16 + n_chars % 4 AS INTEGER) AS w FROM documents) WHERE h > 0 GROUP BY h, w")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Decoded-image rows shaped by each document; every fiftieth stands for a file that is no image."""
    height = F.when(F.col("doc_id") % 50 == 0, -1).otherwise(8 + F.col("doc_id") % 3).cast("int")
    image = F.struct(
        F.col("source").alias("origin"), height.alias("height"), (16 + F.col("n_chars") % 4).cast("int").alias("width"),
        F.lit(3).alias("nChannels"), F.lit(16).alias("mode"), F.col("text").cast("binary").alias("data"),
    )
    return files.image_shapes(table(spark, d, "documents").select(image.alias("image")))


@query("s5_has_exif", "SELECT doc_id, doc_id % 4 = 0 AS has_exif FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    """File contents with the marker put between a header and the text for every fourth document."""
    content = F.concat(
        F.lit(bytes.fromhex("FFD8FFE1")), F.when(F.col("doc_id") % 4 == 0, F.lit(files.EXIF_MARKER)).otherwise(F.lit(b"")),
        F.col("text").cast("binary"),
    )
    return files.has_exif(table(spark, d, "documents").select("doc_id", content.alias("content"))).drop("content")


@query("c15_rescale_255", f"WITH {PIXELS_CTE} SELECT image_id, pos, round(v / 255, 6) AS v FROM pixels")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _long(pixels(spark, d).withColumn("px", px.rescale_255(F.col("px"))))


@query("c16_imagenet_center", f"WITH {PIXELS_CTE} SELECT image_id, pos, round(v - CASE pos % 3 WHEN 0 THEN CAST(103.939 AS DOUBLE) WHEN 1 THEN CAST(116.779 AS DOUBLE) ELSE CAST(123.68 AS DOUBLE) END, 6) AS v FROM pixels")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _long(pixels(spark, d).withColumn("px", px.imagenet_center(F.col("px"))))


@query("i1_channel_means", f"WITH {PIXELS_CTE} SELECT image_id, class, round(avg(CASE WHEN pos % 3 = 0 THEN v END), 6) AS mean_0, round(avg(CASE WHEN pos % 3 = 1 THEN v END), 6) AS mean_1, round(avg(CASE WHEN pos % 3 = 2 THEN v END), 6) AS mean_2 FROM pixels GROUP BY image_id, class")
def _(spark: SparkSession, d: str) -> DataFrame:
    found = images.channel_means(pixels(spark, d))
    return found.select("image_id", "class", *[F.round(f"mean_{c}", 6).alias(f"mean_{c}") for c in range(3)])


_MEANS = "means AS (SELECT image_id, avg(CASE WHEN pos % 3 = 0 THEN v END) AS m0, avg(CASE WHEN pos % 3 = 1 THEN v END) AS m1, avg(CASE WHEN pos % 3 = 2 THEN v END) AS m2 FROM pixels GROUP BY image_id)"
_GRAY = f"{PIXELS_CTE}, {_MEANS}, gray AS (SELECT image_id, class, pos, floor(least(greatest(v * (((m0 + m1 + m2) / 3) / (CASE pos % 3 WHEN 0 THEN m0 WHEN 1 THEN m1 ELSE m2 END + CAST(1e-8 AS DOUBLE))), 0.0), 255.0)) AS v FROM pixels JOIN means USING (image_id))"


def _stretch_sql(source: str) -> str:
    return f"""lims AS (SELECT image_id, pos % 3 AS ch, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM {source} GROUP BY image_id, pos % 3),
stretched AS (SELECT p.image_id, pos, floor(least(greatest((v - lo) * 255.0 / (hi - lo + CAST(1e-8 AS DOUBLE)), 0.0), 255.0)) AS v FROM {source} p JOIN lims l ON l.image_id = p.image_id AND l.ch = p.pos % 3)"""


@query("i2_gray_world", f"WITH {_GRAY} SELECT image_id, pos, v FROM gray")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _long(images.gray_world(pixels(spark, d)))


@query("i3_percentile_stretch", f"WITH {PIXELS_CTE}, {_stretch_sql('pixels')} SELECT * FROM stretched")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _long(images.percentile_stretch(pixels(spark, d)))


@query("i4_gray_world_then_stretch", f"WITH {_GRAY}, {_stretch_sql('gray')} SELECT * FROM stretched")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _long(images.gray_world_then_stretch(pixels(spark, d)))


def _equalize_sql(source: str, group: str, value: str, bins: int, clip: float) -> str:
    """hist .. lut: the mapping table of every group, written with plain windows."""
    return f"""hist AS (SELECT {group}, {value} AS b, count(*) AS n, sum(count(*)) OVER (PARTITION BY {group}) AS size FROM {source} GROUP BY {group}, {value}),
kept AS (SELECT *, least(n, greatest(floor({clip} * size / {bins}), 1)) AS k FROM hist),
lut AS (SELECT *, round({bins - 1} * (sum(k) OVER (PARTITION BY {group} ORDER BY b) + CAST(size - sum(k) OVER (PARTITION BY {group}) AS DOUBLE) * (b + 1) / {bins}) / size) AS equalized FROM kept)"""


_TILES = f"""lit AS (SELECT image_id, CAST(pos // 3 AS INTEGER) AS pixel, CAST(floor(avg(v)) AS INTEGER) AS intensity FROM gray GROUP BY image_id, pos // 3),
tiled AS (SELECT *, CAST(floor(pixel // {WIDTH} * 8 / {HEIGHT}) * 8 + floor(pixel % {WIDTH} * 8 / {WIDTH}) AS INTEGER) AS tile FROM lit)"""


@query("i5_local_contrast", f"WITH {_GRAY}, {_TILES}, {_equalize_sql('tiled', 'image_id, tile', 'intensity', 256, 2.0)} SELECT t.image_id, t.pixel, t.tile, t.intensity, equalized FROM tiled t JOIN lut l ON l.image_id = t.image_id AND l.tile = t.tile AND l.b = t.intensity")
def _(spark: SparkSession, d: str) -> DataFrame:
    return images.local_contrast(pixels(spark, d), WIDTH, HEIGHT)


@query("w7_equalize_by_group", f"WITH {OBS_CTE}, binned AS (SELECT obs_no, realm_name, CAST(floor(depth_m) AS INTEGER) AS depth_bin FROM obs WHERE depth_m IS NOT NULL), {_equalize_sql('binned', 'realm_name', 'depth_bin', 64, 2.0)} SELECT b.obs_no, b.realm_name, b.depth_bin, equalized FROM binned b LEFT JOIN lut l ON l.realm_name IS NOT DISTINCT FROM b.realm_name AND l.b = b.depth_bin")
def _(spark: SparkSession, d: str) -> DataFrame:
    binned = obs(spark, d).where("depth_m IS NOT NULL").select("obs_no", "realm_name", F.floor("depth_m").cast("int").alias("depth_bin"))
    return images.equalize_by_group(binned, "depth_bin", ["realm_name"], bins=64, clip=2.0, few_groups=True)


def _draw_sql(what: str) -> str:
    return f"CAST(CAST(('0x' || substr(md5(concat('42:{what}:', image_id, ':', copy)), 1, 8)) AS BIGINT) AS DOUBLE) / 4294967296"


_COPIES = f"""{PIXELS_CTE}, copies AS (SELECT i.image_id, c.copy, {_draw_sql('flip')} < 0.5 AS flipped, 1 + ({_draw_sql('contrast')} * 2 - 1) * CAST(0.1 AS DOUBLE) AS factor
 FROM (SELECT DISTINCT image_id FROM pixels) i, (VALUES (1), (2)) c(copy)),
turned AS (SELECT c.image_id, c.copy, factor, CASE WHEN flipped AND pos < {WIDTH * 3 * 3} THEN pos // {WIDTH * 3} * {WIDTH * 3} + ({WIDTH} - 1 - pos % {WIDTH * 3} // 3) * 3 + pos % 3 ELSE pos END AS pos, v FROM copies c JOIN pixels p ON p.image_id = c.image_id),
centred AS (SELECT *, avg(v) OVER (PARTITION BY image_id, copy, pos % 3) AS m FROM turned)"""


@query("i6_augment", f"WITH {_COPIES} SELECT image_id, CAST(copy AS INTEGER) AS copy, pos, round(least(greatest((v - m) * factor + m, 0.0), 255.0), 6) AS v FROM centred")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _long(images.augment(pixels(spark, d).drop("class"), copies=2, width=WIDTH), "copy")
