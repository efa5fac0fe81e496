"""Image folders: manifest, file types, shapes, metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidalframe.functions.labels import base_name

# File endings of images, and the marker that starts an EXIF block.
IMAGE_ENDINGS = r"(?i)\.(jpg|jpeg|png|bmp|tif|tiff)$"
EXIF_MARKER = bytes.fromhex("457869660000")


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, modificationTime, length, content) of every file below a folder; content is read only when used."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """Decoded images of a folder tree in B, G, R order; a file that is no image has height -1."""
    return spark.read.format("image").option("recursiveFileLookup", True).load(root)


def filter_image_ext(df: DataFrame, path: str = "path") -> DataFrame:
    """Keep image files by their ending."""
    return df.where(F.col(path).rlike(IMAGE_ENDINGS))


def image_manifest(df: DataFrame, path: str = "path") -> DataFrame:
    """Add class, class_index and file_name: the class is the folder, its index the place in alphabetical order."""
    named = df.withColumns({
        "class": F.element_at(F.split(path, "/"), -2),
        "file_name": base_name(F.col(path)),
    })
    classes = named.agg(F.array_sort(F.collect_set("class")).alias("c")).scalar()
    return named.withColumn("class_index", (F.array_position(classes, F.col("class")) - 1).cast("int"))


def image_shapes(df: DataFrame) -> DataFrame:
    """Images per (height, width, channels); unreadable files are left out."""
    shape = df.where(F.col("image.height") > 0).select("image.height", "image.width", "image.nChannels")
    return shape.groupBy("height", "width", F.col("nChannels").alias("channels")).agg(F.count(F.lit(1)).alias("n"))


def has_exif(df: DataFrame, content: str = "content") -> DataFrame:
    """Add ``has_exif``."""
    return df.withColumn("has_exif", F.contains(F.col(content), F.lit(EXIF_MARKER)))
