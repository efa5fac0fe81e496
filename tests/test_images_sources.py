import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidalframe.functions import pixels
from tidalframe.operators import images
from tidalframe.sources import images as files
from tidalframe.sources import tables


def png(width, height, rgb=(10, 20, 30), extra=b""):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    raw = b"".join(b"\0" + bytes(rgb) * width for _ in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + extra + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("set")
    for cls in ("Healthy", "Bleached", "Dead"):
        (root / cls).mkdir()
    (root / "Healthy" / "a.png").write_bytes(png(4, 3))
    (root / "Healthy" / "b.PNG").write_bytes(png(4, 3))
    (root / "Bleached" / "c.png").write_bytes(png(5, 3) + b"Exif\0\0")
    (root / "Dead" / "junk.png").write_bytes(b"junk")
    (root / "Dead" / "notes.txt").write_bytes(b"text")
    return f"file://{root}"


def test_manifest_and_endings(spark, folder):
    listed = files.image_manifest(files.filter_image_ext(files.read_files(spark, folder).select("path")))
    got = {r["file_name"]: (r["class"], r["class_index"]) for r in listed.collect()}
    assert got == {"a.png": ("Healthy", 2), "b.PNG": ("Healthy", 2), "c.png": ("Bleached", 0), "junk.png": ("Dead", 1)}


def test_shapes_leave_out_unreadable_files(spark, folder):
    got = {(r.height, r.width, r.channels): r.n for r in files.image_shapes(files.read_images(spark, folder)).collect()}
    assert got == {(3, 4, 3): 2, (3, 5, 3): 1}


def test_exif(spark, folder):
    marked = files.has_exif(files.read_files(spark, folder)).where("has_exif").select("path").collect()
    assert [r.path.rsplit("/", 1)[1] for r in marked] == ["c.png"]


def test_grid_csv_drops_units(spark, tmp_path):
    (tmp_path / "g.csv").write_text("time,latitude,longitude,SST\nUTC,degrees_north,degrees_east,degree_C\n2024-01-02T00:00:00Z,1.5,2.5,NaN\n2024-01-03T00:00:00Z,1.5,2.5,28.25\n")
    got = tables.read_grid_csv(spark, str(tmp_path)).orderBy("time").collect()
    assert [r.SST for r in got][1] == 28.25 and len(got) == 2


def test_csv_keeps_text(spark, tmp_path):
    (tmp_path / "o.csv").write_text('a,b\n1,nd\n,"x,y"\n')
    assert sorted(tables.read_observations(spark, str(tmp_path)).collect(), key=str) == sorted([("1", "nd"), (None, "x,y")], key=str)


def test_class_folders(spark, tmp_path):
    df = spark.createDataFrame([("f1", "train", "Bleached"), ("f2", "val", "Unbleached")], "f string, split string, cls string")
    tables.write_by_class(df, str(tmp_path / "out"), "split", "cls")
    assert spark.read.parquet(str(tmp_path / "out" / "split=train" / "cls=Bleached")).collect() == [("f1",)]


@pytest.fixture(scope="module")
def image(spark):
    rng = np.random.default_rng(5)
    flat = np.floor(rng.random((4, 6, 3)) * [120, 200, 255])
    return flat, spark.createDataFrame([(1, flat.ravel().tolist())], "image_id int, px array<double>")


def numpy_gray(a):
    means = a.reshape(-1, 3).mean(axis=0)
    return np.floor(np.clip(a * (means.mean() / (means + 1e-8)), 0, 255))


def numpy_stretch(a):
    lo, hi = np.percentile(a.reshape(-1, 3), [1, 99], axis=0)
    return np.floor(np.clip((a - lo) * 255.0 / (hi - lo + 1e-8), 0, 255))


def test_colour_like_numpy(image):
    a, df = image
    assert np.array_equal(np.array(images.gray_world(df).first().px).reshape(a.shape), numpy_gray(a))
    assert np.array_equal(np.array(images.percentile_stretch(df).first().px).reshape(a.shape), numpy_stretch(a))
    both = np.array(images.gray_world_then_stretch(df).first().px).reshape(a.shape)
    assert np.array_equal(both, numpy_stretch(numpy_gray(a)))


def test_flip_and_channel_order(image, spark):
    a, df = image
    flipped = df.select(images.flip_rows(F.col("px"), 6)).first()[0]
    assert np.array_equal(np.array(flipped).reshape(a.shape), a[:, ::-1])
    swapped = df.select(pixels.rgb_to_bgr(F.col("px"))).first()[0]
    assert np.array_equal(np.array(swapped).reshape(a.shape), a[:, :, ::-1])


def test_augment_is_repeatable(image):
    _, df = image
    first = {(r.copy): r.px for r in images.augment(df, 3, 6).collect()}
    again = {(r.copy): r.px for r in images.augment(df.repartition(2), 3, 6).collect()}
    assert first == again and set(first) == {1, 2, 3}


def test_equalize_like_a_loop(spark):
    values = [0, 0, 0, 0, 0, 0, 1, 2, 2, 3]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v int")
    got = {r.v: r.equalized for r in images.equalize_by_group(df, "v", ["g"], bins=4, clip=1.2).collect()}
    limit = max(int(1.2 * 10 / 4), 1)
    kept = [min(values.count(b), limit) for b in range(4)]
    spread = (10 - sum(kept)) / 4
    want = {b: np.floor(3 * (sum(kept[: b + 1]) + spread * (b + 1)) / 10 + 0.5) for b in range(4)}
    assert got == want


def test_images_never_shuffle(image):
    plan = images.gray_world_then_stretch(image[1])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_equalize_keeps_null_groups_and_values(spark):
    df = spark.createDataFrame([(1, "g", 0), (2, "g", None), (3, None, 1), (4, None, 1), (5, None, 3)], "i int, g string, v int")
    got = {r.i: r.equalized for r in images.equalize_by_group(df, "v", ["g"], bins=4, clip=4.0).collect()}
    assert got[2] is None and got[3] == got[4] and got[5] == 3.0 and sorted(got) == [1, 2, 3, 4, 5]
    assert got == {r.i: r.equalized for r in images.equalize_by_group(df, "v", ["g"], bins=4, clip=4.0, few_groups=True).collect()}
