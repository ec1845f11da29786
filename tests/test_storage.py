"""Z-ordered storage, packed patches, lines on irregular axes and long greedy paths."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracol.operators import packed as K
from terracol.operators import raster as R
from terracol.operators import tiles as T
from terracol.sources import tables as S


def test_regions_are_read_from_their_zones(spark, tmp_path):
    path = str(tmp_path / "mask")
    cells = spark.range(128 * 128).select(F.floor(F.col("id") / 128).cast("int").alias("row"), (F.col("id") % 128).cast("int").alias("col"))
    S.write_mask(cells.union(cells.limit(5)), path, (0.0, 1.0, 0.0, 1.0), zone_bits=4)
    assert S.scan_mask(spark, path).count() == 128 * 128
    for rect in ((17, 40, 60, 64), (0, 128, 0, 128), (-5, 3, 126, 500), (40, 40, 0, 9), (100, 90, 0, 9)):
        got = S.scan_mask_cropped(spark, path, rect)
        assert {tuple(r) for r in got.collect()} == {(r - rect[0], c - rect[2]) for r in range(max(rect[0], 0), min(rect[1], 128)) for c in range(max(rect[2], 0), min(rect[3], 128))}
    plan = S.scan_tiled(spark, path, (17, 40, 60, 64))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [zone_4" in plan and "GreaterThanOrEqual(row,17)" in plan
    files = lambda rect: S.scan_tiled(spark, path, rect).select(F.input_file_name().alias("f")).distinct().count()
    assert files((17, 30, 50, 60)) < files(None) / 8


def test_zones_beyond_those_named(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "NAMED_ZONES", 2)
    path = str(tmp_path / "pixels")
    pixels = spark.range(40 * 30).select(F.floor(F.col("id") / 30).cast("int").alias("row"), (F.col("id") % 30).cast("int").alias("col"), (F.col("id") % 2).alias("data_source"), F.col("id").alias("value"))
    S.write_pixel_table(pixels, path, zone_bits=2)
    got = S.scan_pixel_table(spark, path, 1, (3, 33, 5, 28))
    assert {r["value"] for r in got.collect()} == {r * 30 + c for r in range(3, 33) for c in range(5, 28) if (r * 30 + c) % 2}
    assert S.scan_pixel_table(spark, path).count() == 1200 and "tile" not in got.columns


@pytest.mark.parametrize("side,h,w,crop,overlap", [(8, 27, 35, 5, 0.3), (16, 20, 20, 10, 0.0), (256, 27, 35, 6, 0.5), (4, 9, 31, 9, 0.2)])
def test_packed_patches(spark, monkeypatch, side, h, w, crop, overlap):
    monkeypatch.setattr(K, "SIDE", side)
    rnd = random.Random(3)
    img = [(r, c, rnd.random(), None if rnd.random() < 0.2 else float(c)) for r in range(h) for c in range(w) if rnd.random() < 0.9 and not (r < 6 and c < 7)]
    df = spark.createDataFrame(img, "row int, col int, a double, b double")
    packed = K.pack_patches(df, ["a", "b"], h, w, crop, overlap)
    rows = packed.collect()
    assert len({r["patch_id"] for r in rows}) == len(rows) and all(len(r["a"]) == len(r["b"]) == crop * crop for r in rows)
    origins = R.patch_origins(h, w, crop, overlap)
    assert all((r["top"], r["left"]) == origins[r["patch_id"]] for r in rows)
    key = lambda df: sorted(map(str, (tuple(r) for r in df.select("patch_id", "r", "c", "a", "b").collect())))
    assert key(K.unpack_patches(packed, ["a", "b"], crop)) == key(R.tile_patches(df, h, w, crop, overlap))
    more = K.unpack_patches(K.augment_packed(packed, ["a"], crop), ["a"], crop).select("patch_id", "op", "r", "c", "a")
    plain = R.augment_patches(R.tile_patches(df, h, w, crop, overlap), crop).select("patch_id", "op", "r", "c", "a")
    assert sorted(map(tuple, more.collect())) == sorted(map(tuple, plain.collect()))
    with pytest.raises(ValueError):
        K.pack_patches(df, ["a"], 3, w, crop, overlap)


def test_lines_on_irregular_axes(spark):
    rnd = np.random.default_rng(2)
    for values in (np.cumsum(rnd.random(30)), -np.cumsum(rnd.random(30)), rnd.integers(0, 6, 30).astype(float), np.array([5.0]), np.array([np.nan, 1.0, 3.0])):
        at = np.concatenate([rnd.uniform(np.nanmin(values) - 2, np.nanmax(values) + 2, 200), [2.0, np.nanmin(values), 2.5]])
        apart = np.where(np.isnan(values), np.inf, np.abs(values[None, :] - at[:, None]))
        assert R.on_axis(values, at).tolist() == apart.argmin(axis=1).tolist()
    lon, lat = [0.0, 1.0, 4.0, 4.5], [9.0, 7.0, 2.0]  # columns widen, rows go down
    grid = spark.createDataFrame([(r, c, lon[c] + r * 0.1, lat[r] - c * 0.1) for r in range(3) for c in range(4)], "row int, col int, lon double, lat double")
    v = spark.createDataFrame([(1, 0, 0.5, 8.0), (1, 1, 4.3, 1.0), (1, 2, None, 3.0)], "line int, ord int, x double, y double")
    assert [(r["x"], r["y"]) for r in R.nearest_on_axes(v, grid).orderBy("ord").collect()] == [(0, 0), (3, 2)]
    assert R.nearest_on_axes(v, grid.limit(0)).count() == 0


def greedy(rows, at):
    left, order = {i for i, *_ in rows}, []
    place = {i: (x, y) for i, x, y in rows}
    while True:
        order.append(at)
        left.discard(at)
        if not left:
            return order
        x, y = place[at]
        at = min(left, key=lambda i: ((place[i][0] - x) * (place[i][0] - x) + (place[i][1] - y) * (place[i][1] - y), i))


@pytest.mark.parametrize("kind", ["wide", "ties", "spot"])
def test_greedy_order(spark, kind):
    rnd = random.Random(kind)
    draw = {"wide": lambda: (rnd.uniform(-50, 50), rnd.gauss(0, 1)), "ties": lambda: (float(rnd.randrange(6)), float(rnd.randrange(5))), "spot": lambda: (1.0, 2.0)}[kind]
    rows = [(i * 2, *draw()) for i in range(250)]
    df = spark.createDataFrame([(1, *r) for r in rows], "line int, idx int, x double, y double")
    got = [r["idx"] for r in R.greedy_path_order(df).orderBy("ord").collect()]
    assert got == greedy(rows, min(rows, key=lambda r: (r[1], r[0]))[0])


def test_a_path_of_100000_points():
    rng = np.random.default_rng(1)
    x, y = np.sort(rng.uniform(0, 1000, 100_000)), rng.normal(size=100_000)
    began = time.time()
    free, at = R.Remaining(x, y), 0
    for _ in range(len(x)):
        free.take(at)
        at = free.nearest(at)
    assert at == -1 and time.time() - began < 60


def test_tiles_have_one_side():
    assert K.SIDE == T.SIDE
