"""Tiles, distances, merging, folding and quantiles against plain versions, with tiles, bands and brackets cut small."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracol.operators import aggregates as A
from terracol.operators import distance as E
from terracol.operators import joins as J
from terracol.operators import raster as R
from terracol.operators import tiles as T
from terracol.plans import pipeline as P


def at(df):
    got = [(r["row"], r["col"]) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def cells(spark, some):
    return spark.createDataFrame([tuple(x) for x in some], "row int, col int")


def scattered(seed, h, w, n):
    rnd = random.Random(seed)
    return {(rnd.randrange(h), rnd.randrange(w)) for _ in range(n)}


def grown(a, se, h, w):
    return {(r + i, c + j) for r, c in a for i, j in se if 0 <= r + i < h and 0 <= c + j < w}


def shrunk(a, se, h, w):
    return {(r, c) for r in range(h) for c in range(w) if all((r + i, c + j) in a for i, j in se)}


CORNER = [(0, 0), (0, 1), (0, 2), (2, -1), (-3, 1)]


@pytest.mark.parametrize("side", [8, 256])
@pytest.mark.parametrize("se", [R.disk(3), R.square(4), CORNER, [(0, 0)]])
def test_morphology(spark, monkeypatch, side, se):
    monkeypatch.setattr(T, "SIDE", side)
    h, w = 27, 35
    some = scattered(1, h, w, 380)
    df = cells(spark, [*some, *list(some)[:9]]).union(spark.createDataFrame([(None, 3)], "row int, col int"))
    want = {"dilation": grown(some, se, h, w), "erosion": shrunk(some, se, h, w), "opening": grown(shrunk(some, se, h, w), se, h, w), "closing": shrunk(grown(some, se, h, w), se, h, w)}
    for how, cells_ in want.items():
        assert at(R.morphology(df, se, how, h, w)) == cells_, how
    assert at(R.dilate(df, se)) == {(r + i, c + j) for r, c in some for i, j in se}
    assert R.morph_close(df.limit(0), se, h, w).count() == 0


@pytest.mark.parametrize("side", [8, 256])
def test_morphology_of_classes(spark, monkeypatch, side):
    monkeypatch.setattr(T, "SIDE", side)
    h, w, se = 21, 26, CORNER
    rnd = random.Random(2)
    label = {x: float(rnd.choice((1, 1, 2, 5))) for x in scattered(3, h, w, 420)}
    df = spark.createDataFrame([(*x, v) for x, v in label.items()] + [(0, 0, None), (1, 1, -3.0), (2, 2, float("nan"))], "row int, col int, value double").where("NOT (row = 2 AND col = 2 AND isnan(value))")
    forms = {"dilation": grown, "erosion": shrunk, "opening": lambda a, *x: grown(shrunk(a, *x), *x), "closing": lambda a, *x: shrunk(grown(a, *x), *x)}
    for how, form in forms.items():
        want = {}
        for k in sorted(set(label.values()), reverse=True):
            want |= {x: k for x in form({x for x, v in label.items() if v == k}, se, h, w)}
        got = {(r["row"], r["col"]): r["value"] for r in R.morph_multiclass(df, se, how, h, w).collect()}
        assert got == want, how


@pytest.mark.parametrize("side", [8, 64])
def test_stencils_across_tiles(spark, monkeypatch, side):
    monkeypatch.setattr(T, "SIDE", side)
    h, w = 19, 23
    rnd = np.random.default_rng(3)
    img = rnd.normal(size=(h, w))
    img[5, 7] = np.nan
    df = spark.createDataFrame([(r, c, float(img[r, c])) for r in range(h) for c in range(w)], "row int, col int, value double")
    box = sum(np.pad(img, 1, mode="symmetric")[i : i + h, j : j + w] for i in range(3) for j in range(3)) / 9
    got = {(r["row"], r["col"]): r["value"] for r in R.mean_filter(df, h, w).collect()}
    assert len(got) == h * w and all((got[r, c] is None) == np.isnan(box[r, c]) for r in range(h) for c in range(w))
    assert all(abs(got[r, c] - box[r, c]) < 1e-12 for r in range(h) for c in range(w) if got[r, c] is not None)
    full = np.where(np.isnan(img), np.nanmean(img), img)
    p = np.pad(full, 1, mode="symmetric")
    gx = sum(wt * p[1 + i : 1 + i + h, 1 + j : 1 + j + w] for (i, j), wt in R.SOBEL_X.items())
    assert all(abs(r["gx"] - gx[r["row"], r["col"]]) < 1e-12 for r in R.sobel(df, h, w).collect())
    g = R.gaussian_weights(1.0)
    p = np.pad(full, 2, mode="reflect")
    smooth = np.pad(sum(wt * p[2 + i : 2 + i + h, 2 + j : 2 + j + w] for (i, j), wt in g.items()), 1, mode="reflect")
    log = sum(wt * smooth[1 + i : 1 + i + h, 1 + j : 1 + j + w] for (i, j), wt in R.CROSS.items())
    whole = df.select("row", "col", F.when(F.isnan("value"), float(np.nanmean(img))).otherwise(F.col("value")).alias("value"))
    assert all(abs(r["value"] - log[r["row"], r["col"]]) < 1e-12 for r in R.laplacian_of_gaussian(whole, h, w).collect())


def test_large_elements_move_borders_only(spark):
    """What the tiles exchange follows their borders: disk(10) sends little more than disk(3), both far from a row a cell
    and offset."""
    some = cells(spark, [(r, c) for r in range(300) for c in range(300)])

    sent = lambda radius: T.spread(some, radius, T.SIDE, 300, 300).count()
    assert sent(3) < 1.05 * 90_000 and sent(10) < 1.15 * 90_000
    times = []
    for radius in (3, 3, 10):
        began = time.time()
        assert R.dilate(some, R.disk(radius), 300, 300).count() == 90_000
        times.append(time.time() - began)
    assert times[2] < 2 * times[1] + 1


def test_steep_cells_leave_the_mask_as_it_is(spark):
    h = w = 7
    flat = spark.createDataFrame([(r, c, 0.5, 0.5, 0.5) for r in range(h) for c in range(w)], "row int, col int, r double, g double, b double")
    one = spark.createDataFrame([(3, 3, 2.0)], "row int, col int, value double")
    assert [tuple(x) for x in R.grad_object_removal(flat, one, h, w, 0.1).collect()] == [(3, 3, 2.0)]
    edge = flat.withColumn("r", F.when(F.col("col") > 3, 5.0).otherwise(0.5))
    wide = spark.createDataFrame([(3, c, 2.0) for c in range(w)], "row int, col int, value double")
    gate = spark.createDataFrame([(3, 3, 9.0)], "row int, col int, value double")
    got = {r["col"]: r["value"] for r in R.grad_object_removal(edge, wide, h, w, 0.5, gate=gate).collect()}
    assert got == {c: None if c in (2, 3, 4) else 2.0 for c in range(w)}


# --- distances --------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("band,n", [(40, 25), (1 << 22, 25), (200, 1), (100, 500)])
def test_nearest_cells(spark, monkeypatch, band, n):
    monkeypatch.setattr(E, "BAND_CELLS", band)
    monkeypatch.setattr(E, "STRIP", 5 if band < 1000 else 1024)
    h, w = 23, 31
    sources = sorted(scattered(n, h, w, n))
    wanted = sorted(scattered(7, h, w, 200))
    out = E.nearest_cells(cells(spark, wanted + wanted[:3] + [(h, 0), (-1, 2)]), cells(spark, sources + sources[:2] + [(0, w)]), h, w)
    want = {}
    for r, c in wanted:
        d, *s = min(((r - a) ** 2 + (c - b) ** 2, a, b) for a, b in sources)
        want[r, c] = (*s, d)
    got = out.collect()
    assert {(r["row"], r["col"]): (r["near_row"], r["near_col"], r["d2"]) for r in got} == want and len(got) == len(want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning") == 3  # wanted and found cells by strip, sources by band
    assert E.nearest_cells(cells(spark, wanted), cells(spark, []), h, w).count() == 0


def test_distance_transform(spark):
    block = cells(spark, [(r, c) for r in range(1, 8) for c in range(1, 8)])
    got = {(r["row"], r["col"]): r["distance"] for r in E.distance_transform(block, 9, 9).collect()}
    assert got == {(r, c): float(min(r, c, 8 - r, 8 - c)) for r in range(1, 8) for c in range(1, 8)}
    assert E.distance_transform(cells(spark, [(0, 0)]), 1, 1).count() == 0


# --- merging ----------------------------------------------------------------------------------------------------
def merged(points, threshold, method):
    taken, out = set(), {}
    for i, x, y, _ in sorted(points):
        if i in taken:
            continue
        near = [p for p in sorted(points) if ((x - p[1]) ** 2 + (y - p[2]) ** 2) ** 0.5 < threshold]
        taken |= {p[0] for p in near}
        mid = near[(len(near) - 1) // 2]
        out[i] = {
            "mean_min": (sum(p[1] for p in near) / len(near), sum(p[2] for p in near) / len(near), min(p[3] for p in near)),
            "min_min": tuple(min(p[k] for p in near) for k in (1, 2, 3)),
            "first_location": near[0][1:],
            "middle_location": mid[1:],
        }[method]
    return out


POINTS = "idx long, lon double, lat double, pci double"


@pytest.mark.parametrize("tile", [5, 40, 100_000])
def test_merge_in_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(J, "TILE_POINTS", tile)
    rnd = random.Random(5)
    data = [(i * 3, round(rnd.uniform(-6, 6), 1), round(rnd.uniform(-6, 6), 1), float(rnd.randrange(100))) for i in range(220)]
    data += [(1000 + i, 0.45 * i - 9, 7.0, float(i % 7)) for i in range(45)] + [(2000 + i, -3.0, -8.0, float(i)) for i in range(30)]
    df = spark.createDataFrame(data, POINTS)
    for method in ("mean_min", "min_min", "first_location", "middle_location"):
        got = {r["idx"]: (r["lon"], r["lat"], r["pci"]) for r in J.merge_close_points(df, 0.5, method).collect()}
        assert got == {k: pytest.approx(v) for k, v in merged(data, 0.5, method).items()}, method
    assert J.merge_close_points(df.limit(0), 0.5).count() == 0


def test_merged_values_are_the_points_own(spark):
    pair = spark.createDataFrame([(0, 0.0, 0.0, 9.0), (1, 0.1, 0.0, 3.0), (2, 0.2, 0.0, 5.0)], POINTS)
    pick = lambda m: [tuple(r) for r in J.merge_close_points(pair, 1.0, m).collect()]
    assert pick("first_location") == [(0, 0.0, 0.0, 9.0)] and pick("middle_location") == [(0, 0.1, 0.0, 3.0)]


def test_long_chains_and_dense_spots(spark):
    chain = spark.range(10_000).select(F.col("id").alias("idx"), (F.col("id") * 0.5).alias("lon"), F.lit(0.0).alias("lat"), F.lit(1.0).alias("pci"))
    began = time.time()
    assert sorted(r["idx"] for r in J.merge_close_points(chain, 0.6).select("idx").collect()) == list(range(0, 10_000, 2))
    spot = spark.range(100_000).select(F.col("id").alias("idx"), F.lit(4.0).alias("lon"), F.lit(2.0).alias("lat"), (100_000 - F.col("id")).cast("double").alias("pci"))
    assert [tuple(r) for r in J.merge_close_points(spot, 0.6).collect()] == [(0, 4.0, 2.0, 1.0)]
    assert time.time() - began < 60


def test_a_chain_across_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(J, "TILE_POINTS", 20)
    chain = spark.range(400).select(F.col("id").alias("idx"), (F.col("id") * 0.5).alias("lon"), F.lit(0.0).alias("lat"), F.lit(1.0).alias("pci"))
    assert sorted(r["idx"] for r in J.merge_close_points(chain, 0.6).select("idx").collect()) == list(range(0, 400, 2))


def test_consecutive_pairs_of_sparse_ids(spark):
    rnd = random.Random(4)
    ids = sorted(rnd.randrange(10**15) for _ in range(300))
    rows = [(i, rnd.randrange(3)) for i in ids]
    df = spark.createDataFrame(rows, "idx long, seg_id int").repartition(5)
    pairs = J.consecutive_pairs(df)
    assert {(r["idx"], r["next_idx"], r["seg_id"]) for r in pairs.collect()} == {(a, b, s) for (a, s), (b, t) in zip(rows, rows[1:], strict=False) if s == t}
    assert "Window" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_values_of_given_points(spark):
    """Two points a column apart are merged for the mask only: each cell takes the value of its nearest given point."""
    grid = spark.createDataFrame([(r, c, c * 0.001, r * 0.001, [1.0]) for r in range(9) for c in range(9)], "row int, col int, lon double, lat double, bands array<double>")
    points = spark.createDataFrame([(0, 0.003, 0.004, 9.0, "a"), (1, 0.004, 0.004, 3.0, "a"), (2, 0.007, 0.007, 0.0, "a")], "idx long, lon double, lat double, pci double, seg_id string")
    scene = P.Scene(grid, grid.select("row", "col"), points, 9, 9)
    got = {(r["row"], r["col"]): r["value"] for r in P.pci_proximity(scene, merge=0.0015, near=0.0008).collect()}
    assert got[4, 3] == 9.0 and got[4, 4] == 3.0 and (7, 7) not in got


# --- frames -----------------------------------------------------------------------------------------------------
def test_fold_with_band_0_as_judge(spark):
    crop = 4
    big = [(2, 0, [5.0, 7.0]), (5, 0, [6.0, 0.0]), (1, 1, [0.0, 3.0]), (6, 1, [2.0, None]), (7, 2, [3.0, 1.0]), (8, 3, [4.0, 1.0]), (4, 0, [9.0, 9.0]), (5, 4, [8.0, 8.0]), (0, 2, [None, 4.0])]
    small = [(0, 0, [0.0, 3.0]), (1, 2, [2.0, float("nan")]), (2, 2, [0.0, None])]
    df = spark.createDataFrame([(1, *x) for x in big] + [(2, *x) for x in small], "region int, row int, col int, bands array<double>")
    sizes = spark.createDataFrame([(1, 9, 5), (2, 3, 3)], "region int, height int, width int")
    frames = R.fold_to_frame(df, sizes, crop)
    got = {(r["region"], r["r"], r["c"]): r["bands"] for r in frames.collect()}
    # (5, 0) is mirrored to (2, 0) with all its bands; (4, 0) meets the frame's end and goes; (5, 4) is past it by its row
    assert got == {(1, 2, 0): [6.0, 0.0], (1, 1, 1): [2.0, 0.0], (1, 0, 2): [3.0, 1.0], (1, 3, 3): [4.0, 1.0], (1, 2, 3): [8.0, 8.0], (2, 0, 0): [0.0, 3.0], (2, 1, 2): [2.0, 0.0]}
    labels = R.region_label_raster(frames, spark.createDataFrame([(1, 7.0), (2, 5.0)], "region int, label double"))
    assert {(r["region"], r["r"], r["c"]): r["label"] for r in labels.collect() if r["region"] == 2} == {(2, 0, 0): 0.0, (2, 1, 2): 5.0}


def test_unlabelled_segments_are_no_road(spark):
    px = spark.createDataFrame([(r, c, [1.0 + r, 2.0]) for r in range(4) for c in range(4)], "row int, col int, bands array<double>")
    seg = spark.createDataFrame([(0, 0, 7.0), (1, 1, 8.0), (2, 2, 0.0)], "row int, col int, value double")
    lut = spark.createDataFrame([("7", 2.9)], "seg_id string, pci double")
    got = {(r["r"], r["c"]): (r["bands"], r["labeled_bands"], r["label"]) for r in P.prepare_patches(px, seg, lut, 4, 4, 4, 0.0)["patches"].collect()}
    assert got[0, 0] == ([1.0, 2.0], [1.0, 2.0], 2) and got[1, 1] == ([0.0, 0.0], [0.0, 0.0], 0) and got[2, 2][2] == 0
    filled = {(r["r"], r["c"]): r["label"] for r in P.prepare_patches(px, seg, lut, 4, 4, 4, 0.0, fill=1)["patches"].collect()}
    assert filled[1, 1] == 1 and filled[0, 0] == 2


# --- quantiles --------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("rows,accuracy", [(1 << 20, 10_000), (1 << 20, 20), (60, 50), (5, 100)])
def test_quantiles_of_wide_and_infinite_values(spark, monkeypatch, rows, accuracy):
    monkeypatch.setattr(A, "SORTED_ROWS", rows)
    monkeypatch.setattr(A, "ACCURACY", accuracy)
    rnd = np.random.default_rng(5)
    inf = float("inf")
    bands = {0: np.append(rnd.normal(size=2000), 1e300), 1: np.concatenate([rnd.normal(size=500), [inf] * 200]), 2: np.array([-inf] * 60 + [1.0] * 3 + [inf] * 60), 3: np.array([-1e308, 1e308]), 4: np.array([inf]), 5: np.round(rnd.normal(size=900)), 6: np.concatenate([[-inf], rnd.normal(size=50)])}
    data = [(b, float(x)) for b, v in bands.items() for x in v] + [(0, float("nan")), (1, None)]
    probs = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = {r["band"]: r["q"] for r in A.exact_quantiles(spark.createDataFrame(data, "band int, value double").repartition(4), probs).collect()}

    def plain(v, p):
        v = sorted(v)
        h = p * (len(v) - 1)
        return A.between(v[int(h)], v[min(int(h) + 1, len(v) - 1)], h - int(h))

    for b, v in bands.items():
        assert got[b] == pytest.approx([plain(v, p) for p in probs], rel=1e-12), b
    assert A.between(-1e308, 1e308, 0.5) == 0.0 and A.between(1.0, inf, 0.5) == inf
