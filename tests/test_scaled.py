"""Operators with their squares, boxes, ranges and levels cut small, against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracol.functions.session import numbered
from terracol.operators import aggregates as A
from terracol.operators import graph as G
from terracol.operators import joins as J
from terracol.operators import nearest as N
from terracol.operators import raster as R
from terracol.plans import pipeline as P
from terracol.sources import tables as S


def some_cells(rnd, h, w, share):
    return sorted((r, c) for r in range(h) for c in range(w) if rnd.random() < share)


@pytest.mark.parametrize("tile,eight", [(4, True), (5, False), (64, True)])
def test_components(spark, monkeypatch, tile, eight):
    monkeypatch.setattr(G, "TILE", tile)
    cells = some_cells(random.Random(tile), 23, 19, 0.45) + [(30, c) for c in range(40)]
    near = G.EIGHT if eight else G.FOUR
    label, found = {}, set(cells)
    for cell in cells:
        if cell not in label:
            todo = [cell]
            label[cell] = n = len(set(label.values())) + 1
            while todo:
                r, c = todo.pop()
                for i, j in near:
                    if (r + i, c + j) in found and (r + i, c + j) not in label:
                        label[r + i, c + j] = n
                        todo.append((r + i, c + j))
    df = spark.createDataFrame(cells + cells[:5], "row int, col int")
    assert {(r["row"], r["col"]): r["component"] for r in G.connected_components(df, eight).collect()} == label
    twice = df.withColumn("g", F.lit("a")).unionAll(df.withColumn("g", F.lit("b")))
    assert {(r["g"], r["row"], r["col"]): r["component"] for r in G.connected_components(twice, eight, by="g").collect()} == {(g, *k): v for k, v in label.items() for g in "ab"}
    assert G.connected_components(df.limit(0), eight).count() == 0


def test_paths_in_boxes_and_together(spark, monkeypatch):
    monkeypatch.setattr(G, "TILE", 7)
    rnd = random.Random(5)
    cells = some_cells(rnd, 20, 20, 0.7)
    ends = [(i, *(rnd.randrange(20) for _ in range(4))) for i in range(30)]
    df, pairs = spark.createDataFrame(cells, "row int, col int"), spark.createDataFrame(ends, "pair_id long, r0 int, c0 int, r1 int, c1 int")
    inside = {tuple(r) for r in G.shortest_paths(df, pairs).collect()}
    assert inside == {tuple(r) for r in G.shortest_paths(df, pairs, box_cells=0).collect()}
    for i, r0, c0, r1, c1 in ends:
        box = {(r, c) for r, c in cells if min(r0, r1) <= r <= max(r0, r1) and min(c0, c1) <= c <= max(c0, c1)}
        steps = {(r0, c0): 0} if (r0, c0) in box else {}
        front = list(steps)
        while front:
            front = [(r + a, c + b) for r, c in front for a, b in G.EIGHT if (r + a, c + b) in box and steps.setdefault((r + a, c + b), steps[r, c] + 1) == steps[r, c] + 1]
            front = [x for x in dict.fromkeys(front)]
            if len(steps) == len(box) and all(steps[x] == max(steps.values()) for x in front):
                break
        mine = sorted(x[1:] for x in inside if x[0] == i)
        assert len(mine) == (steps[r1, c1] + 1 if (r1, c1) in steps else 1) and mine[-1][1:] == (r1, c1)


def test_long_paths_take_few_jobs(spark, monkeypatch):
    """A path of over 5,000 cells, and pairs that share a square: no rounds, and tiles sent once to each group."""
    monkeypatch.setattr(G, "PAIRS", 3)
    wall = [(r, c) for r in range(0, 101) for c in range(100) if r % 2 == 0 or c == (99 if r % 4 == 1 else 0)]
    df = spark.createDataFrame(wall, "row int, col int")
    ends = [(1, 0, 0, 100, 99), (2, 0, 0, 4, 99), (3, 2, 5, 0, 90), (4, 0, 0, 99, 99), (5, 7, 0, 7, 0), (6, -3, -2, 1, 99), (7, 300, 0, 700, 9), (8, 1, 99, 0, 0)]
    pairs = spark.createDataFrame(ends, "pair_id long, r0 int, c0 int, r1 int, c1 int")
    spark.sparkContext.setJobGroup("paths", "paths")
    got = {}
    for r in G.shortest_paths(df, pairs).collect():
        got.setdefault(r["pair_id"], []).append((r["step"], r["row"], r["col"]))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("paths"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 20 and len(got[1]) > 5000
    for i, r0, c0, r1, c1 in ends:
        a, c = min(r0, r1), min(c0, c1)
        mask = np.zeros((abs(r0 - r1) + 1, abs(c0 - c1) + 1), bool)
        for x, y in wall:
            if a <= x < a + mask.shape[0] and c <= y < c + mask.shape[1]:
                mask[x - a, y - c] = True
        assert sorted(got[i]) == [(k, x + a, y + c) for k, (x, y) in enumerate(G.box_path(mask, (r0 - a, c0 - c), (r1 - a, c1 - c)))], i


def test_nearest_of_far_rows_and_dense_spots(spark, monkeypatch):
    rnd = random.Random(3)
    right = [(i, round(rnd.gauss(x, 0.4), 2), round(rnd.gauss(y, 0.4), 2)) for i, (x, y) in enumerate([(0, 0), (30, 5), (-40, 90), (31, 5)] * 60)]
    left = [(i, rnd.uniform(-300, 300), rnd.uniform(-300, 300)) for i in range(60)] + [(100 + i, x, y) for i, x, y in right[:40]]
    a, b = spark.createDataFrame(left, "i int, lx double, ly double"), spark.createDataFrame(right, "j int, rx double, ry double")
    want = {i: min(right, key=lambda p: ((x - p[1]) * (x - p[1]) + (y - p[2]) * (y - p[2]), p[0]))[0] for i, x, y in left}
    for rows, asked in ((200_000, 20_000), (60, 7), (20, 1000), (1, 3)):
        monkeypatch.setattr(N, "PART_ROWS", rows)
        monkeypatch.setattr(N, "ASKED_ROWS", asked)
        assert {r["i"]: r["j"] for r in J.nearest(a, b, "i", ["j"]).collect()} == want
        assert J.nearest(a, b.limit(0), "i", ["j"]).count() == 0 and J.nearest(a.limit(0), b, "i", ["j"]).count() == 0
    odd = a.union(spark.createDataFrame([(900, None, 1.0), (901, 1.0, float("nan"))], a.schema))
    assert J.nearest(odd, b, "i", ["j"]).count() == len(left)
    with pytest.raises(TypeError):
        J.nearest(a, b.withColumn("j", F.col("j").cast("string")), "i", ["j"])


def test_nearest_shares_a_dense_spot(spark, monkeypatch):
    """90 % of both sides in one spot: parts hold equal counts, and no task answers over twice the median."""
    monkeypatch.setattr(N, "PART_ROWS", 500)
    monkeypatch.setattr(N, "ASKED_ROWS", 50)
    rnd = np.random.default_rng(4)
    spots = lambda n: [(i, float(x), float(y)) for i, (x, y) in enumerate(np.where(rnd.random((n, 1)) < 0.9, rnd.normal(5, 1e-4, (n, 2)), rnd.uniform(0, 1000, (n, 2))))]
    right, left = spots(2000), spots(1200)
    a, b = spark.createDataFrame(left, "i int, lx double, ly double"), spark.createDataFrame(right, "j int, rx double, ry double")
    seen = []
    answer = N._answer

    def spy(asked, dealt, rows, *rest):
        seen.append((rows, {r["_part"]: r["n"] for r in asked.groupBy("_part").agg(F.count("*").alias("n")).collect()}))
        return answer(asked, dealt, rows, *rest)

    monkeypatch.setattr(N, "_answer", spy)
    got = {r["i"]: (r["j"], r["d2"]) for r in J.nearest(a, b, "i", ["j"]).collect()}
    for i, x, y in left:
        assert got[i] == min(((j, (x - u) * (x - u) + (y - v) * (y - v)) for j, u, v in right), key=lambda t: (t[1], t[0]))
    rows, asks = seen[0]
    assert len(rows) == 4 and max(rows.values()) < 1.5 * np.median(list(rows.values()))
    share = [n / -(-n // max(50, 4 * rows[p])) for p, n in asks.items()]  # rows of left a task answers
    assert max(rows[p] + s for p, s in zip(asks, share, strict=True)) < 2 * np.median([rows[p] + s for p, s in zip(asks, share, strict=True)])


@pytest.mark.parametrize("rows,accuracy", [(1 << 20, 10_000), (3, 40), (1, 2000)])
def test_exact_quantiles(spark, monkeypatch, rows, accuracy):
    monkeypatch.setattr(A, "SORTED_ROWS", rows)
    monkeypatch.setattr(A, "ACCURACY", accuracy)
    rnd = np.random.default_rng(2)
    bands = {0: rnd.normal(size=200), 1: np.round(rnd.normal(size=77), 1), 2: np.full(9, 2.5), 3: np.array([1.0, 1e300]), 5: rnd.lognormal(0, 9, 50)}
    data = [(b, float(x)) for b, v in bands.items() for x in v] + [(0, None), (1, float("nan")), (7, None)]
    got = {r["band"]: r["q"] for r in A.exact_quantiles(spark.createDataFrame(data, "band int, value double"), [0.0, 0.25, 0.5, 0.95, 1.0]).collect()}
    assert set(got) == set(bands)
    for b, v in bands.items():
        assert np.allclose(got[b], np.quantile(v, [0.0, 0.25, 0.5, 0.95, 1.0]), rtol=1e-12)


@pytest.mark.parametrize("tile", [64, 256])
def test_offsets(spark, monkeypatch, tile):
    monkeypatch.setattr(R, "SIDE", tile)
    rnd = random.Random(6)
    a, b = some_cells(rnd, 70, 66, 0.3), some_cells(rnd, 70, 66, 0.3)
    got = {(r["dy"], r["dx"]): r["score"] for r in R.offset_scores(spark.createDataFrame(a + a[:3], "row int, col int"), spark.createDataFrame(b, "row int, col int"), 3).collect()}
    assert got == {(i, j): len(set(a) & {(r + i, c + j) for r, c in b}) for i in range(-3, 4) for j in range(-3, 4)}


def test_numbered(spark):
    rows = [(random.Random(1).randrange(3), i * 7 % 50) for i in range(50)]
    rows = [(i * 3 % 4, v) for i, (_, v) in enumerate(rows)]
    df = spark.createDataFrame(rows, "g int, v int").repartition(5)
    assert {r["v"]: r["number"] for r in numbered(df, "v").collect()} == {v: i + 1 for i, v in enumerate(range(50))}
    per = {g: sorted(v for h, v in rows if h == g) for g in range(4)}
    assert {(r["g"], r["v"]): r["k"] for r in numbered(df, "v", by=("g",), name="k").collect()} == {(g, v): i + 1 for g in per for i, v in enumerate(per[g])}
    assert numbered(df.limit(0), "v").count() == 0


def test_crop_by_offset(spark):
    full = spark.createDataFrame([(r, c) for r in range(6) for c in range(5)], "row int, col int")
    for dy, dx in ((2, -1), (-2, 1), (0, 0)):
        got = {tuple(r) for r in R.crop_by_offset(full, spark.createDataFrame([(dy, dx)], "dy int, dx int"), 6, 5).collect()}
        assert got == {(r, c) for r in range(6 - abs(dy)) for c in range(5 - abs(dx))}


def test_false_colours(spark):
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(300, 5)) @ rnd.normal(size=(5, 5))
    x[::50, 2] = np.nan
    df = spark.createDataFrame([(i // 20, i % 20, [None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(x)], "row int, col int, bands array<double>")
    z = np.nan_to_num(x)
    load = np.linalg.svd(z - z.mean(axis=0))[2][:3].T
    load = load * np.sign(load[np.abs(load).argmax(axis=0), range(3)])
    p = z @ load
    p = (p - p.min(axis=0)) / (p.max(axis=0) - p.min(axis=0))
    for r in A.false_color_pca(df).collect():
        i = r["row"] * 20 + r["col"]
        assert np.allclose([r["rgb"]["r"], r["rgb"]["g"], r["rgb"]["b"]], [p[i, 1], p[i, 0], p[i, 2]], atol=1e-8)


def scene(spark, h=40, w=36):
    rnd = random.Random(8)
    grid = [(r, c, -83 + c * 0.001, 42 + r * 0.001, [rnd.random() + 0.2, rnd.random() + 0.2, rnd.random() - 0.1]) for r in range(h) for c in range(w)]
    roads = [(r, c) for r in range(h) for c in range(w) if r % 6 < 3 or c % 7 < 3]
    points = [(i, -83 + (3 + i % 12) * 0.00251, 42 + (2 + i // 3) * 0.00149, float(i % 90 + 1), i // 8) for i in range(60)]
    pixels = spark.createDataFrame(grid, "row int, col int, lon double, lat double, bands array<double>")
    return P.Scene(pixels, spark.createDataFrame(roads, "row int, col int"), spark.createDataFrame(points, "idx long, lon double, lat double, pci double, seg_id long"), h, w), grid, roads, points


def test_segment_flow(spark):
    """Snapping, paths, burning and lookup against a plain walk over the points."""
    s, grid, roads, points = scene(spark)
    cells, lut = P.pci_segments(s)
    place = lambda p: min(grid, key=lambda g: ((p[1] - g[2]) ** 2 + (p[2] - g[3]) ** 2, g[0], g[1]))[:2]
    snap = lambda q: min(roads, key=lambda r: ((q[0] - r[0]) ** 2 + (q[1] - r[1]) ** 2, r))
    burnt, values = {}, {}
    for a, b in zip(points, points[1:], strict=False):
        if a[4] != b[4]:
            continue
        (r0, c0), (r1, c1) = snap(place(a)), snap(place(b))
        top, left = min(r0, r1), min(c0, c1)
        mask = np.zeros((abs(r0 - r1) + 1, abs(c0 - c1) + 1), bool)
        for r, c in roads:
            if top <= r < top + mask.shape[0] and left <= c < left + mask.shape[1]:
                mask[r - top, c - left] = True
        burnt |= {(r + top, c + left): a[4] for r, c in G.box_path(mask, (r0 - top, c0 - left), (r1 - top, c1 - left))}
        values[a[4]] = a[3]
    assert {(r["row"], r["col"]): r["seg_id"] for r in cells.collect()} == burnt
    assert {r["seg_id"]: r["pci"] for r in lut.collect()} == values


def test_flow_along_segments(spark, tmp_path):
    """The composed flow equals its operators one by one, and writes five tables of the same cells."""
    s, *_ = scene(spark)
    roi = (-82.9985, -82.9695, 42.0015, 42.0365)
    how = {"grow": 3, "gray_threshold": 2.0, "white": 2.0, "grad_threshold": 3.0, "shift": 2}
    out = P.pavement_pipeline(s, roi, crop=8, overlap=0.25, segments=True, p95=True, path=str(tmp_path / "o"), source=1, **how)
    rect = R.crop_rect(s.pixels, roi).first()
    h, w = rect["y1"] - rect["y0"], rect["x1"] - rect["x0"]
    cut = lambda df: df.where(F.col("row").between(rect["y0"], rect["y1"] - 1) & F.col("col").between(rect["x0"], rect["x1"] - 1)).withColumn("row", F.col("row") - rect["y0"]).withColumn("col", F.col("col") - rect["x0"])
    pixels, roads = A.normalize_bands_max(A.normalize_p95(cut(s.pixels))), cut(s.roads)
    cells, lut = P.pci_segments(P.Scene(pixels, roads, s.points, h, w))
    rgb = pixels.select("row", "col", *[F.get("bands", F.lit(i)).alias(n) for i, n in enumerate("rgb")])
    labels, move = P.enhance(cells.selectExpr("row", "col", "double(seg_id) AS value"), rgb, h, w, **how)
    dy, dx = move.select("dy", "dx").first()
    labels, pixels = R.crop_by_offset(labels, move, h, w), R.crop_by_offset(pixels, move, h, w)
    assert {tuple(r) for r in out["labels"].collect()} == {tuple(r) for r in labels.collect()} and not labels.isEmpty()
    want = P.prepare_patches(pixels.select("row", "col", "bands"), labels, lut, h - abs(dy), w - abs(dx), 8, 0.25)
    key = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    for name in ("regions", "region_frames", "region_labels", "patches"):
        assert key(out[name].collect()) == key(want[name].collect())
    read = {n: spark.read.parquet(str(tmp_path / "o" / n)).drop("data_source", "roi_key") for n in ("region_frames", "region_labels", "road_patches", "label_patches", "labeled_patches")}
    at = [sorted((r["patch_id"], r["r"], r["c"]) for r in read[n].collect()) for n in ("road_patches", "label_patches", "labeled_patches")]
    assert at[0] == at[1] == at[2] and at[0]
    assert read["region_labels"].join(read["region_frames"], ["region", "r", "c"], "left_anti").isEmpty()


def test_checks(spark):
    df = spark.createDataFrame([(0, 0, [1.0, 2.0], 5.0), (0, 1, [1.0], None), (1, 1, None, 11.0)], "row int, col int, bands array<double>, v double")
    got = {r["check"]: r["n"] for r in S.violations(df, required=("v",), ranges={"v": (None, 10)}, unique=("row",), types={"v": "double", "row": "string"}, lengths={"bands": 2}, shape=(2, 3)).collect()}
    assert got == {"required:v": 1, "range:v": 1, "unique:row": 1, "type:v": 0, "type:row": 1, "length:bands": 1, "shape:row": 0, "shape:col": 1}
    assert {r["check"]: r["n"] for r in S.misaligned(df, df.where("row = 0")).collect()} == {"alone:first": 1, "alone:second": 0}
    with pytest.raises(ValueError):
        S.violations(df, required=("none",))
