"""Golden fixtures and properties of the raster, join, score and graph operators."""

import json
import random

import pytest
from pyspark.sql import functions as F

from terracol.functions import columns as C
from terracol.operators import aggregates as A
from terracol.operators import graph as G
from terracol.operators import joins as J
from terracol.operators import raster as R
from terracol.sources import tables as S


def cells(spark, at):
    return spark.createDataFrame([tuple(x) for x in at], "row int, col int")


def at(df):
    return {(r["row"], r["col"]) for r in df.collect()}


def scores(spark, true, pred):
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(true, pred, strict=True)], "y_true double, y_pred double")


def test_merge_close_points(spark):
    data = [(1, 2, 20), (1.2, 2.2, 80), (2.2, 2.2, 25), (2.5, 2.5, 80), (3.5, 2.9, 50), (3.4, 2.8, 10), (5, 5, 80), (4.9, 5.1, 90), (6.1, 2.8, 90), (6.0, 2.9, 99)]
    p = spark.createDataFrame([(i, float(x), float(y), float(v)) for i, (x, y, v) in enumerate(data)], "idx long, lon double, lat double, pci double")
    got = {(round(r["lon"], 6), round(r["lat"], 6), r["pci"]) for r in J.merge_close_points(p, 0.8).collect()}
    assert got == {(1.1, 2.1, 20), (2.35, 2.35, 25), (3.45, 2.85, 10), (4.95, 5.05, 80), (6.05, 2.85, 90)}
    line = spark.createDataFrame([(0, 0.0, 0.0, 3.0), (1, 0.5, 0.0, 2.0), (2, 1.0, 0.0, 1.0)], p.schema)
    assert {(r["idx"], r["lon"], r["pci"]) for r in J.merge_close_points(line, 0.6).collect()} == {(0, 0.25, 2.0), (2, 0.75, 1.0)}
    first = {(r["idx"], r["lon"]) for r in J.merge_close_points(line, 0.6, "first_location").collect()}
    assert first == {(0, 0.0), (2, 0.5)}
    assert {r["lon"] for r in J.merge_close_points(line, 0.6, "middle_location").collect()} == {0.0, 0.5}


def test_scores(spark):
    c = A.classification_metrics(scores(spark, [0, 1, 2, 0, 1], [0, 1, 1, 0, 1])).first()
    assert [round(c[k], 6) for k in ("accuracy", "precision", "recall", "f1")] == [0.8, 0.666667, 0.8, 0.72]
    r = A.regression_metrics(scores(spark, [85, 70, 55, 40], [82, 68, 58, 42])).first()
    assert [round(r[k], 6) for k in ("mae", "mse", "rmse", "r2")] == [2.5, 6.5, 2.54951, 0.976889]
    five = scores(spark, [85, 70, 55, 40, 25], [82, 68, 58, 42, 28])
    assert A.pci_metrics(five).first()["within"] == 0.0 and A.pci_metrics(five, 5).first()["within"] == 1.0
    assert A.regression_metrics(scores(spark, [1, 1], [1, 1])).first()["r2"] == 1.0
    assert A.confusion_matrix(five).count() == 5  # the pairs that occur
    labels = spark.createDataFrame([(float(v),) for v in (85, 70, 55, 40, 25, 82, 68, 58, 42, 28)], "label double")
    every = A.confusion_matrix(five, labels).collect()
    assert len(every) == 100 and sum(r["n"] for r in every) == 5
    with pytest.raises(ValueError):
        A.confusion_matrix(five, spark.range(A.LABELS + 1).selectExpr("double(id) AS label"))


def test_spectral_stats(spark):
    r = A.spectral_stats(spark.createDataFrame([(0, i, [v]) for i, v in enumerate([1.0, 2.0, 4.0, 8.0])], "row int, col int, bands array<double>")).first()
    assert [round(r[k], 6) for k in ("mean", "median", "std", "sem", "margin", "iqr", "min", "max")] == [3.75, 3.0, 3.095696, 1.547848, 4.925943, 3.25, 1.0, 8.0]


def test_histogram_and_columns(spark):
    v = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 5, 6)], "value double")
    assert {(r["bin"], r["n"], r["area"]) for r in A.grouped_histogram(v).collect()} == {(2.0, 1, 16.0), (4.0, 2, 32.0), (6.0, 1, 16.0)}
    one = spark.range(1)
    y, u, w = C.rgb_to_yuv(F.lit(1.0), F.lit(1.0), F.lit(1.0))
    assert [round(x, 9) for x in one.select(y, u, w).first()] == [1.0, 0.00001, 0.0]
    p = spark.createDataFrame([(float(x),) for x in (29, 30, 70, 80, 86)], "x double")
    assert [[bool(t) for t in r] for r in p.select(*C.divide_ranges(F.col("x"))).collect()] == [[1, 0, 0], [0, 1, 0], [0, 1, 0], [0, 0, 0], [0, 0, 1]]
    with pytest.raises(ValueError):
        C.divide_ranges(F.col("x"), 1, 2)
    assert one.select(C.nan_nonpositive(F.lit(float("nan")))).first()[0] is None
    lat, lon = C.utm_to_wgs84_sql("500000D", "0D", "17")
    assert tuple(one.selectExpr(lat, lon).first()) == pytest.approx((0.0, -81.0), abs=1e-9)


def forward(lat, lon, lon0, lat0, k0, fe, fn, f):
    """Transverse Mercator by powers of the distance from the central meridian, with the meridian's arc integrated."""
    from math import cos, radians, sin, sqrt, tan

    a, e2 = 6378137.0, f * (2 - f)

    def arc(p, n=2000):
        h = p / n
        r = lambda t: a * (1 - e2) / (1 - e2 * sin(t) ** 2) ** 1.5
        return h / 3 * (r(0) + r(p) + sum((4 if i % 2 else 2) * r(i * h) for i in range(1, n)))

    p, d = radians(lat), radians(lon - lon0)
    n, t, c, s = a / sqrt(1 - e2 * sin(p) ** 2), tan(p) ** 2, e2 / (1 - e2) * cos(p) ** 2, e2 / (1 - e2)
    u = d * cos(p)
    x = n * (u + (1 - t + c) * u**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * s) * u**5 / 120 + (61 - 479 * t + 179 * t * t - t**3) * u**7 / 5040)
    y = arc(p) - arc(radians(lat0)) + n * tan(p) * (u**2 / 2 + (5 - t + 9 * c + 4 * c * c) * u**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * s) * u**6 / 720 + (1385 - 3111 * t + 543 * t * t - t**3) * u**8 / 40320)
    return fe + k0 * x, fn + k0 * y


def test_coordinates_come_back(spark):
    """UTM and ITM places made by forward formulas of their own return to where they came from."""
    places = [(lat, -81 + off) for lat in (0.5, 25.3, 42.3435, 60.1) for off in (-2.0, -0.7, 0.0, 1.4)]
    utm = spark.createDataFrame([(*p, *forward(*p, -81, 0, 0.9996, 500000, 0, 1 / 298.257223563)) for p in places], "lat0 double, lon0 double, e double, n double")
    for r in C.transform_crs(utm, "e", "n", "EPSG:32617", "EPSG:4326").collect():
        assert (r["y"], r["x"]) == pytest.approx((r["lat0"], r["lon0"]), abs=2e-8)
    south = C.transform_crs(utm.withColumn("n", F.lit(10000000.0) - F.col("n")), "e", "n", "EPSG:32717", "EPSG:4326")
    assert all(r["y"] == pytest.approx(-r["lat0"], abs=2e-8) for r in south.collect())

    def to_itm(lat, lon):
        import numpy as np

        e, g = 1 / 298.257223563 * (2 - 1 / 298.257223563), C.GRS80_F * (2 - C.GRS80_F)
        p, q = np.radians(lat), np.radians(lon)
        n = 6378137.0 / np.sqrt(1 - e * np.sin(p) ** 2)
        x = np.array([n * np.cos(p) * np.cos(q), n * np.cos(p) * np.sin(q), n * (1 - e) * np.sin(p)])
        a, b, c = np.radians(np.array([-0.33077, -1.85269, 1.66969]) / 3600)
        turn = (1 + 5.4248e-6) * np.array([[1, -c, b], [c, 1, -a], [-b, a, 1]])
        x = np.linalg.solve(turn, x - np.array([-24.0024, -17.1032, -17.8444]))
        flat, t = np.hypot(x[0], x[1]), np.arctan2(x[2], np.hypot(x[0], x[1]) * (1 - g))
        for _ in range(20):
            t = np.arctan2(x[2] + g * 6378137.0 / np.sqrt(1 - g * np.sin(t) ** 2) * np.sin(t), flat)
        return forward(np.degrees(t), np.degrees(np.arctan2(x[1], x[0])), C.ITM_LON0, C.ITM_LAT0, C.ITM_K0, C.ITM_FE, C.ITM_FN, C.GRS80_F)

    places = [(29.6, 34.95), (31.0, 34.5), (31.78, 35.2137), (32.0853, 34.7818), (33.1, 35.6)]
    itm = spark.createDataFrame([(*p, *map(float, to_itm(*p)), 1, "z") for p in places], "lat0 double, lon0 double, e double, n double, _p int, lat string")
    for r in C.itm_to_wgs84(itm.drop("lat"), "e", "n").collect():  # heights of some 20 m are taken as 0: below 1e-6 degrees
        assert (r["lat"], r["lon"]) == pytest.approx((r["lat0"], r["lon0"]), abs=1e-6) and r["_p"] == 1
    for r in C.transform_crs(utm, "lon0", "lat0", "EPSG:4326", "EPSG:32617", ("x", "y")).collect():
        assert (r["x"], r["y"]) == pytest.approx((r["e"], r["n"]), abs=2e-3)
    for r in C.transform_crs(itm, "lon0", "lat0", "EPSG:4326", "EPSG:2039").collect():
        assert (r["x"], r["y"]) == pytest.approx((r["e"], r["n"]), abs=0.02)
    there = C.transform_crs(itm.select("e", "n"), "e", "n", "EPSG:2039", "EPSG:32636", ("u", "v"))
    for r in C.transform_crs(there, "u", "v", "EPSG:32636", "EPSG:2039").collect():
        assert (r["x"], r["y"]) == pytest.approx((r["e"], r["n"]), abs=0.02)
    web = C.transform_crs(itm, "e", "n", "EPSG:2039", "EPSG:3857").collect()
    back = C.transform_crs(spark.createDataFrame([(r["x"], r["y"], r["lat0"]) for r in web], "x double, y double, lat0 double"), "x", "y", "EPSG:3857", "EPSG:4326")
    assert all(r["y"] == pytest.approx(r["lat0"], abs=1e-6) for r in back.collect())
    with pytest.raises(ValueError):
        C.transform_crs(itm, "e", "n", "EPSG:1", "EPSG:2")
    # away from the datum shift the projection alone: some 75 m at the grid's origin
    at = C.itm_to_wgs84(spark.createDataFrame([(219529.584, 626907.39)], "x double, y double"), "x", "y").first()
    assert 60 < 111_000 * ((at["lat"] - C.ITM_LAT0) ** 2 + (0.85 * (at["lon"] - C.ITM_LON0)) ** 2) ** 0.5 < 90


def test_crop_and_patches(spark):
    px = spark.createDataFrame([(r, c, float(c), float(r), float(r * 5 + c)) for r in range(5) for c in range(5)], "row int, col int, lon double, lat double, value double")
    assert at(R.roi_crop(px, (0.5, 3.5, 0.5, 3.5))) == {(0, 0), (0, 1), (1, 0), (1, 1)}
    assert len(R.patch_origins(10, 10, 4, 0.2)) == 9 and len(R.patch_origins(11, 11, 4, 0.2)) == 16
    for size in (10, 11):
        img = spark.createDataFrame([(r, c) for r in range(size) for c in range(size)], "row int, col int")
        got = {}
        for r in R.tile_patches(img, size, size, 4, 0.2).collect():
            got.setdefault(r["patch_id"], set()).add((r["row"] - r["r"], r["col"] - r["c"]))
        assert [got[i] for i in sorted(got)] == [{o} for o in R.patch_origins(size, size, 4, 0.2)]
    with pytest.raises(ValueError):
        R.patch_origins(10, 10, 4, 0.9)


def test_morphology(spark):
    one = cells(spark, [(6, 6)])
    assert [R.dilate(one, se, 20, 20).count() for se in (R.disk(1), R.square(3), R.square(10))] == [5, 9, 100]
    assert min(at(R.dilate(one, R.square(10), 20, 20))) == (1, 1)
    block = cells(spark, [(r, c) for r in range(3) for c in range(3)])
    assert at(R.erode(block, R.square(3), 9, 9)) == {(1, 1)}
    labels = spark.createDataFrame([(0, 0, 3.0), (0, 1, 5.0)], "row int, col int, value double")
    got = {(r["row"], r["col"]): r["value"] for r in R.morph_multiclass(labels, R.square(3), "dilation", 4, 4).collect()}
    assert got == {(r, c): 3.0 if c < 2 else 5.0 for r in (0, 1) for c in (0, 1, 2)}
    rnd = random.Random(1)
    some = cells(spark, {(rnd.randrange(8), rnd.randrange(8)) for _ in range(30)})
    opened = R.morph_open(some, R.square(3), 8, 8)
    assert at(R.erode(some, R.square(3), 8, 8)) <= at(some) <= at(R.dilate(some, R.square(3), 8, 8))
    assert at(R.morph_open(opened, R.square(3), 8, 8)) == at(opened)


def test_offset(spark):
    ideal, seen = cells(spark, [(2, 2), (2, 3)]), cells(spark, [(1, 1), (1, 2)])
    assert tuple(R.best_offset(ideal, seen, 2).first()) == (1, 1, 2)
    rnd = random.Random(2)
    a = {(rnd.randrange(40), rnd.randrange(40)) for _ in range(150)}
    moved = R.apply_offset(cells(spark, a), spark.createDataFrame([(4, -3)], "dy int, dx int"), 40, 40)
    assert tuple(R.best_offset(moved, cells(spark, a), 6).first())[:2] == (4, -3)


def test_components_and_paths(spark):
    c = cells(spark, [(0, 0), (1, 1), (3, 3)])
    assert len({r["component"] for r in G.connected_components(c, True).collect()}) == 2
    assert len({r["component"] for r in G.connected_components(c).collect()}) == 3
    full = cells(spark, [(r, k) for r in range(3) for k in range(3)] + [(9, 9)])
    pairs = spark.createDataFrame([(1, 0, 0, 2, 2), (2, 0, 0, 9, 9)], "pair_id long, r0 int, c0 int, r1 int, c1 int")
    got = {}
    for r in G.shortest_paths(full, pairs).collect():
        got.setdefault(r["pair_id"], []).append((r["step"], r["row"], r["col"]))
    assert sorted(got[1]) == [(0, 0, 0), (1, 1, 1), (2, 2, 2)] and got[2] == [(0, 9, 9)]
    snake = [(0, i) for i in range(30)] + [(1, 29)] + [(2, i) for i in range(30)] + [(3, 0)] + [(4, i) for i in range(30)]
    assert {r["component"] for r in G.connected_components(cells(spark, snake)).collect()} == {1}


def test_nearest_matches_brute_force(spark):
    rnd = random.Random(3)
    a = [(i, rnd.random() * 50, rnd.random() * 50) for i in range(60)]
    b = [(i, round(rnd.random() * 5, 1), round(rnd.random() * 5, 1)) for i in range(80)]
    left = spark.createDataFrame(a, "i int, lx double, ly double")
    right = spark.createDataFrame(b, "j int, rx double, ry double")
    got = {r["i"]: r["j"] for r in J.nearest(left, right, "i", ["j"]).collect()}
    assert got == {i: min(b, key=lambda p: ((x - p[1]) * (x - p[1]) + (y - p[2]) * (y - p[2]), p[0]))[0] for i, x, y in a}
    plan = J.within(left, right, 0.5)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_lines_and_paths(spark):
    v = spark.createDataFrame([(1, 0, 0, 0), (1, 1, 4, 2)], "line int, ord int, x int, y int")
    got = at(R.rasterize_line(R.polyline_edges(v)))
    assert len(got) == 5 and {(0, 0), (2, 4)} <= got
    path = R.resample_path(v, 5).orderBy("k").collect()
    assert [(r["x"], r["y"]) for r in path] == [(0.0, 0.0), (1.0, 0.5), (2.0, 1.0), (3.0, 1.5), (4.0, 2.0)]
    p = spark.createDataFrame([(1, 0, 5.0, 0.0), (1, 1, 0.0, 0.0), (1, 2, 2.0, 0.0)], "line int, idx int, x double, y double")
    assert [r["idx"] for r in R.greedy_path_order(p).orderBy("ord").collect()] == [1, 2, 0]


def test_road_pixels_match_brute_force(spark):
    rnd = random.Random(4)
    height, width, sx, sy = 12, 15, 0.5, 0.25
    px = [(r, c, -3.1 + c * sx, -1.2 + r * sy) for r in range(height) for c in range(width)]
    edges = [tuple(rnd.uniform(a, b) for a, b in ((-4, 5), (-2, 3), (-4, 5), (-2, 3))) for _ in range(4)]
    edges += [(-2.6, -1.0, -2.6, -0.3), (-1.3, -0.71, 3.0, -0.71), (0.6, 0.05, 0.6, 0.05), (-2.1, -0.7, -2.1, -0.45), (9.0, 9.0, 9.5, 9.5)]

    def meets(e, x, y, w, h):
        """Clip the edge to the box, one border at a time."""
        x0, y0, x1, y1 = e
        t0, t1 = 0.0, 1.0
        for p, q in ((x0 - x1, x0 - x), (x1 - x0, x + w - x0), (y0 - y1, y0 - y), (y1 - y0, y + h - y0)):
            if p == 0:
                if q < 0:
                    return False
            elif p < 0:
                t0 = max(t0, q / p)
            else:
                t1 = min(t1, q / p)
        return t0 <= t1

    pixels = spark.createDataFrame(px, "row int, col int, lon double, lat double")
    assert J.grid_steps(pixels) == pytest.approx((sx, sy)) and J.grid_steps(pixels.where("row = 99")) == (0.0, 0.0)
    for chosen in (edges, *[[e] for e in edges]):
        df = spark.createDataFrame([(1, *e) for e in chosen] + [(2, None, 0.0, 1.0, 1.0)], "line int, x0 double, y0 double, x1 double, y1 double")
        want = {(r, c) for r, c, x, y in px if r < height - 1 and c < width - 1 and any(meets(e, x, y, sx, sy) for e in chosen)}
        got = J.road_pixels(pixels, df, height, width, (sx, sy))
        assert at(got) == want and got.count() == len(want)
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert J.road_pixels(pixels.where("row < 1"), df, 1, width).count() == 0
    lines = spark.createDataFrame([(i, *e) for i, e in enumerate(edges)] + [(0, 0.0, 0.0, 0.1, 0.1)], "line int, x0 double, y0 double, x1 double, y1 double")
    near = [i for i, e in enumerate(edges) if i == 0 or meets(e, -0.05, -0.05, 1.0, 1.0)]
    assert sorted(r["line"] for r in J.roads_in_bbox(lines, (-0.05, 0.95, -0.05, 0.95)).collect()) == sorted(near + [0])


def test_sources(spark, tmp_path):
    f = tmp_path / "p.csv"
    f.write_text("X,Y,Cond,Seg_ID\n42.3,-83.0,55,a\n42.4,-83.1,60,b\n")
    r = S.scan_points(spark, str(f)).orderBy("lat").first()
    assert (r["lon"], r["lat"], r["pci"], r["seg_id"]) == (-83.0, 42.3, 55.0, "a")
    with pytest.raises(ValueError):
        S.normalise_points(spark.createDataFrame([(1,)], "x int"))
    g = tmp_path / "r.json"
    g.write_text(json.dumps({"features": [{"properties": {"seg_id": "7"}, "geometry": {"coordinates": [[1.0, 2.0], [3.0, 4.0]]}}]}))
    assert [tuple(x) for x in S.scan_roads_geojson(spark, str(g)).orderBy("ord").collect()] == [("7", 0, 1.0, 2.0), ("7", 1, 3.0, 4.0)]
    roads = spark.createDataFrame([("7", 1, 3.0, 4.0), ("7", 0, 1.0, 2.0), (None, 0, 5.0, 6.0)], "seg_id string, ord int, x double, y double")
    S.write_roads_geojson(roads, str(tmp_path / "roads"))
    assert {tuple(x) for x in S.scan_roads_geojson(spark, str(tmp_path / "roads"), multi_line=False).collect()} == {tuple(x) for x in roads.collect()}
    u = tmp_path / "l.json"
    u.write_text('{"7": 2.9, "8": 1.0}')
    assert S.scan_seg_lut(spark, str(u)).count() == 2
    path, built = str(tmp_path / "m"), []
    make = lambda: built.append(1) or cells(spark, [(1, 1), (5, 6)])
    roi = (0.0, 9.0, 0.0, 9.0)
    assert at(S.mask_cache_or_build(spark, path, roi, make)[0]) == {(1, 1), (5, 6)}
    assert S.mask_cache_or_build(spark, path, (-1.0, 9.0, 0.0, 9.0), make)[1] is False and built == [1]
    assert at(S.scan_mask_cropped(spark, path, (1, 5, 1, 6))) == {(0, 0)}
    S.write_patches({"labels": cells(spark, [(1, 1)])}, str(tmp_path / "out"), (-83.4, -83.1, 42.2, 42.6), 2)
    assert spark.read.parquet(str(tmp_path / "out" / "labels")).first()["roi_key"] == "-83_-83_42_43"
    assert S.read_regions(spark, str(tmp_path / "none")) is None
    a = spark.createDataFrame([(0, 0, [1.0])], "row int, col int, bands array<double>")
    with pytest.raises(ValueError):
        S.concat_band_sets(a, a.limit(0))


def test_queries_have_matching_names():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
