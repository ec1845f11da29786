"""One query for each operator over the given tables, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from terracol.functions import columns as C
from terracol.functions.session import materialised, shared_path
from terracol.operators import aggregates as A
from terracol.operators import distance as E
from terracol.operators import graph as G
from terracol.operators import joins as J
from terracol.operators import packed as K
from terracol.operators import raster as R
from terracol.plans import pipeline as P
from terracol.plans import tables as T
from terracol.sources import tables as S

QUERIES = {}
ORACLES = {}
FLAGSHIP = "a17_pci_metrics"
ROI = (-83.277, -83.25, 42.231, 42.27)
ROI_SQL = "lon > -83.277::DOUBLE AND lon < -83.25::DOUBLE AND lat > 42.231::DOUBLE AND lat < 42.27::DOUBLE"


def query(sql: str | None = None, *tables: str):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = T.with_sql(sql, *tables) if tables else sql
        return f

    return put


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def _long(df, digits=6):
    return A.long_bands(df, "row", "col").withColumn("value", F.round("value", digits))


def _rgb(s, d):
    p = T.bandpix(s, d)
    return p.select("row", "col", *[F.abs(F.get("bands", F.lit(i))).alias(n) for i, n in ((6, "r"), (3, "g"), (1, "b"))])


RGB_SQL = "(SELECT row, col, abs(bands[7]) AS r, abs(bands[4]) AS g, abs(bands[2]) AS b FROM bandpix)"


# --- sources ---------------------------------------------------------------------------------------------------
@query("SELECT idx, lon, lat, pci, seg_id::VARCHAR AS seg_id FROM points", "points")
def s1_scan_points(s, d):
    return S.normalise_points(T.points(s, d).select("idx", F.col("lat").alias("X"), F.col("lon").alias("Y"), F.col("pci").alias("COND"), F.col("seg_id").alias("Seg_ID")))


@query("SELECT line::VARCHAR AS seg_id, (row_number() OVER (PARTITION BY line ORDER BY ord) - 1)::INT AS ord, x::DOUBLE AS x, y::DOUBLE AS y FROM verts", "verts")
def s2_scan_roads_geojson(s, d):
    path = shared_path(s, "roads")
    S.write_roads_geojson(T.verts(s, d).withColumnRenamed("line", "seg_id"), path)
    return S.scan_roads_geojson(s, path, multi_line=False)


@query("SELECT 'k' AS seg_id, json_extract(props, '$.k')::DOUBLE AS pci FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def s3_scan_seg_lut(s, d):
    path = shared_path(s, "lut")  # one lookup file for each part of the events, a map in each line of it
    s.read.parquet(f"{d}/events.parquet").select("props").write.text(path)
    return S.scan_seg_lut(s, path, whole=False)


@query("SELECT row - 3 AS row, col - 10 AS col FROM road WHERE row >= 3 AND row < 90 AND col >= 10 AND col < 70", "road")
def s4_scan_mask_cropped(s, d):
    path = shared_path(s, "mask")
    S.write_mask(T.road(s, d), path, ROI, zone_bits=5)
    return S.scan_mask_cropped(s, path, (3, 90, 10, 70))


@query("SELECT row, col FROM road", "road")
def s5_write_mask(s, d):
    path = shared_path(s, "mask")
    S.write_mask(T.road(s, d), path, ROI)
    return S.scan_mask(s, path)


@query("SELECT row, col, false AS within FROM road", "road")
def s6_mask_cache_or_build(s, d):
    path = shared_path(s, "mask")
    S.mask_cache_or_build(s, path, ROI, lambda: T.road(s, d))
    wider = (ROI[0] - 1, *ROI[1:])
    cells, within = S.mask_cache_or_build(s, path, wider, lambda: T.gray(s, d))
    return cells.withColumn("within", F.lit(within))


@query("SELECT row, col, band, value FROM bandlong", "bandlong")
def s7_stack_bands(s, d):
    return A.long_bands(A.stack_bands(A.long_bands(T.bandpix(s, d), "row", "col")), "row", "col")


@query("SELECT row, col, (band + 64 * k)::INT AS band, CASE k WHEN 0 THEN value ELSE -value END AS value FROM bandlong, (VALUES (0), (1)) v(k)", "bandlong")
def s8_concat_band_sets(s, d):
    p = T.bandpix(s, d)
    return A.long_bands(S.concat_band_sets(p, p.select("row", "col", F.transform("bands", lambda x: -x).alias("bands"))), "row", "col")


@query("SELECT row, col, value, 2 AS data_source, '-83_-83_42_42' AS roi_key FROM classes", "classes")
def s9_write_patches(s, d):
    path = shared_path(s, "patches")
    S.write_patches({"labels": T.classes(s, d)}, path, ROI, 2)
    return s.read.parquet(f"{path}/labels")


@query("SELECT value, min(row) AS min_row, min(col) AS min_col, max(row) + 1 AS max_row, max(col) + 1 AS max_col FROM classes GROUP BY value", "classes")
def s10_read_regions(s, d):
    path = shared_path(s, "regions")
    A.bounding_boxes(T.classes(s, d)).write.parquet(path)
    return S.read_regions(s, path)


def _pixel_table(s, d):
    path = shared_path(s, "pixels")
    S.write_pixel_table(T.grid(s, d).withColumn("data_source", F.when(F.col("value") > 100000, 3).otherwise(2)), path, zone_bits=5)
    return path


@query("SELECT row, col, lon, lat, value, 3 AS data_source FROM grid WHERE value > 100000", "grid")
def s11_scan_pixel_table(s, d):
    return S.scan_pixel_table(s, _pixel_table(s, d), 3)


@query("SELECT row, col, lon, lat, value, 2 AS data_source FROM grid WHERE value <= 100000 AND row >= 5 AND row < 61 AND col >= 30 AND col < 40", "grid")
def s11_scan_pixel_region(s, d):
    return S.scan_pixel_table(s, _pixel_table(s, d), 2, (5, 61, 30, 40))


# --- columns ---------------------------------------------------------------------------------------------------
@query(f"SELECT row, col, value FROM grid WHERE {ROI_SQL}", "grid")
def p1_roi_filter_pixels(s, d):
    return T.grid(s, d).where(C.roi_contains(F.col("lon"), F.col("lat"), ROI)).select("row", "col", "value")


@query(f"SELECT (row - y0)::INT AS row, (col - x0)::INT AS col, value FROM grid, (SELECT min(row) y0, max(row) y1, min(col) x0, max(col) x1 FROM grid WHERE {ROI_SQL}) WHERE row >= y0 AND row < y1 AND col >= x0 AND col < x1", "grid")
def p2_roi_crop(s, d):
    return R.roi_crop(T.grid(s, d), ROI).select("row", "col", "value")


@query("SELECT min(lon) AS lon_min, max(lon) AS lon_max, min(lat) AS lat_min, max(lat) AS lat_max FROM grid", "grid")
def p3_default_roi(s, d):
    return R.default_roi(T.grid(s, d))


@query("SELECT idx, pci BETWEEN 10 AND 60 AND pci + 20 <= 70 AS inside FROM points", "points")
def p4_roi_within(s, d):
    p, k = F.col("pci"), lambda v: F.lit(float(v))
    return T.points(s, d).select("idx", C.roi_within([p, p + 20, p, p], [k(10), k(70), k(10), k(60)]).alias("inside"))


@query("SELECT idx, pci FROM points WHERE lon BETWEEN -83.277::DOUBLE AND -83.25::DOUBLE AND lat BETWEEN 42.231::DOUBLE AND 42.27::DOUBLE", "points")
def p5_points_in_roi(s, d):
    return T.points(s, d).where(C.roi_contains(F.col("lon"), F.col("lat"), ROI, inclusive=True)).select("idx", "pci")


@query("SELECT row, col, k::INT AS band, CASE label % 4 WHEN 2 THEN bands[4 + k] WHEN 3 THEN bands[1] ELSE bands[[7, 4, 2][k + 1]] END AS value FROM bandpix, range(3) t(k)", "bandpix")
def p6_rgb_select(s, d):
    p = T.bandpix(s, d)
    return A.long_bands(p.withColumn("bands", C.rgb_select(F.col("label") % 4, F.col("bands"))), "row", "col")


@query("SELECT row, col, band, CASE WHEN value > 0 THEN value END AS value FROM bandlong", "bandlong")
def p7_nan_nonpositive(s, d):
    return A.long_bands(T.bandpix(s, d), "row", "col").withColumn("value", C.nan_nonpositive(F.col("value")))


@query("SELECT coalesce(a.row, b.row) AS row, coalesce(a.col, b.col) AS col, coalesce(a.value, b.value) AS value FROM (SELECT * FROM classes WHERE value > 3) a FULL JOIN (SELECT row, col, value FROM grid WHERE value > 100000) b ON a.row = b.row AND a.col = b.col", "classes", "grid")
def p8_or_nan(s, d):
    return R.or_nan(T.classes(s, d).where("value > 3"), T.grid(s, d).where("value > 100000"))


@query(f"SELECT row, col FROM {RGB_SQL} WHERE abs(r - g) <= 0.1::DOUBLE AND abs(r - b) <= 0.1::DOUBLE AND abs(g - b) <= 0.1::DOUBLE AND (r + g + b) / 3 < 0.92::DOUBLE", "bandpix")
def p9_gray_mask(s, d):
    return _rgb(s, d).where(C.gray_mask(F.col("r"), F.col("g"), F.col("b"))).select("row", "col")


@query(f"SELECT row, col, round(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b, 6) AS y, round(-0.14713::DOUBLE * r - 0.28886::DOUBLE * g + 0.436::DOUBLE * b, 6) AS u, round(0.615::DOUBLE * r - 0.51499::DOUBLE * g - 0.10001::DOUBLE * b, 6) AS v FROM {RGB_SQL}", "bandpix")
def p10_rgb_to_yuv(s, d):
    y, u, v = C.rgb_to_yuv(F.col("r"), F.col("g"), F.col("b"))
    return _rgb(s, d).select("row", "col", F.round(y, 6).alias("y"), F.round(u, 6).alias("u"), F.round(v, 6).alias("v"))


@query("SELECT idx, CASE WHEN pci < 30 THEN 'below_30' WHEN pci <= 70 THEN 'between_30_and_70' ELSE 'above_70' END AS category FROM points", "points")
def p11_pci_category(s, d):
    return T.points(s, d).select("idx", C.pci_category(F.col("pci")).alias("category"))


@query("SELECT idx, pci < 30 AS below, pci BETWEEN 30 AND 70 AS between_1, pci > 85 AS above, pci < 20 AS a, pci BETWEEN 20 AND 40 AS b, pci > 50 AND pci <= 60 AS c, pci > 80 AS d FROM points", "points")
def p12_divide_ranges(s, d):
    four, six = C.divide_ranges(F.col("pci")), C.divide_ranges(F.col("pci"), 20, 20, 40, 50, 60, 80)
    return T.points(s, d).select("idx", *[c.alias(n) for c, n in zip([*four, *six], ["below", "between_1", "above", *"abcd"], strict=True)])


@query("SELECT idx, pci < 40 AS low, pci BETWEEN 40 AND 70 AS middle, pci > 85 AS high FROM points", "points")
def p13_severity_masks(s, d):
    return T.points(s, d).select("idx", *[c.alias(n) for c, n in zip(C.severity_masks(F.col("pci")), ("low", "middle", "high"), strict=True)])


@query("SELECT idx, ((pci >= 25)::INT + (pci >= 55)::INT + (pci >= 70)::INT + (pci >= 85)::INT) AS class FROM points", "points")
def p14_condition_class(s, d):
    return T.points(s, d).select("idx", C.condition_class(F.col("pci")).alias("class"))


@query("SELECT row, col, 300000.0::DOUBLE + 1.2::DOUBLE * (col + 0.5::DOUBLE) AS x, 4700000.0::DOUBLE - 1.2::DOUBLE * (row + 0.5::DOUBLE) AS y FROM grid", "grid")
def p15_affine_pixel_to_xy(s, d):
    x, y = C.affine_xy(F.col("row"), F.col("col"), 1.2, 0.0, 300000.0, 0.0, -1.2, 4700000.0)
    return T.grid(s, d).select("row", "col", x.alias("x"), y.alias("y"))


def redfearn(x: str, y: str, rows: str, *, lon0: str, lat0: str, k0: str, fe: str, fn: str, f: str, keep: str) -> str:
    """SQL of (keep, lat, lon in degrees) of transverse Mercator places, by the foot-point latitude and powers of the
    distance from the central meridian: another formulation than the library's."""
    unit = "a / (1 + e1) * (1 + e1**2 / 4 + e1**4 / 64)"
    arc = "a / (1 + e1) * ((1 + e1**2 / 4 + e1**4 / 64) * p0 - 3 * (e1 - e1**3 / 8) / 2 * sin(2 * p0) + 15 * (e1**2 - e1**4 / 4) / 16 * sin(4 * p0) - 35 * e1**3 / 48 * sin(6 * p0) + 315 * e1**4 / 512 * sin(8 * p0))"
    return f"""(WITH k0 AS (SELECT *, 6378137.0::DOUBLE AS a, ({f})::DOUBLE * (2 - ({f})::DOUBLE) AS e2, radians({lat0}::DOUBLE) AS p0 FROM {rows}),
 k1 AS (SELECT *, (1 - sqrt(1 - e2)) / (1 + sqrt(1 - e2)) AS e1 FROM k0),
 k2 AS (SELECT *, ({arc} + ({y} - {fn}::DOUBLE) / {k0}::DOUBLE) / ({unit}) AS mu FROM k1),
 k3 AS (SELECT *, mu + (3 * e1 / 2 - 27 * e1**3 / 32) * sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * sin(4 * mu) + 151 * e1**3 / 96 * sin(6 * mu) + 1097 * e1**4 / 512 * sin(8 * mu) AS p FROM k2),
 k4 AS (SELECT *, tan(p)**2 AS t, e2 / (1 - e2) * cos(p)**2 AS c, a / sqrt(1 - e2 * sin(p)**2) AS n, a * (1 - e2) / (1 - e2 * sin(p)**2)**1.5 AS r, e2 / (1 - e2) AS s FROM k3),
 k5 AS (SELECT *, ({x} - {fe}::DOUBLE) / (n * {k0}::DOUBLE) AS d FROM k4)
 SELECT {keep}, degrees(p - n * tan(p) / r * (d**2 / 2 - (5 + 3 * t + 10 * c - 4 * c**2 - 9 * s) * d**4 / 24 + (61 + 90 * t + 298 * c + 45 * t**2 - 252 * s - 3 * c**2) * d**6 / 720 - (1385 + 3633 * t + 4095 * t**2 + 1575 * t**3) * d**8 / 40320)) AS lat,
 {lon0}::DOUBLE + degrees((d - (1 + 2 * t + c) * d**3 / 6 + (5 - 2 * c + 28 * t - 3 * c**2 + 8 * s + 24 * t**2) * d**5 / 120 - (61 + 662 * t + 1320 * t**2 + 720 * t**3) * d**7 / 5040) / cos(p)) AS lon FROM k5)"""


_ON_GRID = "(SELECT row, col, 320000.0::DOUBLE + 5.3::DOUBLE * col AS x, 4690000.0::DOUBLE - 5.3::DOUBLE * row AS y FROM grid)"
_UTM17 = redfearn("x", "y", _ON_GRID, lon0="-81", lat0="0", k0="0.9996", fe="500000", fn="0", f="1 / 298.257223563", keep="row, col")


def _on_grid(s, d):
    return T.grid(s, d).select("row", "col", (F.lit(320000.0) + F.lit(5.3) * F.col("col")).alias("x"), (F.lit(4690000.0) - F.lit(5.3) * F.col("row")).alias("y"))


@query(f"SELECT row, col, round(lat, 6) AS lat, round(lon, 6) AS lon FROM {_UTM17}", "grid")
def p16_utm_to_wgs84(s, d):
    lat, lon = C.utm_to_wgs84_sql("x", "y", "17")
    return _on_grid(s, d).selectExpr("row", "col", f"round({lat}, 6) AS lat", f"round({lon}, 6) AS lon")


_SURVEYED = "(SELECT idx, 180000.0::DOUBLE + pci * 100 AS x, 600000.0::DOUBLE + pci * 300 + idx % 97 AS y FROM points)"
_ITM = redfearn("x", "y", _SURVEYED, lon0=repr(C.ITM_LON0), lat0=repr(C.ITM_LAT0), k0=repr(C.ITM_K0), fe=repr(C.ITM_FE), fn=repr(C.ITM_FN), f="1 / 298.257222101", keep="idx")
# the shift as a matrix on geocentric places; the latitude by fixed-point steps
_SHIFTED = f"""(WITH g0 AS (SELECT idx, radians(lat) AS p, radians(lon) AS q, 6378137.0::DOUBLE AS a, 1 / 298.257222101::DOUBLE * (2 - 1 / 298.257222101::DOUBLE) AS e2, 1 / 298.257223563::DOUBLE * (2 - 1 / 298.257223563::DOUBLE) AS w2 FROM {_ITM}),
 g1 AS (SELECT *, a / sqrt(1 - e2 * sin(p)**2) * cos(p) * cos(q) AS x, a / sqrt(1 - e2 * sin(p)**2) * cos(p) * sin(q) AS y, a / sqrt(1 - e2 * sin(p)**2) * (1 - e2) * sin(p) AS z, radians(-0.33077::DOUBLE / 3600) AS rx, radians(-1.85269::DOUBLE / 3600) AS ry, radians(1.66969::DOUBLE / 3600) AS rz, 1 + 5.4248::DOUBLE / 1000000 AS m FROM g0),
 g2 AS (SELECT *, -24.0024::DOUBLE + m * (x - rz * y + ry * z) AS u, -17.1032::DOUBLE + m * (rz * x + y - rx * z) AS v, -17.8444::DOUBLE + m * (rx * y - ry * x + z) AS w FROM g1),
 g3 AS (SELECT *, sqrt(u * u + v * v) AS o, atan2(w, sqrt(u * u + v * v) * (1 - w2)) AS f0 FROM g2),
 g4 AS (SELECT *, atan2(w + w2 * a / sqrt(1 - w2 * sin(f0)**2) * sin(f0), o) AS f1 FROM g3), g5 AS (SELECT *, atan2(w + w2 * a / sqrt(1 - w2 * sin(f1)**2) * sin(f1), o) AS f2 FROM g4),
 g6 AS (SELECT *, atan2(w + w2 * a / sqrt(1 - w2 * sin(f2)**2) * sin(f2), o) AS f3 FROM g5), g7 AS (SELECT *, atan2(w + w2 * a / sqrt(1 - w2 * sin(f3)**2) * sin(f3), o) AS f4 FROM g6)
 SELECT idx, degrees(f4) AS lat, degrees(atan2(v, u)) AS lon FROM g7)"""


@query(f"SELECT idx, round(lat, 5) AS lat, round(lon, 5) AS lon FROM {_SHIFTED}", "points")
def p17_itm_to_wgs84(s, d):
    p = T.points(s, d).select("idx", (F.lit(180000.0) + F.col("pci") * 100).alias("x"), (F.lit(600000.0) + F.col("pci") * 300 + F.col("idx") % 97).alias("y"))
    return rounded(C.itm_to_wgs84(p, "x", "y"), "lat", "lon", digits=5).select("idx", "lat", "lon")


@query("SELECT p.row, p.col, band, CASE WHEN g.row IS NOT NULL THEN p.value ELSE 0 END AS value FROM bandlong p LEFT JOIN (SELECT DISTINCT row, col FROM gray) g ON p.row = g.row AND p.col = g.col", "bandlong", "gray")
def p18_mask_apply(s, d):
    return A.long_bands(R.mask_apply(T.bandpix(s, d), T.gray(s, d)), "row", "col")


@query("SELECT row, col FROM classes WHERE value > 0", "classes")
def p19_binary_mask(s, d):
    return R.binary_mask(T.classes(s, d))


@query("SELECT row, col FROM (SELECT row, col, nullif(value, 3) AS value FROM classes) WHERE value IS NOT NULL AND value > 0", "classes")
def p20_labeled_mask(s, d):
    return R.labeled_mask(T.classes(s, d).withColumn("value", F.nullif("value", F.lit(3.0))))


@query("SELECT row, col, value FROM grid WHERE row BETWEEN 2 AND 18 AND col BETWEEN 42 AND 58", "grid")
def p21_centered_window(s, d):
    return R.centered_window(T.grid(s, d), 50, 10, 8).select("row", "col", "value")


@query("SELECT row, col FROM grid WHERE sqrt((row - 10) * (row - 10) + (col - 50) * (col - 50)) <= 9.5::DOUBLE", "grid")
def p22_circle_mask(s, d):
    return R.circle_mask(T.grid(s, d), 10, 50, 9.5)


@query("SELECT row, col, k::INT AS band, bands[[1, 6, 10][k + 1]] AS value FROM bandpix, range(3) t(k)", "bandpix")
def p23_bands_subset(s, d):
    return A.long_bands(T.bandpix(s, d).withColumn("bands", C.bands_subset(F.col("bands"), [0, 5, 9])), "row", "col")


@query("SELECT row, col, band, round(avg(value) OVER (PARTITION BY row, col ORDER BY band ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS value FROM bandlong", "bandlong")
def p24_spectral_smooth(s, d):
    return _long(T.bandpix(s, d).withColumn("bands", C.spectral_smooth(F.col("bands"))))


@query(f"SELECT row, col, round(6378137.0::DOUBLE * radians(lon), 1) AS x, round(6378137.0::DOUBLE * ln(tan(0.7853981633974483::DOUBLE + radians(lat) / 2)), 1) AS y, 'EPSG:4326' AS source FROM grid UNION ALL SELECT row, col, round(6378137.0::DOUBLE * radians(lon), 1), round(6378137.0::DOUBLE * ln(tan(0.7853981633974483::DOUBLE + radians(lat) / 2)), 1), 'EPSG:32617' FROM {_UTM17}", "grid")
def p25_transform_crs(s, d):
    both = [C.transform_crs(T.grid(s, d).select("row", "col", "lon", "lat"), "lon", "lat", "EPSG:4326", "EPSG:3857").withColumn("source", F.lit("EPSG:4326"))]
    both.append(C.transform_crs(_on_grid(s, d), "x", "y", "EPSG:32617", "EPSG:3857").withColumn("source", F.lit("EPSG:32617")))
    return rounded(both[0].select("row", "col", "x", "y", "source").unionByName(both[1]), "x", "y", digits=1)


# powers of the distance from the central meridian, and the meridian's arc by the third flattening
TO_UTM17 = """(WITH k0 AS (SELECT row, col, radians(lat) AS p, radians(lon + 81) AS q, 6378137.0::DOUBLE AS a, 1 / 298.257223563::DOUBLE * (2 - 1 / 298.257223563::DOUBLE) AS e2 FROM grid),
 k1 AS (SELECT *, tan(p)**2 AS t, e2 / (1 - e2) AS s, e2 / (1 - e2) * cos(p)**2 AS c, a / sqrt(1 - e2 * sin(p)**2) AS n, q * cos(p) AS u, (1 - sqrt(1 - e2)) / (1 + sqrt(1 - e2)) AS e1 FROM k0)
 SELECT row, col, 500000 + 0.9996::DOUBLE * n * (u + (1 - t + c) * u**3 / 6 + (5 - 18 * t + t**2 + 72 * c - 58 * s) * u**5 / 120 + (61 - 479 * t + 179 * t**2 - t**3) * u**7 / 5040) AS x,
 0.9996::DOUBLE * (a / (1 + e1) * ((1 + e1**2 / 4 + e1**4 / 64) * p - 3 * (e1 - e1**3 / 8) / 2 * sin(2 * p) + 15 * (e1**2 - e1**4 / 4) / 16 * sin(4 * p) - 35 * e1**3 / 48 * sin(6 * p) + 315 * e1**4 / 512 * sin(8 * p)) + n * tan(p) * (u**2 / 2 + (5 - t + 9 * c + 4 * c**2) * u**4 / 24 + (61 - 58 * t + t**2 + 600 * c - 330 * s) * u**6 / 720 + (1385 - 3111 * t + 543 * t**2 - t**3) * u**8 / 40320)) AS y FROM k1)"""


@query(f"SELECT row, col, round(x, 1) AS x, round(y, 1) AS y FROM {TO_UTM17}", "grid")
def p25_transform_to_utm(s, d):
    return rounded(C.transform_crs(T.grid(s, d).select("row", "col", "lon", "lat"), "lon", "lat", "EPSG:4326", "EPSG:32617").select("row", "col", "x", "y"), "x", "y", digits=1)


# --- joins -----------------------------------------------------------------------------------------------------
@query("SELECT c.c_custkey AS vertex, n.n_regionkey + 1 AS pci FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey")
def j1_roads_condition_join(s, d):
    v = T.verts(s, d).select(F.col("line").cast("string").alias("seg_id"), F.col("ord").alias("vertex"))
    return J.condition_join(v, T.lut(s, d)).select("vertex", "pci")


@query("SELECT row, col, coalesce((n_regionkey + 1)::INT, 0) AS label FROM (SELECT (o_orderkey // 100)::INT AS row, (o_orderkey % 100)::INT AS col, o_custkey % 40 AS seg_id FROM orders) LEFT JOIN nation ON seg_id = n_nationkey")
def j2_lut_label_join(s, d):
    o = s.read.parquet(f"{d}/orders.parquet").select(*T._cell("o_orderkey"), (F.col("o_custkey") % 40).cast("string").alias("seg_id"))
    return J.lookup_labels(o, T.lut(s, d)).select("row", "col", "label")


def _pixel_ends(s, d):
    return T.grid(s, d).select("row", "col", F.col("lon").alias("rx"), F.col("lat").alias("ry"))


def _point_ends(s, d, keep=("idx",)):
    return T.points(s, d).select(*keep, F.col("lon").alias("lx"), F.col("lat").alias("ly"))


@query("SELECT p.idx, b.row, b.col FROM points p, LATERAL (SELECT row, col FROM grid g ORDER BY (p.lon - g.lon) * (p.lon - g.lon) + (p.lat - g.lat) * (p.lat - g.lat), row, col LIMIT 1) b", "points", "grid")
def j3_nearest_pixel(s, d):
    return J.nearest(_point_ends(s, d), _pixel_ends(s, d), "idx", ["row", "col"]).select("idx", "row", "col")


def _nearest_cell(left: str, right: str, key: str = "p.row, p.col") -> str:
    return f"SELECT {key}, arg_min(q.row, ((p.row - q.row) * (p.row - q.row) + (p.col - q.col) * (p.col - q.col)) * 1000000::BIGINT * 1000 + q.row::BIGINT * 1000 + q.col) AS near_row, arg_min(q.col, ((p.row - q.row) * (p.row - q.row) + (p.col - q.col) * (p.col - q.col)) * 1000000::BIGINT * 1000 + q.row::BIGINT * 1000 + q.col) AS near_col FROM {left} p, {right} q WHERE abs(p.row - q.row) < 20 AND abs(p.col - q.col) < 20 GROUP BY ALL"


@query(_nearest_cell("grid", "road"), "grid", "road")
def j4_nearest_road_cell(s, d):
    return E.nearest_cells(T.grid(s, d), T.road(s, d), T.height(s, d), T.WIDTH).select("row", "col", "near_row", "near_col")


NEAREST_POINT = "SELECT g.row, g.col, {} AS {} FROM {} g, LATERAL (SELECT pci FROM points p ORDER BY (g.lon - p.lon) * (g.lon - p.lon) + (g.lat - p.lat) * (g.lat - p.lat), p.idx LIMIT 1) b"


@query(NEAREST_POINT.format("b.pci", "value", "(SELECT grid.* FROM grid JOIN road USING (row, col))"), "grid", "road", "points")
def j5_nearest_value_interp(s, d):
    g = T.grid(s, d).join(T.road(s, d), ["row", "col"]).select("row", "col", F.col("lon").alias("lx"), F.col("lat").alias("ly"), (F.col("row") * 100 + F.col("col")).alias("k"))
    p = T.points(s, d).select("idx", "pci", F.col("lon").alias("rx"), F.col("lat").alias("ry"))
    return J.nearest(g, p, "k", ["idx"]).select("row", "col", F.col("pci").alias("value"))


NEAR = "sqrt((g.lon - p.lon) * (g.lon - p.lon) + (g.lat - p.lat) * (g.lat - p.lat)) < 0.0005::DOUBLE"


@query(f"SELECT row, col FROM grid g WHERE EXISTS (SELECT 1 FROM points p WHERE {NEAR})", "grid", "points")
def j6_proximity_mask(s, d):
    g = T.grid(s, d).select("row", "col", F.col("lon").alias("lx"), F.col("lat").alias("ly"))
    p = T.points(s, d).select(F.col("lon").alias("rx"), F.col("lat").alias("ry"))
    return J.near_any(g, p, 0.0005).select("row", "col")


@query(NEAREST_POINT.format("CASE WHEN b.pci < 30 THEN 'below_30' WHEN b.pci <= 70 THEN 'between_30_and_70' ELSE 'above_70' END", "category", "grid"), "grid", "points")
def j7_nearest_category(s, d):
    g = T.grid(s, d).select("row", "col", F.col("lon").alias("lx"), F.col("lat").alias("ly"), (F.col("row") * 100 + F.col("col")).alias("k"))
    p = T.points(s, d).select("idx", "pci", F.col("lon").alias("rx"), F.col("lat").alias("ry"))
    return J.nearest(g, p, "k", ["idx"]).select("row", "col", C.pci_category(F.col("pci")).alias("category"))


LINE_SQL = "cells AS (SELECT DISTINCT (y0 + CASE WHEN n = 0 THEN 0 ELSE sign(y1 - y0) * ((2 * abs(y1 - y0) * t + n) // (2 * n)) END)::INT AS row, (x0 + CASE WHEN n = 0 THEN 0 ELSE sign(x1 - x0) * ((2 * abs(x1 - x0) * t + n) // (2 * n)) END)::INT AS col FROM (SELECT *, unnest(range(n + 1)) AS t FROM (SELECT *, greatest(abs(x1 - x0), abs(y1 - y0)) AS n FROM edges WHERE x1 IS NOT NULL)))"


@query(f", {LINE_SQL} SELECT row, col FROM cells".replace(", cells", "SELECT * FROM (WITH cells", 1) + ")", "edges")
def w9_rasterize_line(s, d):
    return R.rasterize_line(R.polyline_edges(T.verts(s, d))).select("row", "col").distinct()


ON_AXES = "snapped AS (SELECT line, ord, (SELECT arg_min(col, (abs(lon - x), col)) FROM grid WHERE row = 0) AS x, (SELECT arg_min(row, (abs(lat - y), row)) FROM grid WHERE col = 0) AS y FROM road_verts), snapped_edges AS (SELECT line, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM snapped WINDOW w AS (PARTITION BY line ORDER BY ord))"


@query(f"SELECT * FROM (WITH {ON_AXES}, {LINE_SQL.replace('FROM edges', 'FROM snapped_edges')} SELECT row, col FROM cells)", "road_verts", "grid")
def w9_rasterize_coordinates(s, d):
    v = R.nearest_on_axes(T.road_vertices(s, d), T.grid(s, d))
    return R.rasterize_line(R.polyline_edges(v)).select("row", "col").distinct()


@query(f"SELECT * FROM (WITH {LINE_SQL}, hits AS (SELECT c.row, c.col, v.ord, (c.row - v.y) * (c.row - v.y) + (c.col - v.x) * (c.col - v.x) AS d2 FROM cells c, verts v) SELECT row, col, CASE WHEN sqrt(min(d2)) <= 3.5::DOUBLE THEN arg_min(ord % 101, (d2, ord)) END AS value FROM hits GROUP BY ALL)", "verts", "edges")
def j8_line_pixel_values(s, d):
    cells = R.rasterize_line(R.polyline_edges(T.verts(s, d))).select("row", "col").distinct().select("row", "col", F.col("col").cast("double").alias("lx"), F.col("row").cast("double").alias("ly"))
    v = T.verts(s, d).select("ord", (F.col("ord") % 101).alias("value"), F.col("x").cast("double").alias("rx"), F.col("y").cast("double").alias("ry"))
    v = v.groupBy("rx", "ry").agg(F.min("ord").alias("ord"), F.min_by("value", "ord").alias("value"))  # of one place the first wins
    best = J.within(cells, v, 3.5, inclusive=True).groupBy("row", "col").agg(F.min_by("value", F.struct("d2", "ord")).alias("value"))
    return cells.select("row", "col").join(best, ["row", "col"], "left")


MEETS = "least(x0, x1) <= px + pw AND greatest(x0, x1) >= px AND least(y0, y1) <= py + ph AND greatest(y0, y1) >= py AND least({s}) <= 0 AND greatest({s}) >= 0"
MEETS = MEETS.format(s=", ".join(f"(x1 - x0) * ({v} - y0) - (y1 - y0) * ({u} - x0)" for u in ("px", "(px + pw)") for v in ("py", "(py + ph)")))


@query(f"SELECT row, col FROM (SELECT row, col, lon AS px, lat AS py, 0.0004::DOUBLE AS pw, 0.0004::DOUBLE AS ph FROM grid, size WHERE row < h - 1 AND col < w - 1) WHERE EXISTS (SELECT 1 FROM roads WHERE {MEETS})", "grid", "size", "roads")
def j9_road_pixel_intersect(s, d):
    return J.road_pixels(T.grid(s, d), R.polyline_edges(T.road_vertices(s, d)), T.height(s, d), T.WIDTH, (T.STEP, T.STEP))


BOX = (-83.2712, -83.2708, 42.2331, 42.2333)


@query(f"SELECT * FROM roads WHERE line IN (SELECT line FROM roads, (SELECT {BOX[0]}::DOUBLE AS px, {BOX[2]}::DOUBLE AS py, {BOX[1]}::DOUBLE - {BOX[0]}::DOUBLE AS pw, {BOX[3]}::DOUBLE - {BOX[2]}::DOUBLE AS ph) WHERE {MEETS})", "roads")
def j10_roads_in_bbox(s, d):
    return J.roads_in_bbox(R.polyline_edges(T.road_vertices(s, d)), BOX)


@query("SELECT r.row, r.col FROM road r JOIN gray g ON r.row = g.row AND r.col = g.col", "road", "gray")
def j11_mask_and(s, d):
    return R.mask_and(T.road(s, d), T.gray(s, d))


@query("SELECT row, col, max(value) AS value FROM (SELECT row, col, 1.0::DOUBLE AS value FROM road UNION ALL SELECT row, col, value FROM classes) GROUP BY ALL", "road", "classes")
def j12_mask_or_max(s, d):
    return R.mask_or_max(T.road(s, d).withColumn("value", F.lit(1.0)), T.classes(s, d))


@query("SELECT idx, next_idx, seg_id FROM (SELECT idx, seg_id % 3 AS seg_id, lead(idx) OVER (ORDER BY idx) AS next_idx, lead(seg_id % 3) OVER (ORDER BY idx) AS n FROM points) WHERE n = seg_id", "points")
def j13_consecutive_pairs(s, d):
    return J.consecutive_pairs(T.points(s, d).withColumn("seg_id", F.col("seg_id") % 3))


@query("SELECT a.idx AS i, b.idx AS j FROM points a, points b WHERE abs(a.lon - b.lon) < 0.0002::DOUBLE AND abs(a.lat - b.lat) < 0.0002::DOUBLE AND sqrt((a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat)) < 0.0002::DOUBLE", "points")
def j14_range_pairs(s, d):
    a = T.points(s, d).select(F.col("idx").alias("i"), F.col("lon").alias("lx"), F.col("lat").alias("ly"))
    b = T.points(s, d).select(F.col("idx").alias("j"), F.col("lon").alias("rx"), F.col("lat").alias("ry"))
    return J.range_pairs(a, b, 0.0002, "i", "j")


ROLES = [("train", -83.28, -83.26, 42.23, 42.26), ("test", -83.26, -83.24, 42.23, 42.26), ("all", -83.28, -83.24, 42.23, 42.25)]
ROLES_SQL = ", ".join(f"('{r}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {e}::DOUBLE)" for r, a, b, c, e in ROLES)


@query(f"SELECT idx, role FROM points JOIN (VALUES {ROLES_SQL}) r(role, a, b, c, e) ON lon >= a AND lon < b AND lat >= c AND lat < e", "points")
def j15_split_by_roi(s, d):
    return J.split_by_roi(T.points(s, d), ROLES).select("idx", "role")


# --- aggregates ------------------------------------------------------------------------------------------------
@query("SELECT row, col, band, round(CASE WHEN value / m > 0 THEN value / m END, 6) AS value FROM (SELECT *, max(value) OVER (PARTITION BY band) AS m FROM bandlong)", "bandlong")
def a1_normalize_bands_max(s, d):
    return _long(A.normalize_bands_max(T.bandpix(s, d)))


@query("SELECT row, col, round((value - a) / (b - a), 6) AS value FROM grid, (SELECT min(value) a, max(value) b FROM grid)", "grid")
def a2_normalize_minmax(s, d):
    return rounded(A.normalize_minmax(T.grid(s, d)).select("row", "col", "value"), "value")


@query("SELECT row, col, band, round(CASE WHEN value > 0 THEN value / m END, 6) AS value FROM bandlong JOIN (SELECT band, quantile_cont(value, 0.95) AS m FROM bandlong WHERE value > 0 GROUP BY band) USING (band)", "bandlong")
def a3_normalize_p95(s, d):
    return _long(A.normalize_p95(T.bandpix(s, d)))


@query("SELECT row, col, band, round((value - m) / sd, 6) AS value FROM bandlong JOIN (SELECT band, avg(value) AS m, stddev_pop(value) AS sd FROM bandlong GROUP BY band) USING (band)", "bandlong")
def a4_normalize_zscore(s, d):
    return _long(A.normalize_zscore(T.bandpix(s, d)))


@query("SELECT row, col, band, round((value - m) / iqr, 6) AS value FROM bandlong JOIN (SELECT band, median(value) AS m, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM bandlong GROUP BY band) USING (band)", "bandlong")
def a4_normalize_robust(s, d):
    return _long(A.normalize_robust(T.bandpix(s, d)))


# Student's t by Cornish and Fisher's expansion in 1 / (n - 1), exact to 1e-9 from some hundred values on
T_SQL = "(z + (z**3 + z) / (4 * v) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * v**2) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * v**3) + (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / (92160 * v**4))"


@query(f"SELECT band, n, mean, median, std, sem, round(raw * {T_SQL}, 6) AS margin, iqr, min, max FROM (SELECT band, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS std, round(stddev_samp(value) / sqrt(count(*)), 6) AS sem, stddev_samp(value) / sqrt(count(*)) AS raw, (count(*) - 1)::DOUBLE AS v, 1.959963984540054::DOUBLE AS z, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, min(value) AS min, max(value) AS max FROM bandlong GROUP BY band)", "bandlong")
def a5_spectral_stats(s, d):
    return rounded(A.spectral_stats(T.bandpix(s, d)), "mean", "median", "std", "sem", "margin", "iqr")


@query("SELECT p.row, p.col, band, value FROM bandlong p SEMI JOIN gray g ON p.row = g.row AND p.col = g.col", "bandlong", "gray")
def a6_mask_values_per_band(s, d):
    return A.mask_values_per_band(T.bandpix(s, d), T.gray(s, d))


@query("SELECT band, round(avg(value), 6) AS mean, round(median(value), 6) AS median FROM bandlong p SEMI JOIN gray g ON p.row = g.row AND p.col = g.col GROUP BY band", "bandlong", "gray")
def a6_mask_average_per_band(s, d):
    return rounded(A.mask_average_per_band(T.bandpix(s, d), T.gray(s, d)), "mean", "median")


@query("SELECT nullif(value, 3) AS value, count(*) AS n FROM classes GROUP BY 1", "classes")
def a7_value_histogram_nan(s, d):
    return A.value_histogram(T.classes(s, d).withColumn("value", F.nullif("value", F.lit(3.0))))


@query("SELECT round_even(pci / 2.0::DOUBLE, 0) * 2.0::DOUBLE AS bin, count(*) AS n, count(*) * 16.0::DOUBLE AS area FROM points WHERE pci > 1 GROUP BY 1", "points")
def a8_grouped_histogram(s, d):
    return A.grouped_histogram(T.points(s, d), "pci")


# leaders one after another: a point leads if no earlier neighbour does; each takes all points near it
LED = "near AS (SELECT a.idx AS i, a.lon AS x, a.lat AS y, b.idx AS j, b.lon, b.lat, b.pci FROM points a, points b WHERE abs(a.lon - b.lon) < 0.0005::DOUBLE AND abs(a.lat - b.lat) < 0.0005::DOUBLE AND sqrt((a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat)) < 0.0005::DOUBLE), earlier AS (SELECT i, list(j) FILTER (j < i) AS js FROM near GROUP BY i), turn AS (SELECT i, coalesce(js, []) AS js, row_number() OVER (ORDER BY i) AS k FROM earlier WHERE len(js) > 0), alone AS (SELECT i FROM earlier WHERE coalesce(len(js), 0) = 0), led(one, k, leaders) USING KEY (one) AS (SELECT 1, 0::BIGINT, (SELECT list(i) FROM alone) UNION SELECT 1, turn.k, CASE WHEN list_has_any(leaders, js) THEN leaders ELSE list_append(leaders, turn.i) END FROM led JOIN turn ON turn.k = led.k + 1), taken AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY j) AS k, count(*) OVER (PARTITION BY i) AS n FROM near WHERE i IN (SELECT unnest(leaders) FROM led))"
MEAN_MIN = LED + ", merged AS (SELECT i AS idx, any_value(x) + avg(lon - x) AS lon, any_value(y) + avg(lat - y) AS lat, min(pci) AS pci FROM taken GROUP BY i)"


@query(f"SELECT * FROM (WITH RECURSIVE {MEAN_MIN} SELECT idx, round(lon, 9) AS lon, round(lat, 9) AS lat, pci FROM merged)", "points")
def a9_merge_close_points(s, d):
    return rounded(J.merge_close_points(T.points(s, d), 50e-5), "lon", "lat", digits=9)


@query(f"SELECT * FROM (WITH RECURSIVE {LED} SELECT i AS idx, min(lon) AS lon, min(lat) AS lat, min(pci) AS pci FROM taken GROUP BY i)", "points")
def a9_min_min(s, d):
    return J.merge_close_points(T.points(s, d), 50e-5, "min_min")


@query(f"SELECT * FROM (WITH RECURSIVE {LED} SELECT i AS idx, lon, lat, pci FROM taken WHERE k = 1)", "points")
def a9_first_location(s, d):
    return J.merge_close_points(T.points(s, d), 50e-5, "first_location")


@query(f"SELECT * FROM (WITH RECURSIVE {LED} SELECT i AS idx, lon, lat, pci FROM taken WHERE k = (n - 1) // 2 + 1)", "points")
def a9_middle_location(s, d):
    return J.merge_close_points(T.points(s, d), 50e-5, "middle_location")


@query("SELECT band, least(floor((value - a) / (b - a) * 50), 49)::INT AS bin, count(*) AS n, round(count(*) / (any_value(c) * (any_value(b) - any_value(a)) / 50), 6) AS density FROM (SELECT *, min(value) OVER w AS a, max(value) OVER w AS b, count(*) OVER w AS c FROM bandlong WINDOW w AS (PARTITION BY band)) GROUP BY 1, 2", "bandlong")
def a10_density_histogram(s, d):
    return rounded(A.density_histogram(T.bandpix(s, d)), "density")


BOXES = "SELECT value, min(row) AS min_row, min(col) AS min_col, max(row) + 1 AS max_row, max(col) + 1 AS max_col FROM {} GROUP BY value"


@query(BOXES.format("classes"), "classes")
def a11_bounding_boxes(s, d):
    return A.bounding_boxes(T.classes(s, d))


@query("SELECT arg_min(value, (least(max_row - min_row, max_col - min_col), value)) AS value FROM (" + BOXES.format("(SELECT row, col, (row // 7 + col // 9)::DOUBLE AS value FROM road)") + ")", "road")
def a12_smallest_region(s, d):
    v = (F.floor(F.col("row") / 7) + F.floor(F.col("col") / 9)).cast("double")
    return A.smallest_region(A.bounding_boxes(T.road(s, d).withColumn("value", v)))


@query("SELECT DISTINCT value FROM classes WHERE value > 0", "classes")
def a13_distinct_classes(s, d):
    return A.distinct_classes(T.classes(s, d))


@query("SELECT count(*) AS before, count(*) FILTER (value > 2) AS after, round((count(*) - count(*) FILTER (value > 2)) * 100.0::DOUBLE / count(*), 6) AS removed_pct FROM classes", "classes")
def a14_mask_removed_pct(s, d):
    c = T.classes(s, d)
    return rounded(A.mask_removed_pct(c, c.where("value > 2")), "removed_pct")


PER_CLASS = "per AS (SELECT label, sum(s) AS support, sum(p) AS predicted, sum(tp) AS tp FROM (SELECT y_true AS label, 1 AS s, 0 AS p, (y_true = y_pred)::INT AS tp FROM scores UNION ALL SELECT y_pred, 0, 1, 0 FROM scores) GROUP BY label), pr AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r FROM per), f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM pr)"
CLASS_SCORES = "round(sum(tp) / sum(support), 6) AS accuracy, round(sum(p * support) / sum(support), 6) AS precision, round(sum(r * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1"
ERRORS = "round(avg(abs(y_true - y_pred)), 6) AS mae, round(avg((y_true - y_pred) * (y_true - y_pred)), 6) AS mse, round(sqrt(avg((y_true - y_pred) * (y_true - y_pred))), 6) AS rmse, round(1 - avg((y_true - y_pred) * (y_true - y_pred)) / var_pop(y_true), 6) AS r2"


@query(f"SELECT * FROM (WITH {PER_CLASS} SELECT {CLASS_SCORES} FROM f)", "scores")
def a15_classification_metrics(s, d):
    return rounded(A.classification_metrics(T.scores(s, d)), "accuracy", "precision", "recall", "f1")


@query(f"SELECT {ERRORS} FROM scores", "scores")
def a16_regression_metrics(s, d):
    return rounded(A.regression_metrics(T.scores(s, d)), "mae", "mse", "rmse", "r2")


@query(f"SELECT * FROM (WITH {PER_CLASS} SELECT {CLASS_SCORES} FROM f), (SELECT {ERRORS}, round(avg((abs(y_true - y_pred) <= 1)::INT), 6) AS within FROM scores)", "scores")
def a17_pci_metrics(s, d):
    return rounded(A.pci_metrics(T.scores(s, d)), "accuracy", "precision", "recall", "f1", "mae", "mse", "rmse", "r2", "within")


@query("SELECT a.v AS y_true, b.v AS y_pred, count(s.y_true) AS n FROM (SELECT range::DOUBLE AS v FROM range(5)) a CROSS JOIN (SELECT range::DOUBLE AS v FROM range(5)) b LEFT JOIN scores s ON s.y_true = a.v AND s.y_pred = b.v GROUP BY ALL", "scores")
def a18_confusion_matrix(s, d):
    return A.confusion_matrix(T.scores(s, d), s.range(5).select(F.col("id").cast("double").alias("label")))


@query(f"SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM (WITH {PER_CLASS} SELECT label::VARCHAR AS label, p, r, f1, support FROM f UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM f UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f1), sum(support) FROM f UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM f)", "scores")
def a19_classification_report(s, d):
    return rounded(A.classification_report(T.scores(s, d)), "precision", "recall", "f1")


@query(f"SELECT dataset_id, {ERRORS} FROM scores GROUP BY dataset_id", "scores")
def a20_batch_metrics(s, d):
    return rounded(A.regression_metrics(T.scores(s, d), "dataset_id"), "mae", "mse", "rmse", "r2")


BY_SET = PER_CLASS.replace("SELECT label, sum(s)", "SELECT dataset_id, label, sum(s)").replace("SELECT y_true AS label", "SELECT dataset_id, y_true AS label").replace("SELECT y_pred, 0", "SELECT dataset_id, y_pred, 0").replace("GROUP BY label", "GROUP BY dataset_id, label")


@query(f"SELECT * FROM (WITH {BY_SET} SELECT dataset_id, {CLASS_SCORES} FROM f GROUP BY dataset_id) JOIN (SELECT dataset_id, {ERRORS}, round(avg((abs(y_true - y_pred) <= 1)::INT), 6) AS within, count(*) AS n FROM scores GROUP BY dataset_id) USING (dataset_id)", "scores")
def a20_batch_pci_metrics(s, d):
    return rounded(A.batch_metrics(T.scores(s, d), "dataset_id"), "accuracy", "precision", "recall", "f1", "mae", "mse", "rmse", "r2", "within")


@query("SELECT max(row) + 1 AS height, max(col) + 1 AS width, count(*) AS pixels, min(len(bands)) AS min_bands, max(len(bands)) AS max_bands, any_value(nulls) AS nulls, any_value(nans) AS nans, any_value(infinities) AS infinities, any_value(low) AS low, any_value(high) AS high FROM bandpix, (SELECT count(*) FILTER (value IS NULL) AS nulls, count(*) FILTER (isnan(value)) AS nans, count(*) FILTER (isinf(value)) AS infinities, min(value) AS low, max(value) AS high FROM bandlong)", "bandpix", "bandlong")
def a21_data_quality(s, d):
    return A.data_quality(T.bandpix(s, d))


# --- neighbourhoods --------------------------------------------------------------------------------------------
SQUARE3 = "(SELECT i.range - 1 AS i, j.range - 1 AS j FROM range(3) i, range(3) j)"
DILATED = f"SELECT DISTINCT (row + i)::INT AS row, (col + j)::INT AS col FROM {{}}, {SQUARE3}, size WHERE row + i BETWEEN 0 AND h - 1 AND col + j BETWEEN 0 AND w - 1"
ERODED = f"SELECT (row + i)::INT AS row, (col + j)::INT AS col FROM {{}}, {SQUARE3}, size WHERE row + i BETWEEN 0 AND h - 1 AND col + j BETWEEN 0 AND w - 1 GROUP BY ALL HAVING count(*) = 9"


@query(DILATED.format("road"), "road", "size")
def w1_dilate(s, d):
    return R.dilate(T.road(s, d), R.square(3), T.height(s, d), T.WIDTH)


@query("SELECT row, col FROM (" + ERODED.format("(SELECT row, col FROM classes WHERE value > 0)") + ")", "classes", "size")
def w2_erode(s, d):
    return R.erode(T.classes(s, d).where("value > 0"), R.square(3), T.height(s, d), T.WIDTH)


@query(DILATED.format("(" + ERODED.format("(SELECT row, col FROM classes WHERE value > 0)") + ")"), "classes", "size")
def w3_morph_open(s, d):
    return R.morph_open(T.classes(s, d).where("value > 0"), R.square(3), T.height(s, d), T.WIDTH)


@query("SELECT row, col FROM (" + ERODED.format("(" + DILATED.format("road") + ")") + ")", "road", "size")
def w3_morph_close(s, d):
    return R.morph_close(T.road(s, d), R.square(3), T.height(s, d), T.WIDTH)


@query(f"SELECT (row + i)::INT AS row, (col + j)::INT AS col, min(value) AS value FROM classes, {SQUARE3}, size WHERE value > 0 AND row + i BETWEEN 0 AND h - 1 AND col + j BETWEEN 0 AND w - 1 GROUP BY 1, 2", "classes", "size")
def w4_morph_multiclass(s, d):
    return R.morph_multiclass(T.classes(s, d), R.square(3), "dilation", T.height(s, d), T.WIDTH)


MIRROR = "big AS (SELECT r2 AS row, c2 AS col, value FROM (SELECT *, unnest(list_filter(list_distinct([row, -row - {e}, 2 * h - 2 + {e} - row]), lambda v: v BETWEEN -{k} AND h - 1 + {k})) AS r2 FROM {t}, size) t, LATERAL (SELECT unnest(list_filter(list_distinct([t.col, -t.col - {e}, 2 * t.w - 2 + {e} - t.col]), lambda v: v BETWEEN -{k} AND t.w - 1 + {k})) AS c2))"


@query(f"SELECT * FROM (WITH {MIRROR.format(e=1, k=1, t='grid')} SELECT g.row, g.col, round(sum(b.value) / 9, 4) AS value FROM grid g JOIN big b ON b.row BETWEEN g.row - 1 AND g.row + 1 AND b.col BETWEEN g.col - 1 AND g.col + 1 GROUP BY ALL HAVING count(*) = 9)", "grid", "size")
def w5_mean_filter(s, d):
    return rounded(R.mean_filter(T.grid(s, d), T.height(s, d), T.WIDTH).where("value IS NOT NULL"), "value", digits=4)


HOLES = "holed AS (SELECT row, col, coalesce(v, avg(v) OVER ()) AS value FROM (SELECT row, col, CASE WHEN (row * 100 + col) % 11 <> 0 THEN value END AS v FROM grid))"


@query(f"SELECT row, col, round(gx, 2) AS gx, round(gy, 2) AS gy, round(sqrt(gx * gx + gy * gy), 2) AS magnitude FROM (WITH {HOLES}, {MIRROR.format(e=1, k=1, t='holed')} SELECT g.row, g.col, sum(b.value * (g.col - b.col) * CASE WHEN b.row = g.row THEN 2 ELSE 1 END) AS gx, sum(b.value * (g.row - b.row) * CASE WHEN b.col = g.col THEN 2 ELSE 1 END) AS gy FROM grid g JOIN big b ON b.row BETWEEN g.row - 1 AND g.row + 1 AND b.col BETWEEN g.col - 1 AND g.col + 1 GROUP BY ALL HAVING count(*) = 9)", "grid", "size")
def w6_sobel(s, d):
    holed = T.grid(s, d).withColumn("value", F.when((F.col("row") * 100 + F.col("col")) % 11 != 0, F.col("value")))  # nulls take the mean
    g = R.sobel(holed, T.height(s, d), T.WIDTH)
    return rounded(g.where("gx IS NOT NULL AND gy IS NOT NULL").select("row", "col", "gx", "gy", "magnitude"), "gx", "gy", "magnitude", digits=2)


SMOOTH = "smooth AS (SELECT g.row, g.col, sum(b.value * exp(-((g.row - b.row) * (g.row - b.row) + (g.col - b.col) * (g.col - b.col)) / 2.0::DOUBLE)) / (SELECT sum(exp(-((i.range - 2) * (i.range - 2) + (j.range - 2) * (j.range - 2)) / 2.0::DOUBLE)) FROM range(5) i, range(5) j) AS value FROM grid g JOIN big b ON b.row BETWEEN g.row - 2 AND g.row + 2 AND b.col BETWEEN g.col - 2 AND g.col + 2 GROUP BY ALL HAVING count(*) = 25)"
AGAIN = MIRROR.format(e=0, k=1, t="smooth").replace("big AS", "wide AS")


@query(f"SELECT * FROM (WITH {MIRROR.format(e=0, k=2, t='grid')}, {SMOOTH}, {AGAIN} SELECT g.row, g.col, round(sum(b.value * CASE WHEN b.row = g.row AND b.col = g.col THEN -4 ELSE 1 END), 4) AS value FROM smooth g JOIN wide b ON abs(b.row - g.row) + abs(b.col - g.col) <= 1 AND b.row BETWEEN g.row - 1 AND g.row + 1 AND b.col BETWEEN g.col - 1 AND g.col + 1 GROUP BY ALL HAVING count(*) = 5)", "grid", "size")
def w7_laplacian_of_gaussian(s, d):
    return rounded(R.laplacian_of_gaussian(T.grid(s, d), T.height(s, d), T.WIDTH, 1.0).where("value IS NOT NULL"), "value", digits=4)


BRIGHT = "bright AS (SELECT row, col, 0.299::DOUBLE * v + 0.587::DOUBLE * v + 0.114::DOUBLE * v AS value FROM (SELECT row, col, (value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) AS v FROM grid))"
NINE = "JOIN {} b ON b.row BETWEEN g.row - 1 AND g.row + 1 AND b.col BETWEEN g.col - 1 AND g.col + 1 GROUP BY ALL HAVING count(*) = 9"
MEAN = f"mean AS (SELECT g.row, g.col, sum(b.value) / 9 AS value FROM bright g {NINE.format('big')})"
STEEP = f"steep AS (SELECT g.row, g.col, sqrt(sum(b.value * (g.col - b.col) * CASE WHEN b.row = g.row THEN 2 ELSE 1 END) ** 2 + sum(b.value * (g.row - b.row) * CASE WHEN b.col = g.col THEN 2 ELSE 1 END) ** 2) AS magnitude FROM mean g {NINE.format('wide')})"
GROWN = f"SELECT (row + i)::INT AS row, (col + j)::INT AS col, min(value) AS value FROM classes, {SQUARE3}, size WHERE value > 0 AND row + i BETWEEN 0 AND h - 1 AND col + j BETWEEN 0 AND w - 1 GROUP BY 1, 2"


#: CTEs from the grid to ``steep``, the gradient of its smoothed brightness
SLOPE = f"{BRIGHT}, {MIRROR.format(e=1, k=1, t='bright')}, {MEAN}, {MIRROR.format(e=1, k=1, t='mean').replace('big AS', 'wide AS')}, {STEEP}"


# the mask's own cells, null where labels (here others than the mask) grown by a cell meet a steep one
@query(f"SELECT * FROM (WITH {SLOPE} SELECT m.row, m.col, CASE WHEN NOT (l.value IS NOT NULL AND magnitude > 1.5::DOUBLE) THEN m.value WHEN magnitude IS NULL THEN m.value END AS value FROM (SELECT row, col, value FROM classes WHERE value > 3) m LEFT JOIN ({GROWN.replace('value > 0', 'value = 2')}) l ON l.row = m.row AND l.col = m.col LEFT JOIN steep s ON m.row = s.row AND m.col = s.col)", "grid", "classes", "size")
def w8_grad_object_removal(s, d):
    v = A.normalize_minmax(T.grid(s, d)).select("row", "col", *[F.col("value").alias(c) for c in "rgb"])
    c = T.classes(s, d)
    return R.grad_object_removal(v, c.where("value > 3"), T.height(s, d), T.WIDTH, 1.5, gate=c.where("value = 2"))


@query("SELECT DISTINCT trunc(x0 + a.range * cos(t) - b.range * sin(t))::INT AS row, trunc(y0 + a.range * sin(t) + b.range * cos(t))::INT AS col FROM (SELECT *, atan2((y1 - y0)::DOUBLE, (x1 - x0)::DOUBLE) AS t FROM edges WHERE x1 IS NOT NULL), range(-10, 11) a, range(-2, 3) b, size WHERE trunc(x0 + a.range * cos(t) - b.range * sin(t)) BETWEEN 0 AND h - 1 AND trunc(y0 + a.range * sin(t) + b.range * cos(t)) BETWEEN 0 AND w - 1", "edges", "size")
def w10_grow_along_line(s, d):
    return R.grow_along_line(R.polyline_edges(T.verts(s, d)), T.height(s, d), T.WIDTH)


@query("SELECT (a.row - b.row)::INT AS dy, (a.col - b.col)::INT AS dx, count(*) AS score FROM road a, gray b WHERE abs(a.row - b.row) <= 5 AND abs(a.col - b.col) <= 5 GROUP BY 1, 2 ORDER BY score DESC, dy, dx LIMIT 1", "road", "gray")
def w11_best_offset(s, d):
    return R.best_offset(T.road(s, d), T.gray(s, d), 5)


@query("SELECT DISTINCT ((row + 3) % h)::INT AS row, ((col - 4 + w) % w)::INT AS col FROM road, size", "road", "size")
def w12_apply_offset(s, d):
    return R.apply_offset(T.road(s, d), s.createDataFrame([(3, -4)], "dy int, dx int"), T.height(s, d), T.WIDTH)


@query("SELECT row, col, round(sqrt((row - near_row) * (row - near_row) + (col - near_col) * (col - near_col)), 6) AS distance FROM (" + _nearest_cell("road", "(SELECT g.row, g.col FROM grid g ANTI JOIN road r ON g.row = r.row AND g.col = r.col)") + ")", "grid", "road")
def w13_edt(s, d):
    off = T.grid(s, d).join(T.road(s, d), ["row", "col"], "left_anti")
    return rounded(E.distance_transform(T.road(s, d), T.height(s, d), T.WIDTH, off), "distance")


def _patches(s, d):
    return R.tile_patches(T.grid(s, d).select("row", "col", "value"), T.height(s, d), T.WIDTH, 16, 0.2)


PATCHES = "origins AS (SELECT y * nx + x AS patch_id, y * 12 AS top, x * 12 AS lft FROM n, LATERAL (SELECT unnest(range(ny)) AS y), LATERAL (SELECT unnest(range(nx)) AS x) UNION ALL SELECT ny * nx + x, h - 16, x * 12 FROM n, LATERAL (SELECT unnest(range(nx)) AS x) WHERE ry UNION ALL SELECT ny * nx + CASE WHEN ry THEN nx ELSE 0 END + y, y * 12, w - 16 FROM n, LATERAL (SELECT unnest(range(ny)) AS y) WHERE rx UNION ALL SELECT ny * nx + nx + ny, h - 16, w - 16 FROM n WHERE rx AND ry)"
COUNTS = "n AS (SELECT *, (ny - 1) * 12 + 16 < h AS ry, (nx - 1) * 12 + 16 < w AS rx FROM (SELECT *, (h - 16) // 12 + 1 AS ny, (w - 16) // 12 + 1 AS nx FROM size))"


@query(f"SELECT * FROM (WITH {COUNTS}, {PATCHES} SELECT patch_id::INT AS patch_id, (row - top)::INT AS r, (col - lft)::INT AS c, value FROM origins JOIN grid ON row BETWEEN top AND top + 15 AND col BETWEEN lft AND lft + 15)", "size", "grid")
def w14_tile_patches(s, d):
    return _patches(s, d).select("patch_id", "r", "c", "value")


@query(f"SELECT * FROM (WITH {COUNTS}, {PATCHES} SELECT patch_id::INT AS patch_id, (row - top)::INT AS r, (col - lft)::INT AS c, value AS image, half, value > 90000 AS label FROM origins JOIN (SELECT *, value / 2 AS half FROM grid) ON row BETWEEN top AND top + 15 AND col BETWEEN lft AND lft + 15)", "size", "grid")
def w14_packed_patches(s, d):
    """Aligned stacks written as one row a patch, read back and unpacked."""
    path = shared_path(s, "packed")
    pixels = T.grid(s, d).withColumn("label", (F.col("value") > 90000).cast("double")).withColumn("half", F.col("value") / 2)
    K.pack_patches(pixels, ["value", "half", "label"], T.height(s, d), T.WIDTH, 16, 0.2).write.parquet(path)
    cells = K.unpack_patches(s.read.parquet(path), ["value", "half", "label"], 16)
    return cells.select("patch_id", "r", "c", F.col("value").alias("image"), "half", (F.col("label") > 0).alias("label"))


@query(f"SELECT * FROM (WITH {COUNTS}, {PATCHES} SELECT patch_id::INT AS patch_id, count(*) AS n FROM origins JOIN grid ON row BETWEEN top AND top + 15 AND col BETWEEN lft AND lft + 15 GROUP BY patch_id HAVING sum(CASE WHEN value > 90000 AND (row + col) % 16 = 3 THEN value - 90000 ELSE 0 END) > 0)", "size", "grid")
def w15_drop_empty_patches(s, d):
    p = _patches(s, d)
    label = F.when((F.col("value") > 90000) & ((F.col("row") + F.col("col")) % 16 == 3), F.col("value") - 90000).otherwise(0.0)
    return R.drop_empty_patches(p, p.withColumn("value", label)).groupBy("patch_id").agg(F.count("*").alias("n"))


# regions of x with height h and width w: small ones as they are, of the others what band 0 tells, folded at 12
FOLD = "f AS (SELECT region, CASE WHEN row >= 12 THEN 12 - (row % 12 + 1) ELSE row END AS r, CASE WHEN col >= 12 THEN 12 - (col % 12 + 1) ELSE col END AS c, (NOT (row < 12 AND col < 12)) AS late, row, col, b0, b1 FROM (SELECT * REPLACE (coalesce(b0, 0) AS b0, coalesce(b1, 0) AS b1) FROM x) WHERE CASE WHEN h < 12 AND w < 12 THEN b0 <> 0 OR b1 <> 0 ELSE b0 <> 0 AND ((row < 12 AND col < 12) OR row > 12 OR col > 12) END), folded AS (SELECT region, r::INT AS r, c::INT AS c, arg_max({'b0': b0, 'b1': b1}, (late::INT * 1000000 + row * 1000 + col)) AS b FROM f GROUP BY 1, 2, 3)"
# squares of 20 cells, every other one cut down to 9
SQUARES = "x AS (SELECT * FROM (SELECT row // 20 * 5 + col // 20 AS region, (row % 20)::INT AS row, (col % 20)::INT AS col, value AS b0, (value * 3 + row) % 4 AS b1, CASE WHEN (row // 20 * 5 + col // 20) % 2 = 0 THEN 20 ELSE 9 END AS h, CASE WHEN (row // 20 * 5 + col // 20) % 2 = 0 THEN 20 ELSE 9 END AS w FROM classes) WHERE row < h AND col < w)"


def _squares(s, d):
    region = (F.floor(F.col("row") / 20) * 5 + F.floor(F.col("col") / 20)).cast("int")
    side = F.when(F.col("region") % 2 == 0, 20).otherwise(9)
    x = T.classes(s, d).select(region.alias("region"), (F.col("row") % 20).alias("row"), (F.col("col") % 20).alias("col"), F.array("value", (F.col("value") * 3 + F.col("row")) % 4).alias("bands")).withColumn("height", side).withColumn("width", side)
    return x.where("row < height AND col < width").drop("height", "width"), x.select("region", "height", "width").distinct()


@query(f"SELECT * FROM (WITH {SQUARES}, {FOLD} SELECT region::INT AS region, r, c, b.b0 AS first, b.b1 AS second FROM folded)", "classes")
def w16_fold_mask_to_frame(s, d):
    return R.fold_to_frame(*_squares(s, d), 12).select("region", "r", "c", F.get("bands", F.lit(0)).alias("first"), F.get("bands", F.lit(1)).alias("second"))


@query(f"SELECT * FROM (WITH {SQUARES}, {FOLD} SELECT region::INT AS region, r, c, CASE WHEN b.b0 <> 0 THEN region * 1.5::DOUBLE ELSE 0 END AS label FROM folded)", "classes")
def w17_region_label_raster(s, d):
    cells, sizes = _squares(s, d)
    return R.region_label_raster(R.fold_to_frame(cells, sizes, 12), sizes.select("region", (F.col("region") * F.lit(1.5)).alias("label")))


# all lines advance together, a point a step: the nearest one not yet taken
GREEDY = "walk(line, ord, idx, x, y, taken) AS (SELECT line, 0, arg_min(idx, (x, idx)), arg_min(x, (x, idx)), arg_min(y, (x, idx)), [arg_min(idx, (x, idx))] FROM verts GROUP BY line UNION ALL SELECT line, ord + 1, best.idx, best.x, best.y, list_append(taken, best.idx) FROM (SELECT w.line, w.ord, w.taken, arg_min({'idx': v.idx, 'x': v.x, 'y': v.y}, ((v.x - w.x) * (v.x - w.x) + (v.y - w.y) * (v.y - w.y), v.idx)) AS best FROM walk w JOIN verts v ON v.line = w.line AND NOT list_contains(w.taken, v.idx) GROUP BY w.line, w.ord, w.taken))"


@query(f"SELECT * FROM (WITH RECURSIVE verts AS (SELECT line, ord AS idx, x, y FROM line_points), {GREEDY} SELECT line, idx, x, y, ord::INT AS ord FROM walk)", "line_points")
def w19_greedy_path_order(s, d):
    return R.greedy_path_order(T.verts(s, d).withColumnRenamed("ord", "idx"))


@query("SELECT line, k::INT AS k, round(x + (nx - x) * f, 6) AS x, round(y + (ny - y) * f, 6) AS y FROM (SELECT *, (k / 99.0::DOUBLE - u) / (v - u) AS f FROM (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(u) OVER w AS v FROM (SELECT *, reach / max(reach) OVER (PARTITION BY line) AS u FROM (SELECT *, sum(step) OVER (PARTITION BY line ORDER BY ord ROWS UNBOUNDED PRECEDING) AS reach FROM (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS step FROM verts WINDOW w AS (PARTITION BY line ORDER BY ord)))) WINDOW w AS (PARTITION BY line ORDER BY ord)), range(100) t(k) WHERE v > u AND k / 99.0::DOUBLE >= u AND (k / 99.0::DOUBLE < v OR (v >= 1 AND k = 99)))", "verts")
def w20_resample_path(s, d):
    return rounded(R.resample_path(T.verts(s, d)), "x", "y")


@query(f"SELECT * FROM (WITH {COUNTS}, {PATCHES} SELECT patch_id::INT AS patch_id, op, CASE op WHEN 'same' THEN r WHEN 'flip_rows' THEN 15 - r WHEN 'flip_cols' THEN r WHEN 'turn_90' THEN 15 - c WHEN 'turn_180' THEN 15 - r ELSE c END AS r, CASE op WHEN 'same' THEN c WHEN 'flip_rows' THEN c WHEN 'flip_cols' THEN 15 - c WHEN 'turn_90' THEN r WHEN 'turn_180' THEN 15 - c ELSE 15 - r END AS c, value FROM (SELECT patch_id, (row - top)::INT AS r, (col - lft)::INT AS c, value FROM origins JOIN grid ON row BETWEEN top AND top + 15 AND col BETWEEN lft AND lft + 15), (VALUES ('same'), ('flip_rows'), ('flip_cols'), ('turn_90'), ('turn_180'), ('turn_270')) o(op))", "size", "grid")
def w21_augment_patches(s, d):
    return R.augment_patches(_patches(s, d).select("patch_id", "r", "c", "value"), 16)


@query(ORACLES["w21_augment_patches"])
def w21_augment_packed(s, d):
    packed = K.pack_patches(T.grid(s, d), ["value"], T.height(s, d), T.WIDTH, 16, 0.2)
    return K.unpack_patches(K.augment_packed(packed, ["value"], 16), ["value"], 16).select("patch_id", "op", "r", "c", "value")


SUB = "('0x' || substr(md5(patch_id::VARCHAR || ':' || part::VARCHAR || ':42'), {at}, 8))::BIGINT % 7"


@query(f"SELECT * FROM (WITH {COUNTS}, {PATCHES}, p AS (SELECT patch_id::INT AS patch_id, part::INT AS part, (row - top)::INT - ({SUB.format(at=1)}) AS r, (col - lft)::INT - ({SUB.format(at=9)}) AS c, value FROM origins JOIN grid ON row BETWEEN top AND top + 15 AND col BETWEEN lft AND lft + 15, range(3) t(part)) SELECT patch_id, part, r::INT AS r, c::INT AS c, value FROM p WHERE r BETWEEN 0 AND 9 AND c BETWEEN 0 AND 9)", "size", "grid")
def w21_sub_crops(s, d):
    return R.sub_crops(_patches(s, d).select("patch_id", "r", "c", "value"), 16, 10, 3)


@query("SELECT vec_id, CASE WHEN ('0x' || substr(md5(vec_id::VARCHAR || ':42'), 1, 8))::BIGINT % 1000 < 200 THEN 'val' ELSE 'train' END AS role FROM embeddings")
def m2_train_val_split(s, d):
    return R.train_val_split(s.read.parquet(f"{d}/embeddings.parquet").select("vec_id"), 0.2, key="vec_id")


@query()
def m1_false_color_pca(s, d):
    return A.false_color_pca(T.bandpix(s, d)).select("row", "col", "rgb")


@query("SELECT a.band AS i, b.band AS j, count(*) AS n, round(avg(a.value), 9) AS mean_i, round(avg(b.value), 9) AS mean_j, round(covar_samp(a.value, b.value), 9) AS cov FROM bandlong a JOIN bandlong b ON a.row = b.row AND a.col = b.col GROUP BY ALL", "bandlong")
def m1_band_covariance(s, d):
    return rounded(A.band_covariance(T.bandpix(s, d)), "mean_i", "mean_j", "cov", digits=9)


# --- graphs ----------------------------------------------------------------------------------------------------
REACH = "SELECT row, col, dense_rank() OVER (ORDER BY v) AS component FROM (WITH RECURSIVE c AS (SELECT row, col, row * 100 + col AS k FROM {t}), e AS (SELECT a.k AS a, b.k AS b FROM c a JOIN c b ON {near} AND a.k <> b.k), low(k, v) USING KEY (k) AS (SELECT k, k AS v FROM c UNION SELECT * FROM (SELECT e.b AS k, min(l.v) AS v FROM low l JOIN e ON l.k = e.a JOIN recurring.low r ON r.k = e.b WHERE l.v < r.v GROUP BY e.b)) SELECT row, col, v FROM low JOIN c USING (k))"
EIGHT, FOUR = "abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1", "abs(a.row - b.row) + abs(a.col - b.col) = 1"


@query(REACH.format(t="road", near=EIGHT), "road")
def g1_connected_components(s, d):
    return G.connected_components(T.road(s, d), eight=True)


@query(REACH.format(t="gray", near=FOUR), "gray")
def g1_connected_components_4(s, d):
    return G.connected_components(T.gray(s, d))


def _pairs(s, d):
    p = J.consecutive_pairs(T.points(s, d).withColumn("seg_id", F.col("seg_id") % 5))
    h = T.height(s, d)
    at = lambda c, m, n: ((F.col(c) * m) % n).cast("int")
    q = p.select(F.col("idx").alias("pair_id"), at("idx", 37, h).alias("r0"), at("idx", 11, 100).alias("c0"))
    return q.withColumn("r1", F.least(F.col("r0") + (F.col("pair_id") % 6).cast("int"), F.lit(h - 1))).withColumn("c1", F.least(F.col("c0") + (F.col("pair_id") % 7).cast("int"), F.lit(99)))


FOLLOW = "(SELECT idx, seg_id % 5 AS seg_id, pci, lead(idx) OVER (ORDER BY idx) AS next_idx, lead(seg_id % 5) OVER (ORDER BY idx) AS next_seg FROM points)"
MADE_UP = f"pairs AS (SELECT *, least(r0 + pair_id % 6, h - 1)::INT AS r1, least(c0 + pair_id % 7, 99)::INT AS c1 FROM (SELECT idx AS pair_id, (idx * 37 % h)::INT AS r0, (idx * 11 % 100)::INT AS c0, h FROM {FOLLOW}, size WHERE next_seg = seg_id))"
STEPS = "moves AS (SELECT i.range - 1 AS i, j.range - 1 AS j FROM range(3) i, range(3) j WHERE i.range <> 1 OR j.range <> 1)"
# breadth-first steps of all pairs together, then back from the stop over the least cell of the step before
SEARCH = "reach(pair_id, row, col, step) USING KEY (pair_id, row, col) AS (SELECT pair_id, r0, c0, 0 FROM pairs JOIN mask ON row = r0 AND col = c0 UNION SELECT DISTINCT f.pair_id, m.row, m.col, f.step + 1 FROM reach f JOIN pairs p ON p.pair_id = f.pair_id, moves v JOIN mask m ON m.row = f.row + v.i AND m.col = f.col + v.j LEFT JOIN recurring.reach x ON x.pair_id = f.pair_id AND x.row = m.row AND x.col = m.col WHERE x.step IS NULL AND m.row BETWEEN least(r0, r1) AND greatest(r0, r1) AND m.col BETWEEN least(c0, c1) AND greatest(c0, c1)), path(pair_id, row, col, step) AS (SELECT pair_id, row, col, step FROM reach JOIN pairs USING (pair_id) WHERE row = r1 AND col = c1 UNION ALL SELECT b.pair_id, arg_min(r.row, r.row * 1000 + r.col), arg_min(r.col, r.row * 1000 + r.col), b.step - 1 FROM path b, moves v, reach r WHERE r.pair_id = b.pair_id AND r.row = b.row + v.i AND r.col = b.col + v.j AND r.step = b.step - 1 GROUP BY b.pair_id, b.step), paths AS (SELECT pair_id, step, row, col FROM path UNION ALL SELECT pair_id, 0, r1, c1 FROM pairs WHERE pair_id NOT IN (SELECT pair_id FROM path))"
MASK = "mask AS (SELECT row, col FROM classes WHERE value > 0)"


@query(f"SELECT * FROM (WITH RECURSIVE {MASK}, {MADE_UP}, {STEPS}, {SEARCH} SELECT pair_id, step::INT AS step, row::INT AS row, col::INT AS col FROM paths)", "points", "size", "classes")
def g2_shortest_paths_batch(s, d):
    return G.shortest_paths(T.classes(s, d).where("value > 0"), _pairs(s, d))


# the nearest pixel is one of the nine around the place; the nearest road cell one of those a few cells around the pixel
SNAP = "snapped AS (SELECT idx, row, col FROM (SELECT q.idx, m.row, m.col, row_number() OVER (PARTITION BY q.idx ORDER BY (q.row - m.row) * (q.row - m.row) + (q.col - m.col) * (q.col - m.col), m.row, m.col) AS k FROM (SELECT p.idx, g.row, g.col, row_number() OVER (PARTITION BY p.idx ORDER BY (p.lon - g.lon) * (p.lon - g.lon) + (p.lat - g.lat) * (p.lat - g.lat), g.row, g.col) AS n FROM (SELECT points.*, least(round((lat - 42.23::DOUBLE) / 0.0004::DOUBLE), h - 1)::INT + i.range - 1 AS r, least(round((lon + 83.28::DOUBLE) / 0.0004::DOUBLE), w - 1)::INT + j.range - 1 AS c FROM points, size, range(3) i, range(3) j) p JOIN grid g ON g.row = p.r AND g.col = p.c) q, range(-4, 5) i, range(-4, 5) j, mask m WHERE q.n = 1 AND m.row = q.row + i.range AND m.col = q.col + j.range) WHERE k = 1)"
SURVEY = f"pairs AS (SELECT f.idx AS pair_id, f.seg_id, f.pci, a.row AS r0, a.col AS c0, b.row AS r1, b.col AS c1 FROM {FOLLOW} f JOIN snapped a ON a.idx = f.idx JOIN snapped b ON b.idx = f.next_idx WHERE next_seg = f.seg_id)"
BURN = f"SELECT * FROM (WITH RECURSIVE {MASK}, {SNAP}, {SURVEY}, {STEPS}, {SEARCH}, burnt AS (SELECT row::INT AS row, col::INT AS col, arg_max(seg_id, pair_id) AS seg_id FROM paths JOIN pairs USING (pair_id) GROUP BY row, col), lut AS (SELECT seg_id, arg_max(pci, pair_id) AS pci FROM pairs GROUP BY seg_id) "


def _segment_scene(s, d) -> P.Scene:
    points = T.points(s, d).withColumn("seg_id", F.col("seg_id") % 5)
    return P.Scene(T.grid(s, d), T.classes(s, d).where("value > 0").select("row", "col"), points, T.height(s, d), T.WIDTH)


@query(BURN + "SELECT row, col, seg_id FROM burnt)", "points", "size", "classes", "grid")
def g3_segment_burn(s, d):
    scene = _segment_scene(s, d)
    p = materialised(P.segment_pairs(scene))
    return G.segment_burn(G.shortest_paths(scene.roads, G.last_of_routes(p)), p)[0]


@query(REACH.format(t="(SELECT row, col FROM classes WHERE value > 4)", near=FOUR).replace("SELECT row, col, dense_rank()", "SELECT row, col, value, component FROM (SELECT row, col, dense_rank()", 1) + ") JOIN grid USING (row, col)", "classes", "grid")
def g4_extract_instances(s, d):
    return G.extract_instances(T.classes(s, d).where("value > 4"), T.grid(s, d).select("row", "col", F.col("value").alias("image"))).withColumnRenamed("image", "value")


def _classed(s, d):
    """Classes 1 to 6 of the cells whose pixel is read; the others are holes."""
    pixels = T.grid(s, d).select("row", "col", F.array(F.when(F.col("row") % 5 != 0, F.col("value"))).alias("bands"))
    return G.process_labeled_image(T.classes(s, d), pixels, T.lut(s, d), 1, T.height(s, d), T.WIDTH)


GROWN_BOX = "SELECT value, greatest(min(row) - 1, 0)::INT AS min_row, greatest(min(col) - 1, 0)::INT AS min_col, least(max(row) + 1, any_value(h) - 1)::INT + 1 AS max_row, least(max(col) + 1, any_value(w) - 1)::INT + 1 AS max_col FROM classes, size WHERE value > 0 GROUP BY value"


@query(f"SELECT value::INT::VARCHAR AS region, value::INT::VARCHAR AS seg_id, (n_regionkey + 1)::DOUBLE AS label, min_row, min_col, max_row, max_col FROM ({GROWN_BOX}) LEFT JOIN nation ON n_nationkey = value WHERE value IN (SELECT c.value FROM classes c WHERE c.row % 5 <> 0)", "classes", "size")
def g5_process_labeled_image(s, d):
    return _classed(s, d)[0]


@query("SELECT c.value::INT::VARCHAR AS region, row, col, CASE WHEN row % 5 <> 0 THEN g.value END AS value FROM classes c JOIN grid g USING (row, col) WHERE c.value > 0", "classes", "grid")
def g5_region_pixels(s, d):
    return _classed(s, d)[1].select("region", "row", "col", F.get("bands", F.lit(0)).alias("value"))


# without a lookup: the areas of class 6 grown by one cell, each a region
SIX = "(SELECT DISTINCT row + i AS row, col + j AS col FROM (SELECT row, col FROM classes WHERE value = 6), size, (VALUES (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)) m(i, j) WHERE row + i BETWEEN 0 AND h - 1 AND col + j BETWEEN 0 AND w - 1)"


@query("SELECT '6-' || component AS region, 6.0::DOUBLE AS label, 'unknown' AS seg_id, min(row)::INT AS min_row, min(col)::INT AS min_col, max(row)::INT + 1 AS max_row, max(col)::INT + 1 AS max_col FROM (" + REACH.format(t=SIX, near=EIGHT) + ") GROUP BY component", "classes", "size")
def g5_unlabelled_regions(s, d):
    pixels = T.grid(s, d).select("row", "col", F.array("value").alias("bands"))
    return G.process_labeled_image(T.classes(s, d).where("value = 6"), pixels, None, 1, T.height(s, d), T.WIDTH)[0]


# --- compositions ----------------------------------------------------------------------------------------------
def _scene(s, d) -> P.Scene:
    pixels = T.grid(s, d).select("row", "col", "lon", "lat", F.array("value", F.col("value") / 2, F.col("value") / 3).alias("bands"))
    roads = J.road_pixels(pixels, R.polyline_edges(T.road_vertices(s, d)), T.height(s, d), T.WIDTH, (T.STEP, T.STEP))
    return P.Scene(pixels, materialised(roads), T.points(s, d), T.height(s, d), T.WIDTH)


NUMBERED = REACH.format(t="road", near=FOUR)
SLIDES = f"cells AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY row, col) - 1 AS i, count(*) OVER (PARTITION BY component) AS n FROM ({NUMBERED})), slid AS (SELECT component, t.w AS win, i - 2 * t.w AS i, row, col, lead(row) OVER p - row AS dr, lead(col) OVER p - col AS dc FROM cells, LATERAL (SELECT unnest(range(greatest(n - 4, 0))) AS w) t WHERE 2 * t.w < n - 4 AND i BETWEEN 2 * t.w AND 2 * t.w + 3 WINDOW p AS (PARTITION BY component, t.w ORDER BY i)), along AS (SELECT component, win, avg(dr) AS tr, avg(dc) AS tc FROM slid GROUP BY ALL), placed AS (SELECT component, win, s.i, k.range - 1 AS k, s.row AS r0, s.col AS c0, trunc(s.row + (k.range - 1) * (-tc / sqrt(tr * tr + tc * tc)))::INT AS row, trunc(s.col + (k.range - 1) * (tr / sqrt(tr * tr + tc * tc)))::INT AS col FROM slid s JOIN along USING (component, win), range(3) k WHERE tr <> 0 OR tc <> 0), whole AS (SELECT component, win, min(r0) FILTER (i = 2 AND k = 0) AS center_row, min(c0) FILTER (i = 2 AND k = 0) AS center_col FROM placed, size GROUP BY ALL HAVING bool_and(row BETWEEN 0 AND h - 1 AND col BETWEEN 0 AND w - 1))"


@query(f"SELECT * FROM (WITH {SLIDES} SELECT component, win::INT AS window, i::INT AS i, k::INT AS k, row, col, center_row, center_col, value FROM placed JOIN whole USING (component, win) LEFT JOIN grid USING (row, col))", "road", "grid", "size")
def w18_centerline_windows(s, d):
    return R.centerline_windows(T.road(s, d), T.grid(s, d).select("row", "col", "value"), 4, 0.5, 3, T.height(s, d), T.WIDTH)


def around(source: str) -> str:
    """CTEs from cells (row, col) of ``source`` to the closing of them with a disk of radius 3."""
    disk3 = "(SELECT i.range - 3 AS i, j.range - 3 AS j FROM range(7) i, range(7) j WHERE (i.range - 3) ** 2 + (j.range - 3) ** 2 <= 9)"
    return f"wide AS (SELECT DISTINCT row + i AS row, col + j AS col FROM {source}, {disk3}, size WHERE row + i BETWEEN 0 AND h - 1 AND col + j BETWEEN 0 AND w - 1), closed AS (SELECT (row + i)::INT AS row, (col + j)::INT AS col FROM wide, {disk3}, size WHERE row + i BETWEEN 0 AND h - 1 AND col + j BETWEEN 0 AND w - 1 GROUP BY ALL HAVING count(*) = 29)"


ON_ROADS = f"onroad AS (SELECT row, col, lon, lat FROM (SELECT row, col, lon, lat, lon AS px, lat AS py, 0.0004::DOUBLE AS pw, 0.0004::DOUBLE AS ph FROM grid, size WHERE row < h - 1 AND col < w - 1) WHERE EXISTS (SELECT 1 FROM roads WHERE {MEETS}))"
CLOSE = "close AS (SELECT row, col FROM {t} g WHERE EXISTS (SELECT 1 FROM merged p WHERE abs(g.lon - p.lon) < 0.0005::DOUBLE AND abs(g.lat - p.lat) < 0.0005::DOUBLE AND sqrt((g.lon - p.lon) * (g.lon - p.lon) + (g.lat - p.lat) * (g.lat - p.lat)) < 0.0005::DOUBLE))"
VALUED = "valued AS (SELECT g.row, g.col, arg_min(p.pci, ((g.lon - p.lon) * (g.lon - p.lon) + (g.lat - p.lat) * (g.lat - p.lat), p.idx)) AS value FROM {g} g JOIN closed c ON g.row = c.row AND g.col = c.col, points p WHERE abs(g.lon - p.lon) < 0.004::DOUBLE AND abs(g.lat - p.lat) < 0.004::DOUBLE GROUP BY g.row, g.col HAVING value <> 0)"


@query(f"SELECT * FROM (WITH RECURSIVE {MEAN_MIN}, {ON_ROADS}, {CLOSE.format(t='onroad')}, {around('close')}, {VALUED.format(g='grid')} SELECT row, col, value FROM valued)", "points", "grid", "size", "roads")
def c1_pci_proximity(s, d):
    return P.pci_proximity(_scene(s, d))


@query(BURN + "SELECT row, col, seg_id, pci FROM burnt JOIN lut USING (seg_id))", "points", "size", "classes", "grid")
def c2_pci_segments(s, d):
    cells, lut = P.pci_segments(_segment_scene(s, d))
    return cells.join(lut, "seg_id").select("row", "col", "seg_id", "pci")


SHADE = "shade AS (SELECT row, col FROM (SELECT row, col, (value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) AS v FROM grid) WHERE v < 0.6::DOUBLE)"
# the asphalt cells' best move onto the grown labels; a grown cell stays where it is asphalt and the labels, rolled by that
# move with its parts exchanged, cover it; steep cells near the labels go, then the border that the move leaves
MOVED = f"grown AS ({GROWN}), best AS (SELECT (a.row - b.row)::INT AS dy, (a.col - b.col)::INT AS dx FROM grown a JOIN shade b ON a.row BETWEEN b.row - 5 AND b.row + 5 AND a.col BETWEEN b.col - 5 AND b.col + 5 GROUP BY ALL ORDER BY count(*) DESC, dy, dx LIMIT 1), rolled AS (SELECT (row + dx + h) % h AS row, (col + dy + w) % w AS col FROM grown, best, size), kept AS (SELECT g.row, g.col, g.value FROM grown g SEMI JOIN (SELECT r.row, r.col FROM rolled r JOIN shade s ON s.row = r.row AND s.col = r.col) k ON k.row = g.row AND k.col = g.col)"
LEFT_OVER = "SELECT (m.row - greatest(0, -dy))::INT AS row, (m.col - greatest(0, -dx))::INT AS col, m.value FROM kept m LEFT JOIN grown n ON n.row = m.row AND n.col = m.col LEFT JOIN steep s ON m.row = s.row AND m.col = s.col, best, size WHERE NOT (n.value IS NOT NULL AND coalesce(magnitude, 0) > 1.5::DOUBLE) AND m.row >= greatest(0, -dy) AND m.row < h - greatest(0, dy) AND m.col >= greatest(0, -dx) AND m.col < w - greatest(0, dx)"
SPARSE = "classes AS (SELECT * REPLACE (CASE WHEN row % 9 < 4 AND col % 11 < 6 THEN value ELSE 0 END AS value) FROM classes_all)"


def _sparse(s, d):
    return T.classes(s, d).withColumn("value", F.when((F.col("row") % 9 < 4) & (F.col("col") % 11 < 6), F.col("value")).otherwise(0.0))


def _c3(s, d, compat):
    v = A.normalize_minmax(T.grid(s, d)).select("row", "col", *[F.col("value").alias(c) for c in "rgb"])
    labels, offset = P.enhance(_sparse(s, d), v, T.height(s, d), T.WIDTH, grow=3, gray_threshold=0.1, white=0.6, grad_threshold=1.5, shift=5, compat=compat)
    return R.crop_by_offset(labels, offset, T.height(s, d), T.WIDTH)


@query(f"SELECT * FROM (WITH classes_all AS (SELECT * FROM classes), {SPARSE.replace('classes AS', 'sparse AS', 1)}, {SLOPE}, {SHADE}, {MOVED.replace('FROM classes', 'FROM sparse')} {LEFT_OVER})", "grid", "classes", "size")
def c3_enhance(s, d):
    return _c3(s, d, True)


@query(f"SELECT * FROM (WITH classes_all AS (SELECT * FROM classes), {SPARSE.replace('classes AS', 'sparse AS', 1)}, {SLOPE}, {SHADE}, {MOVED.replace('FROM classes', 'FROM sparse').replace('(row + dx + h) % h AS row, (col + dy + w) % w AS col FROM grown', '(row + dy + h) % h AS row, (col + dx + w) % w AS col FROM shade').replace('JOIN shade s ON s.row = r.row AND s.col = r.col', '')} {LEFT_OVER})", "grid", "classes", "size")
def c3_enhance_moved(s, d):
    return _c3(s, d, False)


def _prepared(s, d):
    holed = F.when((F.col("row") + F.col("col")) % 4 != 0, F.col("value"))  # band 0 is unknown in places
    pixels = T.grid(s, d).select("row", "col", F.array(holed, F.col("value") / 2).alias("bands"))
    return P.prepare_patches(pixels, T.classes(s, d), T.lut(s, d).where("seg_id <> '4'"), T.height(s, d), T.WIDTH, 16, 0.2)


CUT = "SELECT * FROM (SELECT patch_id::INT AS patch_id, (row - top)::INT AS r, (col - lft)::INT AS c, band, second, label, sum(label) OVER (PARTITION BY patch_id) AS total FROM origins JOIN {t} ON row BETWEEN top AND top + 15 AND col BETWEEN lft AND lft + 15) WHERE total > 0"
HOLED = "CASE WHEN (g.row + g.col) % 4 <> 0 THEN g.value END"


# segment 4 is not in the lookup: no label, and no road in either stack
@query(f"SELECT patch_id, r, c, band, second, band AS labeled_band, label FROM (WITH {COUNTS}, {PATCHES}, known AS (SELECT row, col, CASE WHEN label > 0 THEN coalesce(b0, 0) ELSE 0 END AS band, CASE WHEN label > 0 THEN b1 ELSE 0 END AS second, label FROM (SELECT g.row, g.col, {HOLED} AS b0, g.value / 2 AS b1, CASE WHEN c.value > 0 AND c.value <> 4 THEN n_regionkey + 1 ELSE 0 END::INT AS label FROM grid g JOIN classes c USING (row, col) JOIN nation ON n_nationkey = c.value)) {CUT.format(t='known')})", "grid", "classes", "size")
def c4_prepare_patches(s, d):
    at = lambda c, i: F.get(c, F.lit(i))
    return _prepared(s, d)["patches"].select("patch_id", "r", "c", at("bands", 0).alias("band"), at("bands", 1).alias("second"), at("labeled_bands", 0).alias("labeled_band"), "label")


FRAMES = f"x AS (SELECT c.value::INT::VARCHAR AS region, c.row - min_row AS row, c.col - min_col AS col, {HOLED} AS b0, g.value / 2 AS b1, max_row - min_row AS h, max_col - min_col AS w FROM classes c JOIN ({GROWN_BOX}) b ON b.value = c.value JOIN grid g ON g.row = c.row AND g.col = c.col), {FOLD.replace('12', '16')}"


@query(f"SELECT * FROM (WITH {FRAMES} SELECT region, r, c, b.b0 AS first, b.b1 AS second, CASE WHEN b.b0 = 0 THEN 0 WHEN region <> '4' THEN (SELECT n_regionkey + 1 FROM nation WHERE n_nationkey::VARCHAR = region)::DOUBLE END AS label FROM folded)", "classes", "grid", "size")
def c4_region_frames(s, d):
    out = _prepared(s, d)
    at = lambda i: F.get("bands", F.lit(i))
    return out["region_frames"].join(out["region_labels"], ["region", "r", "c"]).select("region", "r", "c", at(0).alias("first"), at(1).alias("second"), "label")


IN_ROI = f"(SELECT min(row) y0, max(row) y1, min(col) x0, max(col) x1 FROM grid WHERE {ROI_SQL})"
INSIDE = "row >= y0 AND row < y1 AND col >= x0 AND col < x1"
PART = f"part AS (SELECT (row - y0)::INT AS row, (col - x0)::INT AS col, lon, lat, value FROM grid, {IN_ROI} WHERE {INSIDE}), partroad AS (SELECT (row - y0)::INT AS row, (col - x0)::INT AS col, lon, lat FROM onroad, {IN_ROI} WHERE {INSIDE}), partsize AS (SELECT max(row) + 1 AS h, max(col) + 1 AS w FROM part)"
SCALED = "known AS (SELECT p.row, p.col, CASE WHEN v.value > 0 THEN p.value / m END AS band, coalesce(v.value, 0)::INT AS label FROM (SELECT *, max(value) OVER () AS m FROM part) p LEFT JOIN valued v ON v.row = p.row AND v.col = p.col)"
FLOW = f"WITH RECURSIVE {MEAN_MIN}, {ON_ROADS}, {PART}, {CLOSE.format(t='partroad')}, {around('close').replace('size', 'partsize')}, {VALUED.format(g='part')}, {SCALED}, {COUNTS.replace('FROM size', 'FROM partsize')}, {PATCHES.replace('FROM size', 'FROM partsize')} " + CUT.format(t="known").replace("second, ", "")


@query(f"SELECT patch_id, r, c, round(coalesce(band, 0), 6) AS band, label FROM ({FLOW})", "points", "grid", "size", "roads")
def c5_pavement_pipeline(s, d):
    out = P.pavement_pipeline(_scene(s, d), ROI, crop=16, overlap=0.2)["patches"]
    return rounded(out.select("patch_id", "r", "c", F.get("bands", F.lit(0)).alias("band"), "label"), "band")


@query()
def c5_pavement_segments(s, d):
    """The flow along segments, with percentile scaling and enhancement: its five outputs written and read back (no SQL: see
    the tests)."""
    scene, path = _segment_scene(s, d), shared_path(s, "prepared")
    bands = F.array("value", F.col("value") / 2, F.col("value") / 3)
    scene = P.Scene(scene.pixels.select("row", "col", "lon", "lat", bands.alias("bands")), scene.roads, scene.points, scene.height, scene.width)
    P.pavement_pipeline(scene, ROI, crop=16, overlap=0.2, segments=True, p95=True, path=path, source=2, grow=3, gray_threshold=0.4, white=2.0, grad_threshold=1.5, shift=5)
    names = ("region_frames", "region_labels", "road_patches", "label_patches", "labeled_patches")
    parts = []
    for name in names:
        t = s.read.parquet(f"{path}/{name}")
        key = F.col("region" if "region" in t.columns else "patch_id").cast("string").alias("key")
        values = F.col("bands") if "bands" in t.columns else F.array(F.col("label").cast("double"))
        parts.append(t.select(F.lit(name).alias("output"), key, "r", "c", F.transform(values, lambda x: F.round(x, 6)).alias("numbers")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


# --- checks ----------------------------------------------------------------------------------------------------
@query("SELECT unnest(['range:pci', 'range:lat', 'range:lon', 'type:pci', 'type:seg_id', 'required:pci']) AS \"check\", unnest([count(*) FILTER (pci < 0 OR pci > 90), count(*) FILTER (lat < 42.24::DOUBLE OR lat > 43), count(*) FILTER (lon < -83.26::DOUBLE), 0, 1, count(*) FILTER (pci IS NULL)])::BIGINT AS n FROM points", "points")
def v4_validate_range(s, d):
    return S.violations(T.points(s, d), required=("pci",), ranges={"pci": (0, 90), "lat": (42.24, 43), "lon": (-83.26, None)}, types={"pci": "double", "seg_id": "double"})


@query("SELECT unnest(['length:bands', 'shape:row']) AS \"check\", unnest([count(*) FILTER (len(bands) <> 60), (max(row) + 1 <> 20)::BIGINT])::BIGINT AS n FROM bandpix", "bandpix")
def v4_validate_shape(s, d):
    return S.violations(T.bandpix(s, d), lengths={"bands": 60}, shape=(20, -1))


@query("SELECT 'required:lon' AS \"check\", count(*) FILTER (lon IS NULL) AS n FROM grid UNION ALL SELECT 'required:lat', count(*) FILTER (lat IS NULL) FROM grid UNION ALL SELECT 'unique:row,col', count(*) - count(DISTINCT row * 1000 + col) FROM grid UNION ALL SELECT 'alone:first', (SELECT count(*) FROM grid g ANTI JOIN (SELECT row, col FROM road) r ON g.row = r.row AND g.col = r.col) UNION ALL SELECT 'alone:second', (SELECT count(*) FROM road r ANTI JOIN grid g ON g.row = r.row AND g.col = r.col)", "grid", "road")
def v1_validate_pixels(s, d):
    g = T.grid(s, d)
    return S.violations(g, required=("lon", "lat"), unique=("row", "col")).unionByName(S.misaligned(g, T.road(s, d)))


@query("SELECT unnest(['required:pci', 'required:lon', 'required:lat']) AS \"check\", unnest([count(*) FILTER (pci IS NULL), count(*) FILTER (lon IS NULL), count(*) FILTER (lat IS NULL)])::BIGINT AS n FROM (SELECT nullif(pci, 50) AS pci, lon, CASE WHEN idx % 7 > 0 THEN lat END AS lat FROM points)", "points")
def v2_validate_points(s, d):
    p = T.points(s, d).withColumn("pci", F.nullif("pci", F.lit(50.0))).withColumn("lat", F.when(F.col("idx") % 7 > 0, F.col("lat")))
    return S.violations(p, required=("pci", "lon", "lat"))


@query("SELECT 'unique:row,col' AS \"check\", count(*) - count(DISTINCT row * 1000 + col) AS n FROM road", "road")
def v3_validate_mask(s, d):
    return S.violations(T.road(s, d), unique=("row", "col"))


@query("SELECT row, col, CASE WHEN value > 0 THEN value / 2 END AS value FROM classes", "classes")
def u1_custom_stage(s, d):
    def halve(labels):
        return labels.withColumn("value", F.col("value") / 2)

    return T.classes(s, d).withColumn("value", C.nan_nonpositive(F.col("value"))).transform(halve)
