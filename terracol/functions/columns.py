"""Column functions on bands, coordinates and condition values. Invalid pixels are NULL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the data model: sensors, their RGB bands, condition class edges.
VENUS_IL, VENUS_DETROIT, AIRBUS_HSP, AIRBUS_PAN = 0, 1, 2, 3
VENUS_RGB = (6, 3, 1)
CLASS_EDGES = (25.0, 55.0, 70.0, 85.0)
CLASS_NAMES = ("Failed", "Poor", "Fair", "Good", "Excellent")
PIXEL_AREA = 16.0


def no_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def roi_contains(lon: Column, lat: Column, roi: tuple, inclusive: bool = False) -> Column:
    """Whether a place lies in roi = (lon_min, lon_max, lat_min, lat_max)."""
    a, b, c, d = (F.lit(float(v)) for v in roi)
    if inclusive:
        return lon.between(a, b) & lat.between(c, d)
    return (lon > a) & (lon < b) & (lat > c) & (lat < d)


def roi_within(small: list[Column], large: list[Column]) -> Column:
    """All corners of the small ROI inside the large one, borders included."""
    return (small[0] >= large[0]) & (small[1] <= large[1]) & (small[2] >= large[2]) & (small[3] <= large[3])


def rgb_select(source: Column, bands: Column) -> Column:
    venus = F.array(*[F.get(bands, F.lit(i)) for i in VENUS_RGB])
    return F.when(source.isin(VENUS_IL, VENUS_DETROIT), venus).when(source == AIRBUS_HSP, F.slice(bands, 4, 3)).when(source == AIRBUS_PAN, F.array_repeat(F.get(bands, F.lit(0)), 3)).otherwise(F.slice(bands, 1, 3))


def nan_nonpositive(x: Column) -> Column:
    return F.when(~F.isnan(x) & (x > 0), x)


def gray_mask(r: Column, g: Column, b: Column, gray: float = 0.1, white: float = 0.92) -> Column:
    t = F.lit(float(gray))
    return (F.abs(r - g) <= t) & (F.abs(r - b) <= t) & (F.abs(g - b) <= t) & ((r + g + b) / 3 < F.lit(float(white)))


def rgb_to_yuv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """BT.601, not clipped."""
    rows = ((0.299, 0.587, 0.114), (-0.14713, -0.28886, 0.436), (0.615, -0.51499, -0.10001))
    return tuple(F.lit(p) * r + F.lit(q) * g + F.lit(s) * b for p, q, s in rows)


def pci_category(x: Column) -> Column:
    return F.when(x < 30, "below_30").when(x <= 70, "between_30_and_70").when(x > 70, "above_70")


def divide_ranges(x: Column, *edges: float) -> list[Column]:
    """Three range tests from 4 edges (30, 30, 70, 85 by default), four from 6."""
    e = edges or (30, 30, 70, 85)
    if len(e) == 4:
        return [x < e[0], x.between(e[1], e[2]), x > e[3]]
    if len(e) == 6:
        return [x < e[0], x.between(e[1], e[2]), (x > e[3]) & (x <= e[4]), x > e[5]]
    raise ValueError("4 or 6 edges are needed")


def severity_masks(x: Column) -> list[Column]:
    return [x < 40, x.between(40, 70), x > 85]


def condition_class(x: Column) -> Column:
    """0 (Failed) to 4 (Excellent): the number of edges at or below x."""
    total = F.lit(0)
    for e in CLASS_EDGES:
        total = total + (x >= F.lit(e)).cast("int")
    return total


def affine_xy(row: Column, col: Column, a: float, b: float, c: float, d: float, e: float, f: float) -> tuple[Column, Column]:
    """Pixel centre to easting and northing by an affine transform."""
    x, y = col + F.lit(0.5), row + F.lit(0.5)
    return F.lit(c) + F.lit(a) * x + F.lit(b) * y, F.lit(f) + F.lit(d) * x + F.lit(e) * y


def bands_subset(bands: Column, keep: list[int]) -> Column:
    return F.array(*[F.get(bands, F.lit(i)) for i in keep])


def spectral_smooth(bands: Column, window: int = 3) -> Column:
    """Moving average over the band axis, cut at its ends; null bands don't count."""
    half = window // 2
    n = F.size(bands)

    def at(_: Column, i: Column) -> Column:
        low = F.greatest(i - half, F.lit(0))
        part = F.filter(F.slice(bands, low + 1, F.least(i + half, n - 1) - low + 1), lambda v: v.isNotNull())
        return F.when(F.size(part) > 0, F.aggregate(part, F.lit(0.0), lambda s, v: s + v) / F.size(part))

    return F.transform(bands, at)


# --- coordinates -----------------------------------------------------------------------------------------------
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
GRS80_F = 1 / 298.257222101


def _tm_series(f: float, a: float, lat0: float) -> tuple[float, tuple, tuple, tuple, float]:
    """The rectifying radius, the coefficients of the transverse Mercator series in the third flattening, to its fourth
    power (forwards, backwards, and from the conformal latitude), and the rectified origin."""
    from math import atan, atanh, radians, sin, sinh, sqrt

    n3 = f / (2 - f)
    big = a / (1 + n3) * (1 + n3**2 / 4 + n3**4 / 64)
    n2, n4 = n3**2, n3**4
    beta = (n3 / 2 - 2 * n2 / 3 + 37 * n3**3 / 96 - n4 / 360, n2 / 48 + n3**3 / 15 - 437 * n4 / 1440, 17 * n3**3 / 480 - 37 * n4 / 840, 4397 * n4 / 161280)
    alpha = (n3 / 2 - 2 * n2 / 3 + 5 * n3**3 / 16 + 41 * n4 / 180, 13 * n2 / 48 - 3 * n3**3 / 5 + 557 * n4 / 1440, 61 * n3**3 / 240 - 103 * n4 / 140, 49561 * n4 / 161280)
    delta = (2 * n3 - 2 * n2 / 3 - 2 * n3**3 + 116 * n4 / 45, 7 * n2 / 3 - 8 * n3**3 / 5 - 227 * n4 / 45, 56 * n3**3 / 15 - 136 * n4 / 35, 4279 * n4 / 630)
    s, ecc, xi0 = sin(radians(lat0)), 2 * sqrt(n3) / (1 + n3), 0.0
    if lat0:
        xi0 = atan(sinh(atanh(s) - ecc * atanh(ecc * s)))
        xi0 += sum(al * sin(2 * (j + 1) * xi0) for j, al in enumerate(alpha))
    return big, alpha, beta, delta, xi0


def transverse_mercator(lat: Column, lon: Column, *, lon0: float, lat0: float = 0.0, k0: float, fe: float, fn: float, f: float = WGS84_F, a: float = WGS84_A) -> tuple[Column, Column]:
    """(easting, northing) of a place in degrees."""
    big, alpha, _, _, xi0 = _tm_series(f, a, lat0)
    ecc = F.lit((f * (2 - f)) ** 0.5)
    s, off = F.sin(F.radians(lat)), F.radians(lon - F.lit(float(lon0)))
    t = F.sinh(F.atanh(s) - ecc * F.atanh(ecc * s))
    xi, eta = F.atan2(t, F.cos(off)), F.atanh(F.sin(off) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, c in enumerate(alpha):
        m = F.lit(2.0 * (j + 1))
        x = x + F.lit(c) * F.cos(m * xi) * F.sinh(m * eta)
        y = y + F.lit(c) * F.sin(m * xi) * F.cosh(m * eta)
    return F.lit(float(fe)) + F.lit(k0 * big) * x, F.lit(float(fn)) + F.lit(k0 * big) * (y - F.lit(xi0))


def mercator_to_tm_sql(e: str, n: str, *, lon0: str, lat0: float = 0.0, k0: float, fe: float, fn: float, f: float = WGS84_F, a: float = WGS84_A) -> tuple[str, str]:
    """SQL expressions of (lat, lon) in degrees for a transverse Mercator place."""
    big, _, beta, delta, xi0 = _tm_series(f, a, lat0)
    d = lambda v: f"CAST({v!r} AS DOUBLE)"
    xi = f"(({n} - {d(fn)}) / {d(k0 * big)} + {d(xi0)})"
    eta = f"(({e} - {d(fe)}) / {d(k0 * big)})"
    xi1 = f"({xi} - " + " - ".join(f"{d(b)} * sin({2 * (j + 1)} * {xi}) * cosh({2 * (j + 1)} * {eta})" for j, b in enumerate(beta)) + ")"
    eta1 = f"({eta} - " + " - ".join(f"{d(b)} * cos({2 * (j + 1)} * {xi}) * sinh({2 * (j + 1)} * {eta})" for j, b in enumerate(beta)) + ")"
    chi = f"asin(sin({xi1}) / cosh({eta1}))"
    lat = f"degrees({chi} + " + " + ".join(f"{d(v)} * sin({2 * (j + 1)} * {chi})" for j, v in enumerate(delta)) + ")"
    lon = f"({lon0} + degrees(atan2(sinh({eta1}), cos({xi1}))))"
    return lat, lon


def utm_to_wgs84_sql(e: str, n: str, zone: str, north: bool = True) -> tuple[str, str]:
    """(lat, lon) of a UTM place; ``zone`` is an expression of the zone number."""
    return mercator_to_tm_sql(e, n, lon0=f"(({zone}) * 6 - 183)", k0=0.9996, fe=500000.0, fn=0.0 if north else 10000000.0)


# EPSG:2039's projection, and its seven-parameter shift to WGS84 (position vector: metres, arc seconds,
# parts per million).
ITM_LON0, ITM_LAT0, ITM_K0, ITM_FE, ITM_FN = 35.20451694444444, 31.734393611111113, 1.0000067, 219529.584, 626907.39
ITM_SHIFT = (-24.0024, -17.1032, -17.8444)
ITM_TURN = (-0.33077, -1.85269, 1.66969)
ITM_SCALE = 5.4248


def itm_to_wgs84(df: DataFrame, x: str, y: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """df with ``lat`` and ``lon`` in WGS84 degrees of the Israeli transverse Mercator place (x, y): the projection is
    undone on GRS80, the place at height 0 is taken to geocentric coordinates, shifted, turned and scaled, and taken
    back to latitude and longitude by Bowring's formula. Null coordinates give null."""
    a, e2 = WGS84_A, GRS80_F * (2 - GRS80_F)
    w2, f2 = WGS84_F * (2 - WGS84_F), WGS84_F
    geo = mercator_to_tm_sql(f"`{x}`", f"`{y}`", lon0=f"CAST({ITM_LON0!r} AS DOUBLE)", lat0=ITM_LAT0, k0=ITM_K0, fe=ITM_FE, fn=ITM_FN, f=GRS80_F)
    taken = {c.lower() for c in df.columns}
    own = []
    for name in ("_p", "_q", "_x", "_y", "_z"):
        while name in taken:
            name += "_"
        own.append(name)
    p, q, gx, gy, gz = own
    d = df.withColumns({p: F.radians(F.expr(geo[0])), q: F.radians(F.expr(geo[1]))})
    n = F.lit(a) / F.sqrt(1 - F.lit(e2) * F.sin(p) * F.sin(p))
    c = (n * F.cos(p) * F.cos(q), n * F.cos(p) * F.sin(q), n * (1 - e2) * F.sin(p))
    rx, ry, rz = (v * 3.141592653589793 / 648000 for v in ITM_TURN)
    k = 1 + ITM_SCALE * 1e-6
    turned = (c[0] - rz * c[1] + ry * c[2], rz * c[0] + c[1] - rx * c[2], -ry * c[0] + rx * c[1] + c[2])
    d = d.withColumns({g: F.lit(t) + F.lit(k) * v for g, t, v in zip((gx, gy, gz), ITM_SHIFT, turned, strict=True)})
    b = a * (1 - f2)
    flat = F.sqrt(F.col(gx) * F.col(gx) + F.col(gy) * F.col(gy))
    t = F.atan2(F.col(gz) * a, flat * b)
    second = w2 / (1 - w2)
    phi = F.atan2(F.col(gz) + second * b * F.pow(F.sin(t), F.lit(3.0)), flat - w2 * a * F.pow(F.cos(t), F.lit(3.0)))
    return d.withColumns({lat: F.degrees(phi), lon: F.degrees(F.atan2(gy, gx))}).select(*[c for c in df.columns if c not in (lat, lon)], lat, lon)


def wgs84_to_itm(df: DataFrame, lon: str, lat: str, out: tuple[str, str] = ("x", "y")) -> DataFrame:
    """df with the Israeli transverse Mercator place of WGS84 degrees under the names ``out``: the way back of
    itm_to_wgs84, from height 0 there. Null coordinates give null."""
    a, w2, e2 = WGS84_A, WGS84_F * (2 - WGS84_F), GRS80_F * (2 - GRS80_F)
    p, q = F.radians(F.col(lat)), F.radians(F.col(lon))
    n = F.lit(a) / F.sqrt(1 - F.lit(w2) * F.sin(p) * F.sin(p))
    moved = [(v - F.lit(t)) / F.lit(1 + ITM_SCALE * 1e-6) for v, t in zip((n * F.cos(p) * F.cos(q), n * F.cos(p) * F.sin(q), n * (1 - w2) * F.sin(p)), ITM_SHIFT, strict=True)]
    rx, ry, rz = (v * 3.141592653589793 / 648000 for v in ITM_TURN)
    back = np.linalg.inv(np.array([[1, -rz, ry], [rz, 1, -rx], [-ry, rx, 1]]))
    x, y, z = (sum((F.lit(float(w)) * v for w, v in zip(row, moved, strict=True)), F.lit(0.0)) for row in back)
    b = a * (1 - GRS80_F)
    flat = F.sqrt(x * x + y * y)
    t = F.atan2(z * a, flat * b)
    phi = F.atan2(z + e2 / (1 - e2) * b * F.pow(F.sin(t), F.lit(3.0)), flat - e2 * a * F.pow(F.cos(t), F.lit(3.0)))
    places = transverse_mercator(F.degrees(phi), F.degrees(F.atan2(y, x)), lon0=ITM_LON0, lat0=ITM_LAT0, k0=ITM_K0, fe=ITM_FE, fn=ITM_FN, f=GRS80_F)
    return df.select(*[c for c in df.columns if c not in out], places[0].alias(out[0]), places[1].alias(out[1]))


def _utm(code: str) -> tuple[int, bool] | None:
    """(zone, north) of EPSG:326zz and EPSG:327zz."""
    if code.startswith(("EPSG:326", "EPSG:327")) and code[8:].isdigit() and 1 <= int(code[8:]) <= 60:
        return int(code[8:]), code[7] == "6"
    return None


def transform_crs(df: DataFrame, x: str, y: str, source: str, target: str, out: tuple[str, str] = ("x", "y")) -> DataFrame:
    """df with the place (x, y) in another system, under the names ``out``; of EPSG:4326 x is the longitude.

    Known are EPSG:4326, EPSG:3857, EPSG:326zz and EPSG:327zz (UTM) and EPSG:2039 (ITM), each to each, by way of
    EPSG:4326. Others are refused. Null coordinates give null.
    """
    rest = [c for c in df.columns if c not in out]
    u, v = F.col(x), F.col(y)
    if source == target:
        return df.select(*rest, u.alias(out[0]), v.alias(out[1]))
    if "EPSG:4326" not in (source, target):
        geo = transform_crs(df, x, y, source, "EPSG:4326", out)
        return transform_crs(geo, *out, "EPSG:4326", target, out)
    radius = F.lit(WGS84_A)
    if (source, target) == ("EPSG:4326", "EPSG:3857"):
        places = radius * F.radians(u), radius * F.log(F.tan(F.lit(0.7853981633974483) + F.radians(v) / 2))
    elif (source, target) == ("EPSG:3857", "EPSG:4326"):
        places = F.degrees(u / radius), F.degrees(2 * F.atan(F.exp(v / radius)) - F.lit(1.5707963267948966))
    elif target == "EPSG:4326" and _utm(source):
        zone, north = _utm(source)
        lat, lon = utm_to_wgs84_sql(f"`{x}`", f"`{y}`", str(zone), north)
        places = F.expr(lon), F.expr(lat)
    elif source == "EPSG:4326" and _utm(target):
        zone, north = _utm(target)
        places = transverse_mercator(v, u, lon0=zone * 6 - 183, k0=0.9996, fe=500000.0, fn=0.0 if north else 10000000.0)
    elif (source, target) == ("EPSG:4326", "EPSG:2039"):
        return wgs84_to_itm(df, x, y, out).select(*rest, *out)
    elif (source, target) == ("EPSG:2039", "EPSG:4326"):
        moved = itm_to_wgs84(df, x, y, "_lat", "_lon")
        return moved.select(*rest, F.col("_lon").alias(out[0]), F.col("_lat").alias(out[1]))
    else:
        raise ValueError(f"{source} to {target} is not supported")
    return df.select(*rest, places[0].alias(out[0]), places[1].alias(out[1]))
