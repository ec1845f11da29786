"""Readers and writers: survey points, roads, lookups, masks, patches."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def normalise_points(df: DataFrame, geographic: bool = True) -> DataFrame:
    """idx, lon, lat, pci, seg_id from survey columns in any case. The value is ``pci`` or else ``cond``; the place is
    ``x``, ``y`` (x being the latitude of geographic surveys) or else ``latitude``, ``longitude``."""
    df = df.toDF(*[c.lower() for c in df.columns])
    value = next((c for c in ("pci", "cond") if c in df.columns), None)
    if value is None:
        raise ValueError("a pci or cond column is needed")
    if {"x", "y"} <= set(df.columns):
        lat, lon = ("x", "y") if geographic else ("y", "x")
    elif {"latitude", "longitude"} <= set(df.columns):
        lat, lon = "latitude", "longitude"
    else:
        raise ValueError("x and y, or latitude and longitude, are needed")
    idx = F.col("idx").cast("long") if "idx" in df.columns else F.monotonically_increasing_id()
    seg = F.col("seg_id").cast("string") if "seg_id" in df.columns else F.lit(None).cast("string")
    return df.select(idx.alias("idx"), F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat"), F.col(value).cast("double").alias("pci"), seg.alias("seg_id"))


def scan_points(spark: SparkSession, path: str, geographic: bool = True) -> DataFrame:
    return normalise_points(spark.read.csv(path, header=True), geographic)


GEOJSON = "features array<struct<properties:struct<seg_id:string>,geometry:struct<coordinates:array<array<double>>>>>"


def scan_roads_geojson(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(seg_id, ord, x, y) of feature collections: one a file or, with multi_line False, one a line, which splits."""
    f = spark.read.json(path, schema=GEOJSON, multiLine=multi_line).select(F.explode("features").alias("f"))
    return f.select(F.col("f.properties.seg_id").cast("string").alias("seg_id"), F.posexplode("f.geometry.coordinates").alias("ord", "p")).select("seg_id", "ord", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"))


def write_roads_geojson(vertices: DataFrame, path: str) -> None:
    """One feature collection a line, holding one road of (seg_id, ord, x, y)."""
    at = F.transform(F.array_sort(F.collect_list(F.struct("ord", "x", "y"))), lambda v: F.array(v["x"].cast("double"), v["y"].cast("double")))
    roads = vertices.groupBy("seg_id").agg(at.alias("at"))
    geometry = F.struct(F.lit("LineString").alias("type"), F.col("at").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("seg_id").cast("string").alias("seg_id")).alias("properties"), geometry.alias("geometry"))
    roads.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features"))).alias("value")).write.mode("overwrite").text(path)


def parse_lut(df: DataFrame, text: str = "value") -> DataFrame:
    return df.select(F.explode(F.from_json(text, "map<string,double>")).alias("seg_id", "pci"))


def scan_seg_lut(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """(seg_id, pci) of JSON maps: one a file or, with whole False, one a line, which splits."""
    return parse_lut(spark.read.text(path, wholetext=whole))


#: Stored cells are sorted by tiles of 2^TILE_BITS cells a side along a Z-order curve; zones of 2^ZONE_BITS have a folder
#: each. A region is read from the folders and row groups that it meets.
TILE_BITS, ZONE_BITS = 8, 12
#: Zones that a filter names one by one.
NAMED_ZONES = 4096
#: Folders that a table is cut into, about: a table that would have more gets larger zones.
MOST_FOLDERS = 256


def z_code(row: Column, col: Column, bits: int) -> Column:
    """The place along a Z-order curve of the square of 2^bits cells a side that a cell lies in."""

    def spread(v: Column) -> Column:
        v = F.shiftright(v.cast("long"), bits)
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return F.shiftleft(spread(row), 1).bitwiseOR(spread(col))


def zone_bits_for(df: DataFrame, by: tuple[str, ...], least: int) -> int:
    """The least size of zones, from ``least`` on, that makes about MOST_FOLDERS folders at most. A zone's number without
    its last two bits is that of the zone of twice the side."""
    sides = range(least, 32)
    zones = df.select(*by, z_code(F.col("row"), F.col("col"), least).alias("_z")).distinct()
    counts = zones.agg(*[F.approx_count_distinct(F.struct(*by, F.shiftright("_z", 2 * (b - least)))).alias(str(b)) for b in sides]).first()
    return next((b for b in sides if counts[str(b)] <= MOST_FOLDERS), 31)


def write_tiled(df: DataFrame, path: str, *by: str, zone_bits: int = ZONE_BITS) -> None:
    """Rows (row, col, ...) in Z-order below path, with a folder for each value of the columns ``by`` and each zone, of
    2^zone_bits cells a side or larger: the number of folders doesn't follow the table's size, a small region of a large
    table is found by its rows and columns inside them. The zones' size is part of the folders' name, so readers need
    not be told."""
    zone_bits = zone_bits_for(df, by, zone_bits)
    zone = f"zone_{zone_bits}"
    keys = [*by, zone, "tile"]
    placed = df.withColumn("tile", z_code(F.col("row"), F.col("col"), TILE_BITS)).withColumn(zone, z_code(F.col("row"), F.col("col"), zone_bits))
    placed.repartitionByRange(*keys).sortWithinPartitions(*keys, "row", "col").write.mode("overwrite").partitionBy(*by, zone).parquet(path)


def scan_tiled(spark: SparkSession, path: str, rect: tuple[int, int, int, int] | None = None) -> DataFrame:
    """What write_tiled wrote; with a region (y0, y1, x0, x1; half open) only its rows. The region becomes a filter on
    the zones' folders and one on row and column, which skips row groups of other tiles."""
    df = spark.read.parquet(path)
    zone = next(c for c in df.columns if c.startswith("zone_"))
    bits = int(zone.split("_")[1])
    if rect is not None:
        y0, y1, x0, x1 = (max(0, v) for v in rect)
        ys, xs = range(y0 >> bits, ((y1 - 1) >> bits) + 1), range(x0 >> bits, ((x1 - 1) >> bits) + 1)
        code = lambda y, x: sum(((y >> i & 1) << 2 * i + 1) | ((x >> i & 1) << 2 * i) for i in range(32))
        if not len(ys) or not len(xs):
            df = df.where(F.lit(False))
        elif len(ys) * len(xs) <= NAMED_ZONES:
            df = df.where(F.col(zone).isin([code(y, x) for y in ys for x in xs]))
        else:  # a square's codes lie between those of its first and last corner
            df = df.where(F.col(zone).between(code(ys[0], xs[0]), code(ys[-1], xs[-1])))
        df = df.where((F.col("row") >= rect[0]) & (F.col("row") < rect[1]) & (F.col("col") >= rect[2]) & (F.col("col") < rect[3]))
    return df.drop(zone, "tile")


def scan_mask_cropped(spark: SparkSession, path: str, rect: tuple[int, int, int, int]) -> DataFrame:
    """True cells of (y0, y1, x0, x1), half open and moved to the origin; only the zones it meets are read."""
    return scan_tiled(spark, path, rect).select((F.col("row") - rect[0]).alias("row"), (F.col("col") - rect[2]).alias("col"))


def scan_mask(spark: SparkSession, path: str) -> DataFrame:
    return scan_tiled(spark, path).select("row", "col")


def write_mask(cells: DataFrame, path: str, roi: tuple, description: str = "road mask", author: str = "", version: float = 1.0, zone_bits: int = ZONE_BITS) -> None:
    """The cells in Z-order, and a sidecar beside them."""
    write_tiled(cells.select("row", "col").distinct(), path, zone_bits=zone_bits)
    side = json.dumps({"description": description, "author": author, "version": version, "roi": list(roi)})
    cells.sparkSession.createDataFrame([(side,)], "value string").coalesce(1).write.mode("overwrite").text(path.rstrip("/") + "_meta")


def _read_or_none(spark: SparkSession, path: str, how: str) -> DataFrame | None:
    try:
        return getattr(spark.read, how)(path)
    except AnalysisException:
        return None


def mask_cache_or_build(spark: SparkSession, path: str, roi: tuple, build) -> tuple[DataFrame, bool]:
    """(cells, whether roi lies in the stored mask's): the stored mask if it and its sidecar exist, else the built one."""
    side = _read_or_none(spark, path.rstrip("/") + "_meta", "text")
    held = scan_mask(spark, path) if side is not None and _read_or_none(spark, path, "parquet") is not None else None
    if held is None:
        write_mask(build(), path, roi)
        return scan_mask(spark, path), True
    have = json.loads(side.first()["value"])["roi"]
    return held, have[0] <= roi[0] and roi[1] <= have[1] and have[2] <= roi[2] and roi[3] <= have[3]


def concat_band_sets(first: DataFrame, second: DataFrame) -> DataFrame:
    """Bands of both sets; an error if one has a cell that the other lacks. Coordinates come from the first."""
    alone = {r["check"]: r["n"] for r in misaligned(first, second).collect()}
    if any(alone.values()):
        raise ValueError(f"cells differ: {alone}")
    return first.join(second.select("row", "col", F.col("bands").alias("_more")), ["row", "col"]).withColumn("bands", F.concat("bands", "_more")).drop("_more")


def roi_key(roi: tuple) -> str:
    return "_".join(str(int(round(v))) for v in roi)


def write_patches(tables: dict[str, DataFrame], path: str, roi: tuple, source: int) -> None:
    """Each named table below path/name, partitioned by data source and rounded ROI."""
    for name, df in tables.items():
        df.withColumn("data_source", F.lit(source)).withColumn("roi_key", F.lit(roi_key(roi))).write.mode("overwrite").partitionBy("data_source", "roi_key").parquet(f"{path}/{name}")


def read_regions(spark: SparkSession, path: str) -> DataFrame | None:
    return _read_or_none(spark, path, "parquet")


def write_pixel_table(pixels: DataFrame, path: str, zone_bits: int = ZONE_BITS) -> None:
    """Pixels (data_source, row, col, ...) in Z-order, by data source and zone."""
    write_tiled(pixels, path, "data_source", zone_bits=zone_bits)


def scan_pixel_table(spark: SparkSession, path: str, source: int | None = None, rect: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Pixels of one data source, or of all; of the region (y0, y1, x0, x1) only, if one is given."""
    df = scan_tiled(spark, path, rect)
    return df if source is None else df.where(F.col("data_source") == source)


def misaligned(first: DataFrame, second: DataFrame) -> DataFrame:
    """(check, n): cells (row, col) of one layer that the other lacks."""
    keys = ["row", "col"]
    a, b = first.select(*keys).distinct(), second.select(*keys).distinct()
    lone = a.join(b, keys, "left_anti").select(F.lit("first").alias("side")).unionAll(b.join(a, keys, "left_anti").select(F.lit("second").alias("side")))
    return lone.agg(F.count_if(F.col("side") == "first").alias("alone:first"), F.count_if(F.col("side") == "second").alias("alone:second")).unpivot([], ["alone:first", "alone:second"], "check", "n")


def violations(df: DataFrame, *, required: tuple[str, ...] = (), ranges: dict[str, tuple[float | None, float | None]] | None = None, unique: tuple[str, ...] = (), types: dict[str, str] | None = None, lengths: dict[str, int] | None = None, shape: tuple[int, int] | None = None) -> DataFrame:
    """(check, n): rows that miss a required value, lie outside an inclusive range (None: open), repeat a unique key, or
    hold an array of another length than given; 1 for a column of another type than given, or for a raster (row, col)
    whose height or width is another than in ``shape``. -1 stands for any length."""
    wanted = (*required, *(ranges or {}), *unique, *(types or {}), *(lengths or {}), *(("row", "col") if shape else ()))
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")

    def outside(c: str, a: float | None, b: float | None) -> Column:
        low = F.lit(False) if a is None else F.col(c) < F.lit(a)
        high = F.lit(False) if b is None else F.col(c) > F.lit(b)
        return low | high

    tests = {f"required:{c}": F.count_if(F.col(c).isNull()) for c in required}
    tests |= {f"range:{c}": F.count_if(outside(c, a, b)) for c, (a, b) in (ranges or {}).items()}
    tests |= {f"length:{c}": F.count_if(F.size(c) != k) for c, k in (lengths or {}).items() if k != -1}
    tests |= {f"type:{c}": F.lit(int(dict(df.dtypes)[c] != t)).cast("long") for c, t in (types or {}).items()}
    if shape:
        tests |= {f"shape:{c}": (F.coalesce(F.max(c) + 1, F.lit(0)) != k).cast("long") for c, k in zip(("row", "col"), shape, strict=True) if k != -1}
    out = None
    if tests:
        out = df.agg(*[t.alias(k) for k, t in tests.items()]).unpivot([], [F.col(f"`{k}`") for k in tests], "check", "n")
    if unique:
        again = df.groupBy(*unique).agg(F.count("*").alias("k")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("n")).select(F.lit("unique:" + ",".join(unique)).alias("check"), "n")
        out = again if out is None else out.unionByName(again)
    return out
