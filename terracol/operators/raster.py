"""Crops, morphology, stencils, offsets, lines and patches on pixel, cell and label tables."""

from __future__ import annotations

from collections.abc import Callable
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terracol.functions.columns import no_nan, rgb_to_yuv, roi_contains
from terracol.operators.tiles import SIDE, Block, on_tiles, places, reach_of, weighted, windowed


# --- crops -----------------------------------------------------------------------------------------------------
def default_roi(pixels: DataFrame) -> DataFrame:
    return pixels.agg(F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"), F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"))


def crop_rect(pixels: DataFrame, roi: tuple) -> DataFrame:
    inside = pixels.where(roi_contains(F.col("lon"), F.col("lat"), roi))
    return inside.agg(F.min("row").alias("y0"), F.max("row").alias("y1"), F.min("col").alias("x0"), F.max("col").alias("x1"))


def crop_to(df: DataFrame, rect: DataFrame) -> DataFrame:
    """Rows of y0 <= row < y1 and x0 <= col < x1, moved to the origin; ``rect`` has one row."""
    j = df.crossJoin(F.broadcast(rect)).where((F.col("row") >= F.col("y0")) & (F.col("row") < F.col("y1")) & (F.col("col") >= F.col("x0")) & (F.col("col") < F.col("x1")))
    return j.withColumn("row", F.col("row") - F.col("y0")).withColumn("col", F.col("col") - F.col("x0")).drop("y0", "y1", "x0", "x1")


def roi_crop(pixels: DataFrame, roi: tuple) -> DataFrame:
    """Index box of the pixels inside the ROI, half open (its last row and column go). An empty ROI gives no rows."""
    return crop_to(pixels, crop_rect(pixels, roi))


def centered_window(df: DataFrame, x: int, y: int, half: int) -> DataFrame:
    return df.where(F.col("row").between(y - half, y + half) & F.col("col").between(x - half, x + half))


# --- structuring elements and morphology -----------------------------------------------------------------------
def disk(r: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(-r, r + 1) for j in range(-r, r + 1) if i * i + j * j <= r * r]


def square(n: int) -> list[tuple[int, int]]:
    return [(i - n // 2, j - n // 2) for i in range(n) for j in range(n)]


def circle_mask(df: DataFrame, row: int, col: int, radius: float) -> DataFrame:
    dy, dx = F.col("row").cast("double") - row, F.col("col").cast("double") - col  # squares of whole numbers overflow
    return df.where(F.sqrt(dy * dy + dx * dx) <= radius).select("row", "col")


def _grown(a: np.ndarray, se: list[tuple[int, int]]) -> np.ndarray:
    return windowed(a, se, np.logical_or, False)


def _shrunk(a: np.ndarray, se: list[tuple[int, int]]) -> np.ndarray:
    return ~windowed(~a, [(-i, -j) for i, j in se], np.logical_or, True)


#: The steps of each morphological operation.
STEPS = {"dilation": (_grown,), "erosion": (_shrunk,), "opening": (_shrunk, _grown), "closing": (_grown, _shrunk)}


def morphology(cells: DataFrame, se: list[tuple[int, int]], how: str, height: int | None = None, width: int | None = None, *, side: int | None = None) -> DataFrame:
    """Cells after a binary dilation, erosion, opening or closing with the offsets ``se``, on dense tiles: one shuffle of
    the cells and of the tiles' borders, whatever the element's size. Outside the image nothing is set."""
    steps = STEPS[how]

    def run(t: Block) -> pa.Table:
        a = t.there & t.image
        for step in steps:
            a = step(a, se) & t.image
        return t.rows(a)

    return on_tiles(cells, len(steps) * reach_of(se), run, "row int, col int", height=height, width=width, side=side)


def dilate(cells: DataFrame, se: list[tuple[int, int]], height: int | None = None, width: int | None = None) -> DataFrame:
    return morphology(cells, se, "dilation", height, width)


def erode(cells: DataFrame, se: list[tuple[int, int]], height: int | None = None, width: int | None = None) -> DataFrame:
    """Cells whose whole neighbourhood is set; outside the image nothing is."""
    return morphology(cells, se, "erosion", height, width)


def morph_open(cells: DataFrame, se, height=None, width=None) -> DataFrame:
    return morphology(cells, se, "opening", height, width)


def morph_close(cells: DataFrame, se, height=None, width=None) -> DataFrame:
    return morphology(cells, se, "closing", height, width)


def morph_multiclass(labels: DataFrame, se, how: str = "dilation", height: int | None = None, width: int | None = None, *, side: int | None = None) -> DataFrame:
    """Morphology class by class; where classes meet the smallest wins. Of repeated cells the smallest class counts.

    All classes of a tile are grown and shrunk at once, as windows of least and greatest values; a closing, in which
    classes may overlap in between, takes each class in the box around it."""
    back = [(-i, -j) for i, j in se]

    def shrunk(v: np.ndarray) -> np.ndarray:  # classes as numbers, 0 where there is none
        low = windowed(v, back, np.minimum, 0.0)
        return np.where(low == windowed(v, back, np.maximum, 0.0), low, 0.0)

    def grown(v: np.ndarray) -> np.ndarray:
        low = windowed(np.where(v > 0, v, np.inf), se, np.minimum, np.inf)
        return np.where(np.isfinite(low), low, 0.0)

    def closed(v: np.ndarray, image: np.ndarray) -> np.ndarray:
        out, around = np.zeros_like(v), 2 * reach_of(se)
        r, c = np.nonzero(v > 0)
        kinds, of = np.unique(v[r, c], return_inverse=True)
        for k in range(len(kinds) - 1, -1, -1):  # the smallest is written last
            y, x = r[of == k], c[of == k]
            box = np.s_[max(y.min() - around, 0) : y.max() + around + 1, max(x.min() - around, 0) : x.max() + around + 1]
            full = _shrunk(_grown(v[box] == kinds[k], se) & image[box], se) & image[box]
            out[box][full] = kinds[k]
        return out

    def run(t: Block) -> pa.Table:
        v = np.where(t.image, np.nan_to_num(t.values["value"], nan=0.0, posinf=0.0), 0.0)
        if how == "closing":
            v = closed(v, t.image)
        else:
            for step in {"dilation": (grown,), "erosion": (shrunk,), "opening": (shrunk, grown)}[how]:
                v = np.where(t.image, step(v), 0.0)
        return t.rows(v > 0, value=v)

    reach = reach_of(se) * (1 if how in ("dilation", "erosion") else 2)
    return on_tiles(labels.where("value > 0"), reach, run, "row int, col int, value double", values=("value",), height=height, width=width, side=side)


# --- stencils --------------------------------------------------------------------------------------------------
def _mirrored(img: DataFrame, half: int, height: int, width: int, edge: int) -> DataFrame:
    """img with a border of ``half`` cells mirrored at its edges; edge 1 repeats the border cell, 0 doesn't."""

    def copies(c: str, n: int) -> Column:
        low, high = -F.col(c) - edge, F.lit(2 * n - 2 + edge) - F.col(c)
        return F.filter(F.array(F.col(c), low, high), lambda v: v.between(-half, n - 1 + half))

    out = img.withColumn("_r", F.explode(F.array_distinct(copies("row", height)))).drop("row").withColumnRenamed("_r", "row")
    return out.withColumn("_c", F.explode(F.array_distinct(copies("col", width)))).drop("col").withColumnRenamed("_c", "col")


def stencil(img: DataFrame, weights: dict[tuple[int, int], float], height: int, width: int, *, edge: int = 1, value: str = "value", side: int | None = None) -> DataFrame:
    """Weighted sum over each given cell's neighbours (correlation) on a dense image with mirrored borders, on tiles. A
    null or missing neighbour gives null."""
    return _on_image(img, reach_of(weights), height, width, edge, value, lambda a: {value: weighted(a, weights)}, f"row int, col int, `{value}` double", side)


def _on_image(img: DataFrame, reach: int, height: int, width: int, edge: int, value: str, run: Callable[[np.ndarray], dict], schema: str, side: int | None = None) -> DataFrame:
    """Arrays that ``run`` makes of the tiles of a mirrored image, at the cells given."""
    big = _mirrored(img.select("row", "col", no_nan(F.col(value).cast("double")).alias(value)), reach, height, width, edge)
    return on_tiles(big, reach, lambda t: t.rows(t.there & t.image, **run(t.values[value])), schema, values=(value,), height=height, width=width, side=side)


def mean_filter(img: DataFrame, height: int, width: int, k: int = 3, value: str = "value") -> DataFrame:
    h = k // 2
    return stencil(img, {(i, j): 1.0 / (k * k) for i in range(-h, h + 1) for j in range(-h, h + 1)}, height, width, value=value)


# The Sobel kernels, as convolved (flipped).
SOBEL_X = {(-1, -1): 1.0, (-1, 1): -1.0, (0, -1): 2.0, (0, 1): -2.0, (1, -1): 1.0, (1, 1): -1.0}
SOBEL_Y = {(j, i): w for (i, j), w in SOBEL_X.items()}


def sobel(img: DataFrame, height: int, width: int, value: str = "value") -> DataFrame:
    """gx, gy and their magnitude; null cells take the image's mean first."""
    mean = img.agg(F.avg(no_nan(F.col(value))).alias("_mean"))
    full = img.crossJoin(F.broadcast(mean)).select("row", "col", F.coalesce(no_nan(F.col(value)), F.col("_mean")).alias(value))

    def run(a: np.ndarray) -> dict:
        x, y = weighted(a, SOBEL_X), weighted(a, SOBEL_Y)
        return {"gx": x, "gy": y, "magnitude": np.sqrt(x * x + y * y)}

    return _on_image(full, 1, height, width, 1, value, run, "row int, col int, gx double, gy double, magnitude double")


def gaussian_weights(sigma: float, size: int = 5) -> dict[tuple[int, int], float]:
    from math import exp

    h = size // 2
    one = [exp(-(i * i) / (2 * sigma * sigma)) for i in range(-h, h + 1)]
    total = sum(one)
    return {(i - h, j - h): one[i] * one[j] / total**2 for i in range(size) for j in range(size)}


CROSS = {(0, 0): -4.0, (0, 1): 1.0, (0, -1): 1.0, (1, 0): 1.0, (-1, 0): 1.0}


def laplacian_of_gaussian(img: DataFrame, height: int, width: int, sigma: float = 1.0, value: str = "value") -> DataFrame:
    """Both stencils in one pass: the smoothed image of a mirrored image is the mirrored smoothed image."""
    around = gaussian_weights(sigma)
    return _on_image(img, reach_of(around) + 1, height, width, 0, value, lambda a: {value: weighted(weighted(a, around), CROSS)}, f"row int, col int, `{value}` double")


def grad_object_removal(pixels: DataFrame, mask: DataFrame, height: int, width: int, threshold: float, gate: DataFrame | None = None) -> DataFrame:
    """mask's own cells, null where the luminance changes faster than ``threshold`` within a cell of the labels ``gate``
    (mask itself, if not given). ``pixels`` has r, g, b."""
    y = pixels.select("row", "col", rgb_to_yuv(F.col("r"), F.col("g"), F.col("b"))[0].alias("value"))
    steep = sobel(mean_filter(y, height, width), height, width).where(F.col("magnitude") > threshold).select("row", "col")
    near = morph_multiclass(mask if gate is None else gate, square(3), "dilation", height, width)
    gone = steep.join(near, ["row", "col"], "left_semi").withColumn("_gone", F.lit(True))
    return mask.join(gone, ["row", "col"], "left").select("row", "col", F.when(F.col("_gone").isNull(), F.col("value")).alias("value"))


# --- masks -----------------------------------------------------------------------------------------------------
def binary_mask(labels: DataFrame) -> DataFrame:
    """The cells of values above 0."""
    return labels.where("value > 0").select("row", "col")


def labeled_mask(labels: DataFrame) -> DataFrame:
    """The cells of known values above 0: unknown ones (null or NaN) and background go."""
    return binary_mask(labels.where(no_nan(F.col("value")).isNotNull()))


def mask_and(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("row", "col").distinct().join(b.select("row", "col"), ["row", "col"], "left_semi")


def mask_or_max(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("row", "col", "value").unionByName(b.select("row", "col", "value")).groupBy("row", "col").agg(F.max("value").alias("value"))


def mask_apply(pixels: DataFrame, cells: DataFrame) -> DataFrame:
    hit = cells.select("row", "col").distinct().withColumn("_hit", F.lit(True))
    return pixels.join(hit, ["row", "col"], "left").withColumn("bands", F.transform("bands", lambda x: F.when(F.col("_hit"), F.coalesce(no_nan(x), F.lit(0.0))).otherwise(0.0))).drop("_hit")


def or_nan(a: DataFrame, b: DataFrame) -> DataFrame:
    x = a.select("row", "col", no_nan(F.col("value")).alias("_a")).join(b.select("row", "col", no_nan(F.col("value")).alias("_b")), ["row", "col"], "full")
    return x.select("row", "col", F.coalesce("_a", "_b").alias("value"))


# --- offsets ---------------------------------------------------------------------------------------------------
def offset_scores(ideal: DataFrame, detected: DataFrame, shift: int) -> DataFrame:
    """Overlap of ``ideal`` with ``detected`` moved by (dy, dx), for every move up to ``shift`` each way. Repeated cells
    count once.

    A tile of ideal cells meets the detected cells in it and ``shift`` around it in one task. Both are packed into
    machine words, so a move of 64 cells costs an AND and a bit count; a row a move leaves the task.
    """
    spark = ideal.sparkSession
    moves = np.arange(-shift, shift + 1)
    a = ideal.select("row", "col").withColumn("ty", F.explode(places("row", 0, SIDE))).withColumn("tx", F.explode(places("col", 0, SIDE)))
    d = detected.select("row", "col").withColumn("ty", F.explode(places("row", shift, SIDE))).withColumn("tx", F.explode(places("col", shift, SIDE)))
    words = lambda x: np.packbits(x, axis=1).view(np.uint64)

    def run(key: tuple, mine: pa.Table, other: pa.Table) -> pa.Table:
        found = np.zeros((len(moves), len(moves)), np.int64)
        if mine.num_rows and other.num_rows:
            top, left = key[0].as_py() * SIDE, key[1].as_py() * SIDE
            here, around = np.zeros((SIDE, SIDE), bool), np.zeros((SIDE + 2 * shift, SIDE + 2 * shift), bool)
            here[mine["row"].to_numpy() - top, mine["col"].to_numpy() - left] = True
            around[other["row"].to_numpy() - top + shift, other["col"].to_numpy() - left + shift] = True
            here = words(here).T
            for x, dx in enumerate(moves.tolist()):
                rows = words(np.ascontiguousarray(around[:, shift - dx : shift - dx + SIDE]))
                seen = np.lib.stride_tricks.sliding_window_view(rows, SIDE, axis=0)  # [shift - dy] are the rows under dy
                found[::-1, x] = np.bitwise_count(seen & here).sum(axis=(1, 2), dtype=np.int64)
        y, x = np.nonzero(found)
        return pa.table({"dy": moves[y].astype(np.int32), "dx": moves[x].astype(np.int32), "score": found[y, x]})

    hits = a.groupBy("ty", "tx").cogroup(d.groupBy("ty", "tx")).applyInArrow(run, "dy int, dx int, score long").groupBy("dy", "dx").agg(F.sum("score").alias("score"))
    every = spark.range(-shift, shift + 1).select(F.col("id").cast("int").alias("dy")).withColumn("dx", F.explode(F.sequence(F.lit(-shift), F.lit(shift))))
    return every.join(hits, ["dy", "dx"], "left").withColumn("score", F.coalesce("score", F.lit(0)))


def best_offset(ideal: DataFrame, detected: DataFrame, shift: int = 20) -> DataFrame:
    return offset_scores(ideal, detected, shift).orderBy(F.desc("score"), "dy", "dx").limit(1)


def apply_offset(cells: DataFrame, offset: DataFrame, height: int, width: int) -> DataFrame:
    """Cells rolled by a one-row (dy, dx) table, wrapping at the borders."""
    j = cells.crossJoin(F.broadcast(offset.select("dy", "dx")))
    return j.withColumn("row", F.pmod(F.col("row") + F.col("dy"), F.lit(height)).cast("int")).withColumn("col", F.pmod(F.col("col") + F.col("dx"), F.lit(width)).cast("int")).drop("dy", "dx")


def crop_by_offset(df: DataFrame, offset: DataFrame, height: int, width: int) -> DataFrame:
    """The rows that an offset (one row dy, dx) leaves inside the image, moved to the origin: the first -dy rows go for
    a move up, the last dy for a move down; columns alike."""
    j = df.crossJoin(F.broadcast(offset.select("dy", "dx")))
    first = lambda m: F.greatest(F.lit(0), -F.col(m))
    inside = lambda v, m, n: (F.col(v) >= first(m)) & (F.col(v) < F.lit(n) - F.greatest(F.lit(0), F.col(m)))
    j = j.where(inside("row", "dy", height) & inside("col", "dx", width))
    return j.withColumn("row", (F.col("row") - first("dy")).cast("int")).withColumn("col", (F.col("col") - first("dx")).cast("int")).drop("dy", "dx")


# --- lines -----------------------------------------------------------------------------------------------------
def polyline_edges(vertices: DataFrame, line: str = "line", order: str = "ord") -> DataFrame:
    w = Window.partitionBy(line).orderBy(order)
    return vertices.select(line, order, F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1")).where("x1 IS NOT NULL")


def on_axis(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each place the index of the nearest value of an axis in any order, the least one of equally near; NaN values
    are near nothing."""
    index = np.flatnonzero(~np.isnan(values))
    order = index[np.lexsort((index, values[index]))]
    v = values[order]
    right = np.minimum(np.searchsorted(v, at), len(v) - 1)
    left = np.searchsorted(v, v[np.maximum(right - 1, 0)])
    a, b = np.abs(v[left] - at), np.abs(v[right] - at)
    return np.where((a < b) | ((a == b) & (order[left] < order[right])), order[left], order[right])


def nearest_on_axes(vertices: DataFrame, pixels: DataFrame, line: str = "line", order: str = "ord") -> DataFrame:
    """vertices (x: longitude, y: latitude) as whole columns and rows of a grid that need not be regular: x is the column
    whose longitude in the first row is nearest, y the row whose latitude in the first column is. The two axes, height and
    width numbers, are sent to every task."""
    first = pixels.agg(F.min("row").alias("row"), F.min("col").alias("col")).first()
    if first["row"] is None:
        return vertices.select(line, order, F.lit(0).alias("x"), F.lit(0).alias("y")).limit(0)
    axis = lambda v, by, at: pixels.where(F.col(by) == first[by]).groupBy(at).agg(F.min(v).cast("double").alias(v)).orderBy(at).toArrow()
    across, down = axis("lon", "row", "col"), axis("lat", "col", "row")
    lon, lat, cols, rows = across["lon"].to_numpy(), down["lat"].to_numpy(), across["col"].to_numpy(), down["row"].to_numpy()
    placed = vertices.where("x IS NOT NULL AND y IS NOT NULL").select(line, order, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    schema = placed.select(line, order, F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")).schema

    def run(batches):
        for b in batches:
            x, y = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cols[on_axis(lon, x)].astype(np.int32)), pa.array(rows[on_axis(lat, y)].astype(np.int32))], names=schema.names)

    return placed.mapInArrow(run, schema)


def rasterize_line(edges: DataFrame, line: str = "line") -> DataFrame:
    """Cells of each edge between integer places: one a step along the longer axis, the other coordinate rounded as
    Bresenham's error term does. Equal edges of a line are walked once."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    n = F.greatest(F.abs(dx), F.abs(dy))
    e = edges.select(line, "x0", "y0", "x1", "y1").distinct().withColumn("_n", n).withColumn("_t", F.explode(F.sequence(F.lit(0), n.cast("int"))))
    step = lambda d: F.when(F.col("_n") == 0, F.lit(0)).otherwise(F.signum(d) * F.floor((2 * F.abs(d) * F.col("_t") + F.col("_n")) / (2 * F.col("_n"))))
    return e.select(line, (F.col("y0") + step(dy)).cast("int").alias("row"), (F.col("x0") + step(dx)).cast("int").alias("col")).distinct()


def grow_along_line(edges: DataFrame, height: int, width: int, along: int = 10, across: int = 2) -> DataFrame:
    """Cells around each edge's start: integer steps along its direction and across it, cut towards zero; x is axis 0."""
    grid = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-along, along + 1) for b in range(-across, across + 1)])
    angle = F.atan2((F.col("y1") - F.col("y0")).cast("double"), (F.col("x1") - F.col("x0")).cast("double"))
    e = edges.withColumn("_t", angle).withColumn("_g", F.explode(grid))
    x = F.col("x0") + F.col("_g.a") * F.cos("_t") - F.col("_g.b") * F.sin("_t")
    y = F.col("y0") + F.col("_g.a") * F.sin("_t") + F.col("_g.b") * F.cos("_t")
    return e.select(x.cast("int").alias("row"), y.cast("int").alias("col")).where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)).distinct()


def resample_path(points: DataFrame, n: int = 100, line: str = "line", order: str = "ord") -> DataFrame:
    """n places at equal parts of each path's length, on its straight pieces."""
    w = Window.partitionBy(line).orderBy(order)
    step = F.sqrt((F.col("x") - F.lag("x").over(w)) * (F.col("x") - F.lag("x").over(w)) + (F.col("y") - F.lag("y").over(w)) * (F.col("y") - F.lag("y").over(w)))
    p = points.select(line, order, "x", "y", F.coalesce(step, F.lit(0.0)).alias("_s"))
    p = p.withColumn("_at", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.max("_at").over(Window.partitionBy(line)))
    p = p.withColumn("_u", F.when(F.col("_all") > 0, F.col("_at") / F.col("_all")).otherwise(0.0))
    e = p.select(line, "x", "y", "_u", F.lead("x").over(w).alias("_x"), F.lead("y").over(w).alias("_y"), F.lead("_u").over(w).alias("_v")).where("_v > _u")
    t = F.explode(F.sequence(F.ceil(F.col("_u") * (n - 1)).cast("int"), F.when(F.col("_v") >= 1, F.lit(n - 1)).otherwise(F.ceil(F.col("_v") * (n - 1)).cast("int") - 1)))
    e = e.where((F.ceil(F.col("_u") * (n - 1)) <= F.ceil(F.col("_v") * (n - 1)) - 1) | (F.col("_v") >= 1)).withColumn("k", t)
    f = (F.col("k") / (n - 1) - F.col("_u")) / (F.col("_v") - F.col("_u"))
    return e.select(line, "k", (F.col("x") + (F.col("_x") - F.col("x")) * f).alias("x"), (F.col("y") + (F.col("_y") - F.col("y")) * f).alias("y"))


class Remaining:
    """Places of a path that are still free, in a quadtree of their boxes and counts: the nearest one is found best box
    first, and taking a place empties the boxes above it."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y = x.tolist(), y.tolist()
        depth = max(0, int(np.ceil(np.log2(max(len(x), 1)) / 2)) - 1)
        side = 1 << depth
        scaled = lambda v: np.minimum((v - v.min()) / (v.max() - v.min()) * side, side - 1).astype(np.int64) if v.max() > v.min() else np.zeros(len(v), np.int64)
        self.cell = (scaled(y) * side + scaled(x)).tolist()
        order = np.argsort(self.cell, kind="stable")
        at, first = np.unique(np.array(self.cell)[order], return_index=True)
        self.members = {c: m.tolist() for c, m in zip(at.tolist(), np.split(order, first[1:]), strict=True)}
        box = {c: (min(x[m]), max(x[m]), min(y[m]), max(y[m])) for c, m in self.members.items()}
        self.levels = [(side, {c: [len(m), *map(float, box[c])] for c, m in self.members.items()})]
        while side > 1:
            below, side = self.levels[-1][1], side // 2
            above: dict[int, list] = {}
            for c, (n, x0, x1, y0, y1) in below.items():
                up = c // (2 * side) // 2 * side + c % (2 * side) // 2
                u = above.get(up)
                above[up] = [n, x0, x1, y0, y1] if u is None else [u[0] + n, min(u[1], x0), max(u[2], x1), min(u[3], y0), max(u[4], y1)]
            self.levels.append((side, above))

    def take(self, k: int) -> None:
        c = self.cell[k]
        self.members[c].remove(k)
        for side, boxes in self.levels:
            boxes[c][0] -= 1
            c = c // side // 2 * (side // 2) + c % side // 2

    def nearest(self, k: int) -> int:
        """The free place nearest to place k, the first of equally near ones."""
        px, py = self.x[k], self.y[k]
        top = len(self.levels) - 1
        heap, best = [(0.0, top, c) for c in self.levels[top][1]], (float("inf"), -1)
        while heap:
            bound, level, c = heappop(heap)
            if bound > best[0]:
                break
            if not level:
                for m in self.members[c]:
                    dx, dy = self.x[m] - px, self.y[m] - py
                    best = min(best, (dx * dx + dy * dy, m))
                continue
            side, boxes = self.levels[level - 1]
            y, x = c // (side // 2) * 2, c % (side // 2) * 2
            for child in (y * side + x, y * side + x + 1, (y + 1) * side + x, (y + 1) * side + x + 1):
                b = boxes.get(child)
                if b is not None and b[0]:
                    dx, dy = max(b[1] - px, px - b[2], 0.0), max(b[3] - py, py - b[4], 0.0)
                    if dx * dx + dy * dy <= best[0]:
                        heappush(heap, (dx * dx + dy * dy, level - 1, child))
        return best[1]


def greedy_path_order(points: DataFrame, line: str = "line", start: str = "westmost") -> DataFrame:
    """Each path's points by nearest neighbour from the first one, the westmost (least x) or the northmost (least y, as y
    grows to the south): columns of points and ``ord``. Of equally near points the one of least idx is next.
    A path's points meet in one task, as each step depends on those before it; a step looks into a few boxes of those
    left. Memory is bounded by a road segment's survey points."""
    schema = points.select(line, "idx", "x", "y").withColumn("ord", F.lit(0)).schema

    def run(p):
        p = p.sort_values("idx")
        x, y = p["x"].to_numpy(float), p["y"].to_numpy(float)
        at = {"first": 0, "westmost": int(x.argmin()), "northmost": int(y.argmin())}[start]
        free, order = Remaining(x, y), []
        for _ in range(len(p)):
            order.append(at)
            free.take(at)
            at = free.nearest(at)
        out = p.iloc[order].copy()
        out["ord"] = range(len(p))
        return out[[line, "idx", "x", "y", "ord"]]

    return points.select(line, "idx", "x", "y").groupBy(line).applyInPandas(run, schema)


# --- patches ---------------------------------------------------------------------------------------------------
def patch_origins(height: int, width: int, crop: int, overlap: float) -> list[tuple[int, int]]:
    """Regular grid, then the bottom strip, the right strip and the corner where the grid leaves a rest."""
    if not 0 <= overlap < 1 or int(crop * (1 - overlap)) < 1:
        raise ValueError("overlap must leave a step of at least one cell")
    if crop > height or crop > width:
        raise ValueError("the crop is larger than the image")
    step = int(crop * (1 - overlap))
    ys, xs = list(range(0, height - crop + 1, step)), list(range(0, width - crop + 1, step))
    out = [(y, x) for y in ys for x in xs]
    rest_y, rest_x = ys[-1] + crop < height, xs[-1] + crop < width
    out += [(height - crop, x) for x in xs] if rest_y else []
    out += [(y, width - crop) for y in ys] if rest_x else []
    return out + ([(height - crop, width - crop)] if rest_y and rest_x else [])


def tile_patches(pixels: DataFrame, height: int, width: int, crop: int, overlap: float) -> DataFrame:
    """pixels as (patch_id, r, c, ...): a pixel finds its patches by arithmetic, without a join on the image."""
    patch_origins(height, width, crop, overlap)
    step = int(crop * (1 - overlap))

    def grid(v: str, n: int) -> Column:  # numbers of the regular positions that cover v; the last strip is number count
        count = (n - crop) // step + 1
        low = F.greatest(F.floor((F.col(v) - crop) / step) + 1, F.lit(0)).cast("int")
        high = F.least(F.floor(F.col(v) / step), F.lit(count - 1)).cast("int")
        inside = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        rest = (count - 1) * step + crop < n
        return F.when((F.col(v) >= n - crop) & F.lit(rest), F.concat(inside, F.array(F.lit(count)))).otherwise(inside)

    ny, nx = (height - crop) // step + 1, (width - crop) // step + 1
    rest_y = (ny - 1) * step + crop < height
    p = pixels.withColumn("_y", F.explode(grid("row", height))).withColumn("_x", F.explode(grid("col", width)))
    strip = ny * nx
    right = strip + (nx if rest_y else 0)
    last_y, last_x = F.col("_y") == ny, F.col("_x") == nx
    pid = F.when(last_y & last_x, F.lit(right + ny)).when(last_y, strip + F.col("_x")).when(last_x, right + F.col("_y")).otherwise(F.col("_y") * nx + F.col("_x"))
    top = F.when(last_y, F.lit(height - crop)).otherwise(F.col("_y") * step)
    left = F.when(last_x, F.lit(width - crop)).otherwise(F.col("_x") * step)
    return p.withColumn("patch_id", pid.cast("int")).withColumn("r", (F.col("row") - top).cast("int")).withColumn("c", (F.col("col") - left).cast("int")).drop("_y", "_x")


def drop_empty_patches(patches: DataFrame, labels: DataFrame) -> DataFrame:
    full = labels.groupBy("patch_id").agg(F.sum("value").alias("s")).where("s > 0")
    return patches.join(full, "patch_id", "left_semi")


def fold_to_frame(cells: DataFrame, sizes: DataFrame, crop: int) -> DataFrame:
    """cells (region, row, col, bands) of regions of some height and width (``sizes``: region, height, width) folded into
    a crop x crop frame: region, r, c, bands. Null bands count as 0.

    A region smaller than the frame both ways is copied, its cells with any band other than 0. Of the others the cells
    whose band 0 is not 0 are taken, with all their bands: what lies past the frame is mirrored back and wins over what
    is there (the last in row-major order, where several meet); a cell past it on no side whose index equals crop
    drops out."""
    clean = cells.join(sizes, "region").withColumn("bands", F.transform("bands", lambda x: F.coalesce(no_nan(x), F.lit(0.0))))
    small = (F.col("height") < crop) & (F.col("width") < crop)
    inside = (F.col("row") < crop) & (F.col("col") < crop)
    past = (F.col("row") > crop) | (F.col("col") > crop)
    some = F.exists("bands", lambda x: x != 0)
    n = clean.where(F.when(small, some).otherwise((F.get("bands", F.lit(0)) != 0) & (inside | past)))
    back = lambda v: F.when(F.col(v) >= crop, F.lit(crop) - (F.pmod(F.col(v), F.lit(crop)) + 1)).otherwise(F.col(v))
    order = F.struct((~inside).alias("late"), F.col("row").alias("sr"), F.col("col").alias("sc"))
    return n.select("region", back("row").cast("int").alias("r"), back("col").cast("int").alias("c"), order.alias("_o"), "bands").groupBy("region", "r", "c").agg(F.max_by("bands", "_o").alias("bands"))


def region_label_raster(frames: DataFrame, labels: DataFrame, fill: float = 0.0) -> DataFrame:
    """(region, r, c, label): a region's label (``labels``: region, label) where the frame's band 0 is not 0, else fill."""
    on = F.coalesce(F.get("bands", F.lit(0)) != 0, F.lit(False))
    return frames.join(labels, "region", "left").select("region", "r", "c", F.when(on, F.col("label")).otherwise(F.lit(fill)).alias("label"))


def augment_patches(patches: DataFrame, crop: int) -> DataFrame:
    """Each patch as it is, flipped both ways and turned by 90, 180 and 270 degrees (``op``)."""
    last = F.lit(crop - 1)
    r, c = F.col("r"), F.col("c")
    forms = {"same": (r, c), "flip_rows": (last - r, c), "flip_cols": (r, last - c), "turn_90": (last - c, r), "turn_180": (last - r, last - c), "turn_270": (c, last - r)}
    ops = F.array(*[F.struct(F.lit(k).alias("op"), a.cast("int").alias("r"), b.cast("int").alias("c")) for k, (a, b) in forms.items()])
    rest = [x for x in patches.columns if x not in ("r", "c")]
    return patches.withColumn("_o", F.explode(ops)).select(*rest, "_o.op", "_o.r", "_o.c")


def sub_crops(patches: DataFrame, crop: int, size: int, count: int, seed: int = 42) -> DataFrame:
    """``count`` squares of ``size`` cells out of each patch (column ``part``, from 0), moved to the origin; where they
    lie follows from a hash of patch_id, part and seed."""
    h = F.md5(F.concat_ws(":", F.col("patch_id").cast("string"), F.col("part").cast("string"), F.lit(str(seed))).cast("binary"))
    at = lambda start: F.conv(F.substring(h, start, 8), 16, 10).cast("long") % (crop - size + 1)
    p = patches.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    p = p.withColumn("r", (F.col("r") - at(1)).cast("int")).withColumn("c", (F.col("c") - at(9)).cast("int"))
    return p.where(F.col("r").between(0, size - 1) & F.col("c").between(0, size - 1))


def train_val_split(patches: DataFrame, share: float, seed: int = 42, key: str = "patch_id") -> DataFrame:
    h = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary")), 1, 8), 16, 10).cast("long")
    return patches.withColumn("role", F.when(h % 1000 < int(round(1000 * share)), "val").otherwise("train"))


def centerline_windows(cells: DataFrame, pixels: DataFrame, length: int, overlap: float, width: int, image_height: int, image_width: int) -> DataFrame:
    """Windows along each connected component, sampled from the image: (component, window, i, k, row, col, center_row,
    center_col) with the other columns of pixels (null where the image has no row); cell i of the window, k cells across.

    A window with any cell outside image_height x image_width is dropped. Its centre is its cell length // 2.

    A component's cells are ordered by (row, col); windows of ``length`` cells start every int(length (1 - overlap))
    cells while one fits; each of their cells is sampled at k = -width // 2 ... width // 2 across, at places cut
    towards zero. Cells are numbered in ranges, so no task holds a component.
    """
    from terracol.functions.session import numbered
    from terracol.operators.graph import connected_components

    step = max(1, int(length * (1 - overlap)))
    c = numbered(connected_components(cells), "row", "col", by=("component",), name="i").withColumn("i", F.col("i") - 1)
    after = c.select("component", (F.col("i") - 1).alias("i"), F.col("row").alias("_row"), F.col("col").alias("_col"))
    c = c.join(after, ["component", "i"], "left").withColumn("dr", F.col("_row") - F.col("row")).withColumn("dc", F.col("_col") - F.col("col")).drop("_row", "_col")
    c = c.join(c.groupBy("component").agg(F.count("*").alias("n")), "component")
    last = F.floor((F.col("n") - length - 1) / step)
    first = F.greatest(F.ceil((F.col("i") - length + 1) / step), F.lit(0))
    m = c.where(F.col("n") > length).withColumn("window", F.explode(F.when(first <= F.least(F.floor(F.col("i") / step), last), F.sequence(first.cast("int"), F.least(F.floor(F.col("i") / step), last).cast("int")))))
    inside = F.col("i") < F.col("window") * step + length - 1
    t = m.groupBy("component", "window").agg(F.avg(F.when(inside, F.col("dr"))).alias("tr"), F.avg(F.when(inside, F.col("dc"))).alias("tc"))
    size = F.sqrt(F.col("tr") * F.col("tr") + F.col("tc") * F.col("tc"))
    t = t.where("tr IS NOT NULL AND (tr <> 0 OR tc <> 0)").select("component", "window", (-F.col("tc") / size).alias("pr"), (F.col("tr") / size).alias("pc"))
    half = width // 2
    m = m.withColumn("i", (F.col("i") - F.col("window") * step).cast("int"))
    j = m.join(t, ["component", "window"]).withColumn("k", F.explode(F.sequence(F.lit(-half), F.lit(half))))
    j = j.select("component", "window", "i", "k", F.col("row").alias("_r"), F.col("col").alias("_c"), (F.col("row") + F.col("k") * F.col("pr")).cast("int").alias("row"), (F.col("col") + F.col("k") * F.col("pc")).cast("int").alias("col"))
    inner = F.col("row").between(0, image_height - 1) & F.col("col").between(0, image_width - 1)
    middle = (F.col("i") == length // 2) & (F.col("k") == 0)
    whole = j.groupBy("component", "window").agg(F.min(inner).alias("_in"), F.min(F.when(middle, F.col("_r"))).alias("center_row"), F.min(F.when(middle, F.col("_c"))).alias("center_col"))
    return j.drop("_r", "_c").join(whole.where("_in").drop("_in"), ["component", "window"]).join(pixels, ["row", "col"], "left")
