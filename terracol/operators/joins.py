"""Spatial joins by grid buckets: no nested loops, exact distances afterwards."""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, sqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terracol.functions.session import materialised, numbered
from terracol.operators.nearest import nearest as nearest


def _bucket(v: Column, cell: float) -> Column:
    return F.floor(v / F.lit(float(cell))).cast("long")


def _around(df: DataFrame, x: str, y: str, cell: float) -> DataFrame:
    """df once for each of the 9 buckets around its place."""
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return df.withColumn("_n", F.explode(near)).withColumn("_bx", _bucket(F.col(x), cell) + F.col("_n.i")).withColumn("_by", _bucket(F.col(y), cell) + F.col("_n.j")).drop("_n")


def _keyed(df: DataFrame, x: str, y: str, cell: float) -> DataFrame:
    return df.withColumn("_bx", _bucket(F.col(x), cell)).withColumn("_by", _bucket(F.col(y), cell))


def squared(a: str, b: str, c: str, d: str) -> Column:
    return (F.col(a) - F.col(c)) * (F.col(a) - F.col(c)) + (F.col(b) - F.col(d)) * (F.col(b) - F.col(d))


def within(left: DataFrame, right: DataFrame, radius: float, *, lx: str = "lx", ly: str = "ly", rx: str = "rx", ry: str = "ry", inclusive: bool = False) -> DataFrame:
    """Pairs of rows closer than ``radius`` (their squared distance is ``d2``). Column names must not clash. Both sides are
    sorted by bucket: the planner's size of exploded rows is that of the file they come from, so it would broadcast them."""
    pairs = _around(left, lx, ly, radius).hint("merge").join(_keyed(right, rx, ry, radius), ["_bx", "_by"]).drop("_bx", "_by").withColumn("d2", squared(lx, ly, rx, ry))
    r2 = F.sqrt("d2")
    return pairs.where(r2 <= radius if inclusive else r2 < radius)


def near_any(left: DataFrame, right: DataFrame, radius: float, *, lx: str = "lx", ly: str = "ly", rx: str = "rx", ry: str = "ry", inclusive: bool = False) -> DataFrame:
    """Rows of left with a row of right closer than ``radius``: a semi-join, so left's rows aren't multiplied. Each place of
    right counts once and is sent to the 9 buckets around it; rows of left have one bucket, and both are sorted by it. Rows
    of left outside the box of right's places, two radii wider, are not sent."""
    x, y, reach = F.col(lx), F.col(ly), F.lit(2.0 * radius)
    box = right.agg(F.min(rx).alias("_x0"), F.max(rx).alias("_x1"), F.min(ry).alias("_y0"), F.max(ry).alias("_y1"))
    inside = (x >= F.col("_x0") - reach) & (x <= F.col("_x1") + reach) & (y >= F.col("_y0") - reach) & (y <= F.col("_y1") + reach)
    a = _keyed(left.crossJoin(F.broadcast(box)).where(inside).select(*left.columns), lx, ly, radius)
    b = _around(right.select(rx, ry).distinct(), rx, ry, radius).hint("merge")
    d = F.sqrt(squared(lx, ly, rx, ry))
    hit = d <= radius if inclusive else d < radius
    return a.join(b, (a["_bx"] == b["_bx"]) & (a["_by"] == b["_by"]) & hit, "left_semi").select(*left.columns).distinct()


#: Rows of one place that range_pairs packs into a list, about.
PLACE_ROWS = 1024


def range_pairs(left: DataFrame, right: DataFrame, radius: float, i: str, j: str, *, lx: str = "lx", ly: str = "ly", rx: str = "rx", ry: str = "ry") -> DataFrame:
    """(i, j) of all pairs of rows closer than ``radius``. A distance is taken once for two places, however many rows share
    them: rows of one place are packed into lists of about PLACE_ROWS, lists of near places are dealt out evenly, and each
    task writes the pairs of its lists one by one. Rows without a place are in no pair; a null i or j is a row like others.

    A generated loop hands nothing on before it is done with an input row. Both lists opened in one loop would keep all
    their pairs in memory, so a coalesce that moves nothing parts the loops: a task keeps the rows of one list, each with
    the other list (8 MB or so), and the pairs of one of them."""

    def lists(df: DataFrame, key: str, x: str, y: str, part: str) -> tuple[DataFrame, DataFrame]:
        placed = df.select(F.struct(key).alias(key), x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
        rows = placed.groupBy(x, y).agg(F.count("*").alias("_n"))
        parts = F.ceil(F.col("_n") / PLACE_ROWS)
        packed = placed.join(rows, [x, y]).groupBy(x, y, F.pmod(F.xxhash64(key), parts).alias(part)).agg(F.transform(F.collect_list(key), lambda v: v[key]).alias(key))
        return rows.drop("_n"), packed.drop(part)

    (a, packed_a), (b, packed_b) = lists(left, i, lx, ly, "_pa"), lists(right, j, rx, ry, "_pb")
    near = within(a, b, radius).drop("d2")
    both = near.join(packed_a, [lx, ly]).join(packed_b, [rx, ry]).select(i, j)
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = both.repartition(parts).select(F.explode(i).alias(i), j).coalesce(parts)
    return rows.select(i, F.explode(j).alias(j))


#: Points of a tile that merge_close_points aims at; its finest tiles are so many thresholds wide.
TILE_POINTS, FINEST = 100_000, 4


def _tile_side(points: DataFrame, threshold: float) -> float | None:
    """The side of the largest tiles (FINEST thresholds times a power of two) of at most TILE_POINTS points; the finest
    where a spot is denser. None if all points fit into one."""
    base = _keyed(points, "x", "y", FINEST * threshold).groupBy("_bx", "_by").agg(F.count("*").alias("n"))
    levels = base.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(40))))
    up = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level"))).alias(c)
    most = levels.groupBy("level", up("_bx"), up("_by")).agg(F.sum("n").alias("n")).groupBy("level").agg(F.max("n").alias("most"), F.sum("n").alias("n")).collect()
    if not most or most[0]["n"] <= TILE_POINTS:
        return None
    return FINEST * threshold * 2.0 ** max([r["level"] for r in most if r["most"] <= TILE_POINTS], default=0)


def _settle(open_: DataFrame, threshold: float, side: float | None) -> DataFrame:
    """One round of merge_close_points over ``open_`` (idx, x, y, leads: true, or null for an open point): the points that
    now lead (``leads``, and whether ``edge``: near the border of its tile) and those that stay open.

    A tile takes its points and those within the threshold of it in idx order. Inside it the sequential rule holds: a
    point near a leader is absorbed, one near an open point waits, any other leads, unless it lies outside the tile, where
    its neighbours are not known. Points are kept in cells so small that any two of one are near each other: a cell has
    one leader at most, and an open point in it is enough to wait for, however many points fall on one spot.
    """
    reach = threshold * (1 + 1e-9)
    cell = threshold / 1.5
    at = lambda v, off: F.floor((F.col(v) + F.lit(off)) / F.lit(side)).cast("long")
    if side is None:
        dealt = open_.withColumn("ty", F.lit(0).cast("long")).withColumn("tx", F.lit(0).cast("long")).withColumn("own", F.lit(True)).withColumn("edge", F.lit(False))
    else:
        dealt = open_.withColumn("ty", F.explode(F.sequence(at("y", -reach), at("y", reach)))).withColumn("tx", F.explode(F.sequence(at("x", -reach), at("x", reach))))
        dealt = dealt.withColumn("own", (at("y", 0.0) == F.col("ty")) & (at("x", 0.0) == F.col("tx")))
        dealt = dealt.withColumn("edge", (at("y", -reach) != at("y", reach)) | (at("x", -reach) != at("x", reach)))
    parts = int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = dealt.select("ty", "tx", "idx", "x", "y", F.coalesce("leads", F.lit(False)).alias("leads"), "own", "edge").repartition(parts, "ty", "tx").sortWithinPartitions("ty", "tx", "idx")
    around = [(i, j) for i in (-2, -1, 0, 1, 2) for j in (-2, -1, 0, 1, 2) if (i, j) != (0, 0)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leaders, waiting = None, {}, {}
        for b in batches:
            out = []
            for ty, tx, idx, x, y, leads, own, edge in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now != (ty, tx):
                    now, leaders, waiting = (ty, tx), {}, {}
                here = (floor(x / cell), floor(y / cell))
                if leads:
                    leaders[here] = (x, y)
                    continue
                if here in leaders:
                    continue
                beside = [(here[0] + i, here[1] + j) for i, j in around]
                if any(k in leaders and sqrt((x - leaders[k][0]) ** 2 + (y - leaders[k][1]) ** 2) < threshold for k in beside):
                    continue
                held = own and (here in waiting or any(sqrt((x - u) ** 2 + (y - v) ** 2) < threshold for k in beside if k in waiting for u, v in waiting[k]))
                if own and not held:
                    leaders[here] = (x, y)
                    out.append((idx, x, y, True, edge))
                    continue
                waiting.setdefault(here, []).append((x, y))
                if own:
                    out.append((idx, x, y, None, edge))
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_()), strict=True)], names=["idx", "x", "y", "leads", "edge"])

    return ready.mapInArrow(run, "idx long, x double, y double, leads boolean, edge boolean")


def leading_points(points: DataFrame, threshold: float) -> DataFrame:
    """(idx, x, y) of the points that lead, taken in idx order: a point leads if no earlier leader is closer than
    ``threshold``. points has idx (unique), x, y; points without a place are left out.

    Tiles settle their points in one pass each (see _settle). What waits for a neighbour tile's points meets the leaders
    found beside the borders in the next round, in tiles of twice the side, or in one tile once few are open. So rounds
    follow how often a chain of waiting points crosses the tiles, not its length. Of the points of one place only the
    first can lead: what leads it or absorbs it absorbs the others.
    """
    placed = points.select(F.col("idx").cast("long").alias("idx"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    open_ = materialised(placed.groupBy("x", "y").agg(F.min("idx").alias("idx")).select("idx", "x", "y", F.lit(None).cast("boolean").alias("leads")))
    found, side = [], _tile_side(open_, threshold)
    while True:
        done = materialised(_settle(open_, threshold, side))
        found.append(done.where("leads").select("idx", "x", "y"))
        left = done.where("leads IS NULL").count()
        if not left:
            break
        side = None if left <= TILE_POINTS and done.where("leads IS NULL OR edge").count() <= 4 * TILE_POINTS else 2 * side
        open_ = done.where("leads IS NULL OR edge").select("idx", "x", "y", "leads")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def merge_close_points(points: DataFrame, threshold: float, method: str = "mean_min") -> DataFrame:
    """Greedy merge in idx order: a point not yet absorbed leads and merges all points closer than ``threshold``, also
    those that another leader merges.

    Returns idx (leader), lon, lat, pci: the mean place and least pci (``mean_min``), the least of all three
    (``min_min``), or place and pci of the first point merged (``first_location``) or of the middle one by idx, the
    earlier of two (``middle_location``). Leaders are at least the threshold apart, so a point meets a few of them.
    """
    p = points.select(F.col("idx").alias("j"), F.col("lon").alias("rx"), F.col("lat").alias("ry"), F.col("pci").alias("v"))
    lead = leading_points(points.select("idx", F.col("lon").alias("x"), F.col("lat").alias("y")), threshold)
    led = within(lead.select(F.col("idx").alias("i"), F.col("x").alias("lx"), F.col("y").alias("ly")), p, threshold)
    if method == "middle_location":
        w = Window.partitionBy("i")
        ranked = led.withColumn("k", F.row_number().over(w.orderBy("j"))).join(led.groupBy("i").agg(F.count("*").alias("n")), "i")
        return ranked.where("k = int((n - 1) / 2) + 1").select(F.col("i").alias("idx"), F.col("rx").alias("lon"), F.col("ry").alias("lat"), F.col("v").alias("pci"))
    # a mean is taken from the leader's place, which keeps it the same in any order of addition
    mean = lambda v, of: F.first(of) + F.avg(F.col(v) - F.col(of))
    forms = {
        "mean_min": (mean("rx", "lx"), mean("ry", "ly"), F.min("v")),
        "min_min": (F.min("rx"), F.min("ry"), F.min("v")),
        "first_location": (F.min_by("rx", "j"), F.min_by("ry", "j"), F.min_by("v", "j")),
    }
    x, y, v = forms[method]
    return led.groupBy(F.col("i").alias("idx")).agg(x.alias("lon"), y.alias("lat"), v.alias("pci"))


def consecutive_pairs(points: DataFrame) -> DataFrame:
    """Points followed, in idx order, by a point of the same segment: idx, next_idx, seg_id. Points are numbered in sorted
    ranges and meet the next number in a join, so no task holds more than its range, however idx is spread."""
    p = numbered(points.select("idx", "seg_id"), "idx")
    after = p.select((F.col("number") - 1).alias("number"), F.col("idx").alias("next_idx"), F.col("seg_id").alias("_seg"))
    return p.join(after, "number").where(F.col("_seg") == F.col("seg_id")).select("idx", "next_idx", "seg_id")


def condition_join(roads: DataFrame, conditions: DataFrame) -> DataFrame:
    """Rows of roads with a known condition (conditions: seg_id, pci), which is cut to an integer."""
    return roads.join(conditions.select("seg_id", F.col("pci").cast("int").alias("pci")), "seg_id")


def lookup_labels(cells: DataFrame, lut: DataFrame, fill: int = 0) -> DataFrame:
    """cells (row, col, seg_id) with ``label``: the segment's value cut to an integer; ``fill`` for segments that the
    lookup (seg_id, pci) doesn't hold or gives no value, and for cells without a segment."""
    return cells.join(lut.select("seg_id", F.col("pci").cast("int").alias("_pci")), "seg_id", "left").withColumn("label", F.coalesce("_pci", F.lit(fill))).drop("_pci")


def split_by_roi(points: DataFrame, rois: list[tuple]) -> DataFrame:
    """points with the ``role`` of each box (role, lon_min, lon_max, lat_min, lat_max) that a point lies in: from the lower
    ends on, up to and without the upper ones. The boxes are a list of the caller's; a point has a row for each."""
    x, y = F.col("lon"), F.col("lat")
    hit = [F.when((x >= F.lit(float(a))) & (x < F.lit(float(b))) & (y >= F.lit(float(c))) & (y < F.lit(float(d))), F.lit(role)) for role, a, b, c, d in rois]
    return points.withColumn("role", F.explode(F.array_compact(F.array(*hit))))


def edge_meets_box(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Whether the edge (x0, y0)-(x1, y1) shares a point with the box from (x, y), borders included: the extents meet and
    the box's corners don't all lie strictly on one side of the edge's line."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    extents = (F.least(x0, x1) <= x + width) & (F.greatest(x0, x1) >= x) & (F.least(y0, y1) <= y + height) & (F.greatest(y0, y1) >= y)
    sides = [(x1 - x0) * (v - y0) - (y1 - y0) * (u - x0) for u in (x, x + width) for v in (y, y + height)]
    return extents & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)


def grid_steps(pixels: DataFrame) -> tuple[float, float]:
    """(lon_step, lat_step): the distance between the first two columns and the first two rows; 0 with only one."""
    ends = pixels.agg(F.min("row").alias("row"), F.min("col").alias("col")).first()
    if ends["row"] is None:
        return 0.0, 0.0
    lon = [r[0] for r in pixels.where(F.col("row") == ends["row"]).orderBy("col").select("lon").limit(2).collect()]
    lat = [r[0] for r in pixels.where(F.col("col") == ends["col"]).orderBy("row").select("lat").limit(2).collect()]
    return tuple(abs(v[1] - v[0]) if len(v) == 2 else 0.0 for v in (lon, lat))


def road_pixels(pixels: DataFrame, edges: DataFrame, height: int, width: int, steps: tuple[float, float] | None = None) -> DataFrame:
    """(row, col) of pixels whose box [lon, lon + step] x [lat, lat + step] meets an edge (x0, y0, x1, y1).

    The last row and column are never tested. A pixel has one bucket of the grid's own step; an edge is sent to the
    buckets of the boxes it can meet, column by column along it, so its copies follow its length and not its extent.
    Edges with a null end meet nothing, equal edges are sent once. Both sides are sorted by bucket: an edge's copies are
    many times the file it comes from, by which the planner would broadcast them.
    """
    sx, sy = steps or grid_steps(pixels)
    inner = pixels.where((F.col("row") < height - 1) & (F.col("col") < width - 1)).select("row", "col", "lon", "lat")
    if not (sx > 0 and sy > 0):
        return inner.select("row", "col").where(F.lit(False))
    slack = 1e-6
    e = edges.select(*[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]).where("x0 + y0 + x1 + y1 IS NOT NULL").distinct()
    low, high = F.least("x0", "x1"), F.greatest("x0", "x1")
    cell = lambda v, step, off: F.floor(v / F.lit(step) + F.lit(off)).cast("long")
    e = e.withColumn("_bx", F.explode(F.sequence(cell(low, sx, -1 - slack), cell(high, sx, slack))))
    # the part of the edge over the two columns that a box of this bucket can cover
    flat = F.col("x0") == F.col("x1")
    slope = (F.col("y1") - F.col("y0")) / F.when(flat, F.lit(1.0)).otherwise(F.col("x1") - F.col("x0"))
    on = lambda x: F.when(flat, F.col("y0")).otherwise(F.col("y0") + slope * (F.least(F.greatest(x, low), high) - F.col("x0")))
    left, right = on((F.col("_bx") - slack) * F.lit(sx)), on((F.col("_bx") + 2 + slack) * F.lit(sx))
    right = F.when(flat, F.col("y1")).otherwise(right)
    e = e.withColumn("_by", F.explode(F.sequence(cell(F.least(left, right), sy, -1 - slack), cell(F.greatest(left, right), sy, slack))))
    p = inner.withColumn("_px", cell(F.col("lon"), sx, 0)).withColumn("_py", cell(F.col("lat"), sy, 0))
    meets = edge_meets_box(F.col("lon"), F.col("lat"), F.lit(sx), F.lit(sy))
    return p.join(e.hint("merge"), (F.col("_px") == F.col("_bx")) & (F.col("_py") == F.col("_by")) & meets, "left_semi").select("row", "col")


def roads_in_bbox(edges: DataFrame, roi: tuple, line: str = "line") -> DataFrame:
    """Edges of the roads that meet the box (lon_min, lon_max, lat_min, lat_max) with at least one edge."""
    box = [F.lit(float(v)) for v in (roi[0], roi[2], roi[1] - roi[0], roi[3] - roi[2])]
    return edges.join(edges.where(edge_meets_box(*box)).select(line).distinct(), line, "left_semi")
