"""Components, shortest paths and labelled regions of cell masks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracol.functions.session import materialised, numbered
from terracol.operators.aggregates import bounding_boxes
from terracol.operators.raster import disk

FOUR = [(-1, 0), (1, 0), (0, -1), (0, 1)]
EIGHT = [*FOUR, (-1, -1), (-1, 1), (1, -1), (1, 1)]


#: Side of the squares whose cells are joined in one task, the cells of a box that a path is searched in at once, and the
#: pairs that one task searches.
TILE = 256
BOX_CELLS = 1 << 24
PAIRS = 2000


def _moves(around):
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in around])


def tile_roots(row: np.ndarray, col: np.ndarray, eight: bool) -> np.ndarray:
    """For the cells of one square, in any order, the place of the first cell (by row and column) each is joined to."""
    order = np.lexsort((col, row))
    r, c = row[order] - row.min(), col[order] - col.min()
    at = np.full((r.max() + 3, c.max() + 3), -1, np.int64)
    at[r + 1, c + 1] = np.arange(len(r))
    label = np.arange(len(r))
    pairs = []
    for i, j in [(1, 0), (0, 1), *([(1, 1), (1, -1)] if eight else [])]:
        b = at[r + 1 + i, c + 1 + j]
        a = np.nonzero(b >= 0)[0]
        pairs.append(np.stack([a, b[a]]))
    a, b = np.concatenate(pairs, axis=1)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            onward = label[label]
            if (onward == label).all():
                break
            label = onward
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    out = np.empty(len(r), np.int64)
    out[order] = order[label]
    return out


def connected_components(cells: DataFrame, eight: bool = False, by: str | None = None) -> DataFrame:
    """cells with ``component``: 1, 2, ... by each component's first cell in row-major order (within ``by``, if given).

    Cells of a square of TILE x TILE are joined in one task; only cells on the squares' edges meet across them. A square's
    part then takes the least part around it, in the order of a hash, and that one's; edges are redrawn between what is
    left, until none is. So rounds follow the logarithm of a component's squares, also where these lie in a row (in the
    order of rows and columns they would follow their number). Each round is checkpointed. Components are numbered in ranges. Repeated cells count once.
    """
    keys = [by] if by else []
    c = cells.select(*keys, "row", "col").distinct()
    tile = [F.floor(F.col(v) / TILE).alias(f"_t{v}") for v in ("row", "col")]

    def run(p):
        at = tile_roots(p["row"].to_numpy(), p["col"].to_numpy(), eight)
        return p.assign(row0=p["row"].to_numpy()[at], col0=p["col"].to_numpy()[at])[[*keys, "row", "col", "row0", "col0"]]

    schema = c.select(*keys, "row", "col", F.col("row").alias("row0"), F.col("col").alias("col0")).schema
    parts = c.select(*keys, "row", "col", *tile).groupBy(*keys, "_trow", "_tcol").applyInPandas(run, schema)
    cell = materialised(parts.select(*keys, "row", "col", F.struct(*keys, F.col("row0").alias("row"), F.col("col0").alias("col")).alias("node")))
    on_edge = " OR ".join(f"pmod({v}, {TILE}) IN (0, {TILE - 1})" for v in ("row", "col"))
    border = cell.where(on_edge)
    up = EIGHT if eight else FOUR
    moved = border.withColumn("m", F.explode(_moves(up))).select(*keys, F.col("node").alias("a"), (F.col("row") + F.col("m.i")).alias("r"), (F.col("col") + F.col("m.j")).alias("k"))
    other = border.select(*keys, F.col("row").alias("r"), F.col("col").alias("k"), F.col("node").alias("b"))
    ranked = lambda c: F.struct(F.xxhash64(c).alias("rank"), F.col(c).alias("node")).alias(c)
    edges = materialised(moved.join(other, [*keys, "r", "k"]).where("a <> b").select(ranked("a"), ranked("b")).distinct())
    label = materialised(edges.select(F.col("a").alias("node")).distinct().withColumn("to", F.col("node")))
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        beside = materialised(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to")))
        low = materialised(beside.join(beside.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").select("node", F.col("next").alias("to")))
        label = materialised(label.join(low.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left").select("node", F.coalesce("next", "to").alias("to")))
        a, b = low.select(F.col("node").alias("a"), F.col("to").alias("x")), low.select(F.col("node").alias("b"), F.col("to").alias("y"))
        edges = materialised(edges.join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b").distinct())
    least = label.groupBy("to").agg(F.min("node.node").alias("least"))
    label = label.join(least, "to").select(F.col("node.node").alias("node"), F.col("least").alias("to"))
    joined = cell.join(label, "node", "left").select(*keys, "row", "col", F.coalesce("to", "node").alias("root"))
    roots = joined.where((F.col("row") == F.col("root.row")) & (F.col("col") == F.col("root.col"))).select(*keys, F.col("row").alias("row0"), F.col("col").alias("col0"))
    number = numbered(roots, "row0", "col0", by=tuple(keys), name="component").select(F.struct(*keys, F.col("row0").alias("row"), F.col("col0").alias("col")).alias("root"), F.col("component").cast("int").alias("component"))
    return joined.join(number, "root").select(*keys, "row", "col", "component")


def box_path(mask: np.ndarray, start: tuple[int, int], stop: tuple[int, int]) -> list[tuple[int, int]]:
    """A shortest 8-neighbour path in a dense mask, traced back from the stop over the least (row, column) before each
    cell; the stop cell alone without one."""
    if not mask[start]:
        return [stop]
    wide = np.zeros((mask.shape[0] + 2, mask.shape[1] + 2), bool)
    wide[1:-1, 1:-1] = mask
    width = wide.shape[1]
    steps = np.full(wide.size, -1, np.int32)
    free = wide.reshape(-1)
    moves = np.array(sorted(i * width + j for i, j in EIGHT))
    front = np.array([(start[0] + 1) * width + start[1] + 1])
    goal, k = (stop[0] + 1) * width + stop[1] + 1, 0
    steps[front] = 0
    while len(front) and steps[goal] < 0:
        k += 1
        near = np.unique(front[:, None] + moves)
        front = near[free[near] & (steps[near] < 0)]
        steps[front] = k
    if steps[goal] < 0:
        return [stop]
    path = [goal]
    for k in range(steps[goal] - 1, -1, -1):
        before = path[-1] + moves  # in row-major order
        path.append(int(before[steps[before] == k][0]))
    return [(at // width - 1, at % width - 1) for at in reversed(path)]


def packed_tiles(cells: DataFrame, side: int, wanted: DataFrame) -> DataFrame:
    """(ty, tx, bits): the cells of each square of the mask that is ``wanted`` (ty, tx) as side x side bits, row by row."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        a = np.zeros((side, side), bool)
        a[table["row"].to_numpy() - key[0].as_py() * side, table["col"].to_numpy() - key[1].as_py() * side] = True
        return pa.table({"ty": pa.array([key[0].as_py()], pa.int32()), "tx": pa.array([key[1].as_py()], pa.int32()), "bits": pa.array([np.packbits(a).tobytes()], pa.binary())})

    tile = lambda v: F.floor(F.col(v) / side).cast("int")
    placed = cells.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).where("row IS NOT NULL AND col IS NOT NULL")
    mine = placed.withColumn("ty", tile("row")).withColumn("tx", tile("col")).join(wanted.select("ty", "tx").distinct(), ["ty", "tx"], "left_semi")
    return mine.groupBy("ty", "tx").applyInArrow(run, "ty int, tx int, bits binary")


def shortest_paths(cells: DataFrame, pairs: DataFrame, box_cells: int | None = None) -> DataFrame:
    """(pair_id, step, row, col): a shortest 8-neighbour path for each pair inside the box of its ends; without one, the
    stop cell alone. pairs has pair_id (long, unique), r0, c0, r1, c1. Of paths of one length the one whose cells, from the
    stop back, are least by (row, column) is given. A stop outside the mask is reached by none.

    The mask is packed into tiles of a bit a cell. Pairs whose boxes begin in one square, as large as they are, and hold
    BOX_CELLS cells or fewer are searched together: the tiles that any of them touches come to their task once. So no
    cell is copied for a pair, and a path takes no round, however long. Pairs of larger boxes advance together, a step
    a round over all tasks, until no front is left.
    """
    most, side = BOX_CELLS if box_cells is None else box_cells, TILE
    p = pairs.select(F.col("pair_id").cast("long").alias("pair_id"), *[F.col(c).cast("int").alias(c) for c in ("r0", "c0", "r1", "c1")]).withColumns({"a": F.least("r0", "r1"), "b": F.greatest("r0", "r1"), "c": F.least("c0", "c1"), "d": F.greatest("c0", "c1")})
    tall, broad = F.col("b") - F.col("a") + 1, F.col("d") - F.col("c") + 1
    area = tall.cast("long") * broad
    small, large = p.where(area <= most), p.where(area > most)
    # squares of the least power of two that the box fits into, no smaller than a tile
    square = F.greatest(F.lit(float(side)), F.pow(F.lit(2.0), F.length(F.bin((F.greatest(tall, broad) - 1).cast("long"))))).cast("long")
    small = small.withColumn("size", square).withColumn("gy", F.floor(F.col("a") / F.col("size"))).withColumn("gx", F.floor(F.col("c") / F.col("size")))
    group = ["size", "gy", "gx", "part"]
    counts = small.groupBy(*group[:3]).agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("parts"))
    small = small.join(counts, group[:3]).withColumn("part", F.pmod(F.xxhash64("pair_id"), F.col("parts")).cast("int")).select(*group, "pair_id", "r0", "c0", "r1", "c1", "a", "b", "c", "d")
    span = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / side).cast("int"), F.floor(F.col(high) / side).cast("int")))
    touched = small.select(*group, "a", "b", "c", "d").withColumn("ty", span("a", "b")).withColumn("tx", span("c", "d")).select(*group, "ty", "tx").distinct()
    tiles = touched.join(packed_tiles(cells, side, touched), ["ty", "tx"]).select(*group, "ty", "tx", "bits").toDF(*group, "ty", "tx", "bits")

    def run(key: tuple, mine: pa.Table, near: pa.Table) -> pa.Table:
        bits = {(y, x): b for y, x, b in zip(*(near[c].to_pylist() for c in ("ty", "tx", "bits")), strict=True)}
        out = []
        for pair, r0, c0, r1, c1 in zip(*(mine[c].to_pylist() for c in ("pair_id", "r0", "c0", "r1", "c1")), strict=True):
            a, c = min(r0, r1), min(c0, c1)
            grid = np.zeros((abs(r0 - r1) + 1, abs(c0 - c1) + 1), bool)
            for y in range(a // side, (a + grid.shape[0] - 1) // side + 1):
                for x in range(c // side, (c + grid.shape[1] - 1) // side + 1):
                    if (y, x) in bits:
                        tile = np.unpackbits(np.frombuffer(bits[y, x], np.uint8), count=side * side).reshape(side, side).astype(bool)
                        top, left = y * side - a, x * side - c  # the tile's place in the grid
                        i, j = max(top, 0), max(left, 0)
                        part = tile[i - top : grid.shape[0] - top, j - left : grid.shape[1] - left]
                        grid[i : i + part.shape[0], j : j + part.shape[1]] = part
            path = np.array(box_path(grid, (r0 - a, c0 - c), (r1 - a, c1 - c)))
            out.append(np.column_stack([np.full(len(path), pair), np.arange(len(path)), path[:, 0] + a, path[:, 1] + c]))
        found = np.concatenate(out) if out else np.zeros((0, 4), np.int64)
        return pa.table({"pair_id": found[:, 0], **{n: found[:, i].astype(np.int32) for i, n in enumerate(("step", "row", "col"), 1)}})

    done = small.groupBy(*group).cogroup(tiles.groupBy(*group)).applyInArrow(run, "pair_id long, step int, row int, col int")
    if large.isEmpty():
        return done
    mask = cells.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).distinct()
    return done.unionByName(_paths_together(mask, large).select("pair_id", F.col("step").cast("int").alias("step"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")))


def _paths_together(mask: DataFrame, p: DataFrame) -> DataFrame:
    """shortest_paths of boxes of any size: a front a pair, grown by all tasks a step a round."""
    front = materialised(p.join(mask, (F.col("r0") == F.col("row")) & (F.col("c0") == F.col("col"))).select("pair_id", "row", "col", F.lit(0).alias("step")))
    seen = front
    box = p.select("pair_id", "a", "b", "c", "d", "r1", "c1")
    done = materialised(front.limit(0).select("pair_id"))
    k = 0
    while True:
        k += 1
        grown = front.join(done, "pair_id", "left_anti").join(box, "pair_id").withColumn("m", F.explode(_moves(EIGHT)))
        grown = grown.withColumn("row", F.col("row") + F.col("m.i")).withColumn("col", F.col("col") + F.col("m.j")).where("row BETWEEN a AND b AND col BETWEEN c AND d").select("pair_id", "row", "col").distinct()
        front = materialised(grown.join(mask, ["row", "col"], "left_semi").join(seen, ["pair_id", "row", "col"], "left_anti").select("pair_id", "row", "col", F.lit(k).alias("step")))
        if front.isEmpty():
            break
        seen = materialised(seen.unionByName(front))
        done = seen.join(box, "pair_id").where((F.col("row") == F.col("r1")) & (F.col("col") == F.col("c1"))).select("pair_id").distinct()
    at = materialised(p.join(seen.withColumnRenamed("pair_id", "_p"), (F.col("pair_id") == F.col("_p")) & (F.col("row") == F.col("r1")) & (F.col("col") == F.col("c1"))).select("pair_id", "row", "col", "step"))
    path = at
    while not at.where("step > 0").isEmpty():
        back = at.where("step > 0").withColumn("m", F.explode(_moves(EIGHT))).select("pair_id", (F.col("row") + F.col("m.i")).alias("row"), (F.col("col") + F.col("m.j")).alias("col"), (F.col("step") - 1).alias("step"))
        at = materialised(back.join(seen, ["pair_id", "row", "col", "step"]).groupBy("pair_id", "step").agg(F.min(F.struct("row", "col")).alias("x")).select("pair_id", F.col("x.row").alias("row"), F.col("x.col").alias("col"), "step"))
        path = materialised(path.unionByName(at))
    lone = p.join(path.select("pair_id").distinct(), "pair_id", "left_anti").select("pair_id", F.lit(0).alias("step"), F.col("r1").alias("row"), F.col("c1").alias("col"))
    return path.select("pair_id", "step", "row", "col").unionByName(lone)


def last_of_routes(pairs: DataFrame) -> DataFrame:
    """The last pair (by pair_id) of each route: pairs of equal ends have one path, on which the last of them wins."""
    ends = ["r0", "c0", "r1", "c1"]
    return pairs.groupBy(*ends).agg(F.max("pair_id").alias("pair_id")).select("pair_id", *ends)


def segment_burn(paths: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells with the segment of the last pair whose path crosses them, segments with the value of their last pair).
    pairs has pair_id (in order), seg_id, pci; the paths of the last pair of each route are enough (last_of_routes)."""
    j = paths.join(pairs.select("pair_id", "seg_id", "pci"), "pair_id")
    return j.groupBy("row", "col").agg(F.max_by("seg_id", "pair_id").alias("seg_id")), pairs.groupBy("seg_id").agg(F.max_by("pci", "pair_id").alias("pci"))


def extract_instances(labels: DataFrame, pixels: DataFrame | None = None, eight: bool = False) -> DataFrame:
    """The cells of every connected area of values above 0 with its ``component``; with pixels, the image's columns
    inside it too (null where the image has no such cell)."""
    found = connected_components(labels.where("value > 0"), eight)
    return found if pixels is None else found.join(pixels, ["row", "col"], "left")


def process_labeled_image(labels: DataFrame, pixels: DataFrame, lut: DataFrame | None = None, radius: int = 1, height: int | None = None, width: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(regions, region pixels). Each class above 0 is grown by a disk. Without a lookup every 8-connected component of
    the grown class is a region with the pixels of the grown cells; with one, the class is a region with the box of
    the grown and the pixels of the given cells. Regions without any valid pixel go."""
    own = labels.where("value > 0").select("row", "col", F.col("value").alias("label"))
    moves = _moves(disk(radius))
    grown = own.withColumn("_m", F.explode(moves)).select("label", (F.col("row") + F.col("_m.i")).alias("row"), (F.col("col") + F.col("_m.j")).alias("col")).distinct()
    if height is not None:
        grown = grown.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))
    if lut is None:
        parts = connected_components(grown, True, by="label")
        key = parts.withColumn("region", F.concat_ws("-", F.col("label").cast("long"), "component"))
        boxes = bounding_boxes(key.select(F.col("region").alias("value"), "row", "col")).withColumnRenamed("value", "region")
        regions = key.select("region", "label").distinct().join(boxes, "region").withColumn("seg_id", F.lit("unknown"))
        members = key.select("region", "row", "col")
    else:
        boxes = bounding_boxes(grown.select(F.col("label").alias("value"), "row", "col")).withColumnRenamed("value", "label")
        found = own.select("label").distinct().join(lut.select(F.col("seg_id").cast("double").alias("label"), "pci"), "label", "left")
        regions = found.join(boxes, "label").select(F.col("label").cast("long").cast("string").alias("region"), F.col("label").cast("long").cast("string").alias("seg_id"), F.col("pci").alias("label"), "min_row", "min_col", "max_row", "max_col")
        members = own.select(F.col("label").cast("long").cast("string").alias("region"), "row", "col")
    inside = members.join(pixels, ["row", "col"])
    valid = F.exists("bands", lambda x: x.isNotNull() & ~F.isnan(x))
    live = inside.where(valid).select("region").distinct()
    return regions.join(live, "region", "left_semi"), inside.join(live, "region", "left_semi")

