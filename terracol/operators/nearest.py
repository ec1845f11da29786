"""Nearest rows of another table by parts of equal counts: no task holds more than its part, however dense a spot is.

The right side is sorted along a Z-order curve and cut into parts of about equal counts, each with the box around its
rows. A row of left first asks the part whose box is nearest, then those whose boxes lie no farther than what it found.
Parts that many rows ask are dealt out to several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, NumericType, StructField, StructType

from terracol.functions.session import materialised

#: Rows of right that make a part, and the least rows of left that a task answers.
PART_ROWS, ASKED_ROWS = 200_000, 20_000
#: Rows of left a place, on average, from which places are asked once and joined back; places that are sent to every task.
REPEATED, BROADCAST_PLACES = 2, 100_000
#: Bits of a place along each axis of the curve, and distances that are held at a time.
CURVE_BITS, HELD = 20, 1 << 20


def _spread_bits(v: Column) -> Column:
    """A number of CURVE_BITS bits with a 0 after each."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def z_order(x: Column, y: Column, extent: tuple[float, float, float, float]) -> Column:
    """The place of (x, y) along a Z-order curve over the extent (x0, x1, y0, y1)."""

    def cell(v: Column, low: float, high: float) -> Column:
        top = (1 << CURVE_BITS) - 1
        share = (v - F.lit(low)) / F.lit(high - low) * F.lit(float(1 << CURVE_BITS)) if high > low else F.lit(0.0)
        return F.least(F.greatest(F.floor(share), F.lit(0)), F.lit(top)).cast("long")

    x0, x1, y0, y1 = extent
    return _spread_bits(cell(x, x0, x1)).bitwiseOR(F.shiftleft(_spread_bits(cell(y, y0, y1)), 1))


class Blocks:
    """Places in blocks along a local curve, with the box around each; equal places count as the one of least rank."""

    def __init__(self, x: np.ndarray, y: np.ndarray, order: list[np.ndarray]):
        rank = np.empty(len(x), np.int64)
        rank[np.lexsort(order[::-1])] = np.arange(len(x))
        at = np.lexsort((rank, y, x))
        at = at[np.concatenate([[True], (x[at][1:] != x[at][:-1]) | (y[at][1:] != y[at][:-1])])]
        code = np.zeros(len(at), np.int64)
        for v, shift in ((x[at], 0), (y[at], 1)):
            span = v.max() - v.min()
            cell = np.minimum((v - v.min()) / span * 1024, 1023).astype(np.int64) if span > 0 and np.isfinite(span) else np.zeros(len(v), np.int64)
            for bit in range(10):
                code |= ((cell >> bit) & 1) << (2 * bit + shift)
        at = at[np.argsort(code, kind="stable")]
        self.size = max(16, int(len(at) ** 0.5))
        first = np.arange(0, len(at), self.size)
        within = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(at))))
        at = at[np.lexsort((rank[at], within))]
        self.at, self.x, self.y, self.rank, self.first = at, x[at], y[at], rank[at], first
        self.box = [f.reduceat(v, first) for v in (self.x, self.y) for f in (np.minimum, np.maximum)]

    def nearest(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place the row nearest to it, ties to the least rank, and its squared distance."""
        found, apart = np.empty(len(x), np.int64), np.empty(len(x))
        step = max(1, HELD // max(len(self.first), self.size))
        for i in range(0, len(x), step):
            found[i : i + step], apart[i : i + step] = self._some(x[i : i + step], y[i : i + step])
        return found, apart

    def _some(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        least = box_distance(x[:, None], y[:, None], *self.box)
        home = least.argmin(axis=1)
        place, apart = self._in_blocks(x, y, home)
        least[np.arange(len(x)), home] = np.inf
        row, block = np.nonzero(least <= apart[:, None])
        for a in range(0, len(row), max(1, HELD // self.size)):
            r, b = row[a : a + HELD // self.size], block[a : a + HELD // self.size]
            p, d = self._in_blocks(x[r], y[r], b)
            who = np.concatenate([np.arange(len(x)), r])
            places, d2 = np.concatenate([place, p]), np.concatenate([apart, d])
            best = np.lexsort((self.rank[places], d2, who))
            best = best[np.concatenate([[True], who[best][1:] != who[best][:-1]])]
            place, apart = places[best], d2[best]
        return self.at[place], apart

    def _in_blocks(self, x: np.ndarray, y: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        places = self.first[block][:, None] + np.arange(self.size)
        inside = places < len(self.x)
        places = np.minimum(places, len(self.x) - 1)
        dx, dy = x[:, None] - self.x[places], y[:, None] - self.y[places]
        d2 = np.where(inside, dx * dx + dy * dy, np.inf)
        k = d2.argmin(axis=1)  # within a block the least rank comes first
        every = np.arange(len(x))
        return places[every, k], d2[every, k]


def box_distance(x, y, x0, x1, y0, y1) -> np.ndarray:
    """Squared distance of places to boxes; never above that of a place in the box, rounding included."""
    dx, dy = np.maximum(np.maximum(x0 - x, x - x1), 0), np.maximum(np.maximum(y0 - y, y - y1), 0)
    return dx * dx + dy * dy


def nearest(left: DataFrame, right: DataFrame, key: str, order: list[str], *, lx: str = "lx", ly: str = "ly", rx: str = "rx", ry: str = "ry") -> DataFrame:
    """For each row of left (identified by ``key``) the nearest row of right, ties to the least of ``order`` (columns of
    numbers): left's columns, right's columns and ``d2``. Column names must not clash. Rows without a place take no part;
    an empty side gives an empty result. Where rows share places, a place is asked once, and gives its
    least row only. What reaches the driver
    is the box of each part, as many as there are shuffle partitions at most."""
    if not all(isinstance(right.schema[c].dataType, NumericType) for c in order):
        raise TypeError("order must be columns of numbers")
    placed = lambda df, x, y: df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double")))
    left, right = placed(left, lx, ly), placed(right, rx, ry)
    rows = left.agg(F.count("*").alias("rows"), F.approx_count_distinct(F.xxhash64(lx, ly)).alias("places")).first()
    if rows["rows"] < REPEATED * rows["places"]:
        return _nearest(left, right, [key], order, lx, ly, rx, ry)
    found = materialised(_nearest(left.select(lx, ly).distinct(), right, [lx, ly], order, lx, ly, rx, ry))
    few = found.count() <= BROADCAST_PLACES
    return left.join(F.broadcast(found) if few else found, [lx, ly]).select(*left.columns, *right.columns, "d2")


def _nearest(left: DataFrame, right: DataFrame, key: list[str], order: list[str], lx: str, ly: str, rx: str, ry: str) -> DataFrame:
    """nearest of rows that all have a place; ``key``: the columns that identify left's rows."""
    spark = left.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    extent = right.agg(F.min(rx), F.max(rx), F.min(ry), F.max(ry), F.count("*"), F.approx_count_distinct(F.xxhash64(rx, ry))).first()
    if not extent[4]:
        return left.join(right, F.lit(False)).withColumn("d2", F.lit(0.0))
    if extent[4] >= REPEATED * extent[5]:
        least = F.min_by(F.struct(*right.columns), F.struct(*order))
        right = materialised(right.groupBy(rx, ry).agg(least.alias("_b")).select("_b.*"))
        extent = (*extent[:4], right.count())
    n = min(parts, -(-extent[4] // PART_ROWS))
    if n == 1:
        dealt = right.withColumn("_part", F.lit(0))
    else:
        coded = right.withColumn("_z", z_order(F.col(rx).cast("double"), F.col(ry).cast("double"), tuple(map(float, extent[:4]))))
        # rows of one place are many at times: the hash keeps a range from ending in them
        dealt = materialised(coded.repartitionByRange(n, "_z", F.xxhash64(*order)).drop("_z").withColumn("_part", F.spark_partition_id()))
    boxes = dealt.groupBy("_part").agg(F.min(rx).alias("x0"), F.max(rx).alias("x1"), F.min(ry).alias("y0"), F.max(ry).alias("y1"), F.count("*").alias("rows")).orderBy("_part").collect()
    number = np.array([b["_part"] for b in boxes])
    box = [np.array([float(b[c]) for b in boxes]) for c in ("x0", "x1", "y0", "y1")]
    rows = {b["_part"]: b["rows"] for b in boxes}
    asked = left
    if len(boxes) == 1:
        asked = asked.withColumn("_part", F.lit(int(number[0])))
    else:
        asked = _with_parts(left, lx, ly, lambda x, y, best: (np.arange(len(x)), number[box_distance(x[:, None], y[:, None], *box).argmin(axis=1)]))
    first = _answer(asked, dealt, rows, order, lx, ly, rx, ry)
    if len(boxes) == 1:
        return first.drop("_part")
    first = materialised(first)

    def others(x: np.ndarray, y: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best, home = rest
        i, j = np.nonzero((box_distance(x[:, None], y[:, None], *box) <= best[:, None]) & (number[None, :] != home[:, None]))
        return i, number[j]

    more = _with_parts(first.select(*left.columns, "d2", F.col("_part").alias("_home")), lx, ly, others, "d2", "_home").drop("d2", "_home")
    second = materialised(_answer(materialised(more), dealt, rows, order, lx, ly, rx, ry).drop("_part"))
    first = first.drop("_part")
    again = second.select(*key).distinct()
    both = first.join(again, key, "left_semi").unionByName(second)
    best = both.groupBy(*key).agg(F.min_by(F.struct(*both.columns), F.struct("d2", *order)).alias("_b")).select("_b.*")
    return first.join(again, key, "left_anti").unionByName(best)


def _with_parts(left: DataFrame, lx: str, ly: str, choose, *more: str) -> DataFrame:
    """left's rows once for each part (``_part``) that ``choose`` gives for its places and the columns ``more``."""
    names = left.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                x, y, *rest = (b.column(names.index(c)).to_numpy(zero_copy_only=False).astype(float) for c in (lx, ly, *more))
                i, part = choose(x, y, rest)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(i)) for c in b.columns), pa.array(part.astype(np.int32))], names=[*names, "_part"])

    return left.mapInArrow(run, StructType([*left.schema.fields, StructField("_part", IntegerType())]))


def _answer(asked: DataFrame, dealt: DataFrame, rows: dict[int, int], order: list[str], lx: str, ly: str, rx: str, ry: str) -> DataFrame:
    """The rows of ``asked`` with the nearest row of their part. A part is given to as many tasks as its askers ask for,
    four times its own rows to each at least, so that what is sent twice stays a share of what asks."""
    spark = asked.sparkSession
    asks = asked.groupBy("_part").agg(F.count("*").alias("n")).collect()  # a row a part
    tasks = {r["_part"]: max(1, -(-r["n"] // max(ASKED_ROWS, 4 * rows[r["_part"]]))) for r in asks}
    copies = spark.createDataFrame([(p, k) for p, k in tasks.items()], "_part int, _copies int")
    mine, theirs = [c for c in asked.columns if c != "_part"], [c for c in dealt.columns if c != "_part"]
    given = dealt.join(F.broadcast(copies), "_part").withColumn("_task", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).withColumn("_kind", F.lit(0)).drop("_copies")
    asking = asked.join(F.broadcast(copies), "_part").withColumn("_task", F.pmod(F.xxhash64(*mine), F.col("_copies")).cast("int")).withColumn("_kind", F.lit(1)).drop("_copies")
    every = given.unionByName(asking, allowMissingColumns=True).select("_part", "_task", "_kind", *mine, *theirs)
    ready = every.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_part", "_task").sortWithinPartitions("_part", "_task", "_kind")
    names, kept = every.columns, asked.columns
    schema = StructType([*asked.schema.fields, *[f for f in dealt.schema.fields if f.name != "_part"], StructField("d2", DoubleType())])
    numbers = lambda b, c: b.column(names.index(c)).to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, blocks, known = None, [], None, None
        for b in batches:
            group = np.stack([numbers(b, c) for c in ("_part", "_task", "_kind")], axis=1)
            cut = [0, *(np.flatnonzero(np.any(group[1:] != group[:-1], axis=1)) + 1).tolist(), b.num_rows]
            for i, j in zip(cut, cut[1:], strict=False):
                if i == j:
                    continue
                part, task, kind = group[i].tolist()
                if (part, task) != now:
                    now, held, blocks = (part, task), [], None
                piece = b.slice(i, j - i)
                if kind == 0:
                    held.append(piece)
                    continue
                if not held:
                    continue
                if blocks is None:
                    known = pa.Table.from_batches(held).combine_chunks()
                    column = lambda c, t=known: t[c].to_numpy()
                    blocks = Blocks(column(rx).astype(float), column(ry).astype(float), [column(c) for c in order])
                found, d2 = blocks.nearest(numbers(piece, lx).astype(float), numbers(piece, ly).astype(float))
                best = known.select(theirs).take(pa.array(found)).combine_chunks()
                arrays = [piece.column(names.index(c)) for c in kept] + [best[c].chunk(0) for c in theirs] + [pa.array(d2)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *theirs, "d2"])

    return ready.mapInArrow(run, schema)
