"""Exact Euclidean distances on rasters: each cell's nearest source cell by two passes, along rows, then down columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of a band of rows or a strip of columns that one task holds, and the widest strip.
BAND_CELLS, STRIP = 1 << 22, 1024


def nearest_in_row(cols: np.ndarray, width: int) -> np.ndarray:
    """For each column the nearest of the source columns ``cols`` of one row; the left one of two equally near."""
    at = np.arange(width)
    left, right = np.full(width, -1), np.full(width, -1)
    left[cols] = right[cols] = cols
    left = np.maximum.accumulate(left)
    right = np.where(right < 0, 4 * width, right)
    right = np.minimum.accumulate(right[::-1])[::-1]
    return np.where((left >= 0) & ((right >= width) | (at - left <= right - at)), left, right)


class Envelope:
    """The lower envelopes of the parabolas that the rows of a strip raise over its columns, for all columns at once.

    ``rows`` are the rows with sources in ascending order, ``near`` (row, column) their sources' columns. For a column's
    k-th parabola ``of`` is its row's place and ``begin`` the first row where it is strictly below those before it, so of
    equally near sources the one of least row is found.
    """

    def __init__(self, rows: np.ndarray, near: np.ndarray, cols: np.ndarray):
        self.rows, self.near, m = rows, near, near.shape[1]
        apart = (near - cols) ** 2
        self.of, self.begin = np.zeros(near.shape, np.int32), np.zeros(near.shape, np.int64)
        self.begin[0] = -(1 << 62)
        self.last = np.zeros(m, np.int64)
        every = np.arange(m)
        for t in range(1, len(rows)):
            high, open_ = apart[t] + rows[t] ** 2, every
            start = np.zeros(m, np.int64)
            while len(open_):
                top = self.of[self.last[open_], open_]
                q = rows[top]
                start[open_] = (high[open_] - apart[top, open_] - q * q) // (2 * (rows[t] - q)) + 1
                open_ = open_[start[open_] <= self.begin[self.last[open_], open_]]
                self.last[open_] -= 1  # the top one is nowhere lowest
            self.last += 1
            self.of[self.last, every] = t
            self.begin[self.last, every] = start

    def nearest(self, column: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and column of the source nearest to the places (at, column); column counts within the strip."""
        n = self.last[column] + 1
        place = self.of[np.searchsorted(self.begin[:n, column], at, side="right") - 1, column]
        return self.rows[place], self.near[place, column]


def nearest_cells(wanted: DataFrame, sources: DataFrame, height: int, width: int) -> DataFrame:
    """(row, col, near_row, near_col, d2) of each wanted cell inside height x width: the source cell nearest to it, ties to
    the least (near_row, near_col), and its squared distance. Without sources there are no rows; repeated cells count
    once.

    Bands of rows find the nearest source in each row; what they find goes, packed by row, to strips of columns, which
    take the lower envelope of the rows' parabolas. Two shuffles; time and memory follow the cells of the image, not
    the distances and not how the sources crowd.
    """
    band, strip = max(1, BAND_CELLS // width), int(min(max(BAND_CELLS // height, 8), STRIP, width))
    inside = lambda df: df.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))

    def along(key: tuple, cells: pa.Table) -> pa.Table:
        r, c = cells["row"].to_numpy(), cells["col"].to_numpy()
        order = np.argsort(r, kind="stable")
        r, c = r[order], c[order]
        cut = [0, *(np.flatnonzero(np.diff(r)) + 1).tolist(), len(r)]
        out = []
        for i, j in zip(cut, cut[1:], strict=False):
            near = nearest_in_row(c[i:j], width).astype(np.int32)
            out += [(k, int(r[i]), near[k * strip : (k + 1) * strip].tobytes()) for k in range(-(-width // strip))]
        strips, rows, packed = zip(*out, strict=True)
        return pa.table({"_strip": pa.array(strips, pa.int32()), "row": pa.array(rows, pa.int32()), "near": pa.array(packed, pa.binary())})

    def down(key: tuple, cells: pa.Table, found: pa.Table) -> pa.Table:
        empty = {"row": np.zeros(0, np.int32), "col": np.zeros(0, np.int32), "near_row": np.zeros(0, np.int32), "near_col": np.zeros(0, np.int32), "d2": np.zeros(0, np.int64)}
        if not cells.num_rows or not found.num_rows:
            return pa.table(empty)
        first = key[0].as_py() * strip
        rows = found["row"].to_numpy()
        order = np.argsort(rows)
        near = np.stack([np.frombuffer(b, np.int32) for b in found["near"].to_pylist()]).astype(np.int64)[order]
        env = Envelope(rows[order].astype(np.int64), near, np.arange(first, first + near.shape[1]))
        r, c = cells["row"].to_numpy().astype(np.int64), cells["col"].to_numpy().astype(np.int64)
        r, c = np.unique(np.stack([r, c]), axis=1)
        near_row, near_col = np.empty_like(r), np.empty_like(c)
        order = np.argsort(c, kind="stable")
        cut = [0, *(np.flatnonzero(np.diff(c[order])) + 1).tolist(), len(c)]
        for i, j in zip(cut, cut[1:], strict=False):
            at = order[i:j]
            near_row[at], near_col[at] = env.nearest(int(c[at[0]]) - first, r[at])
        return pa.table({"row": r.astype(np.int32), "col": c.astype(np.int32), "near_row": near_row.astype(np.int32), "near_col": near_col.astype(np.int32), "d2": (r - near_row) ** 2 + (c - near_col) ** 2})

    rows = inside(sources).groupBy(F.floor(F.col("row") / band).alias("_band")).applyInArrow(along, "_strip int, row int, near binary")
    asked = inside(wanted).withColumn("_strip", F.floor(F.col("col") / strip).cast("int"))
    return asked.groupBy("_strip").cogroup(rows.groupBy("_strip")).applyInArrow(down, "row int, col int, near_row int, near_col int, d2 long")


def distance_transform(cells: DataFrame, height: int, width: int, off: DataFrame | None = None) -> DataFrame:
    """(row, col, distance): how far each cell is from the nearest place of the image that is not set; ``off`` names these
    places, if not all others are meant. Cells of an image that is set everywhere have none."""
    if off is None:
        spark = cells.sparkSession
        every = spark.range(height).select(F.col("id").cast("int").alias("row")).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
        off = every.join(cells.select("row", "col"), ["row", "col"], "left_anti")
    return nearest_cells(cells, off, height, width).select("row", "col", F.sqrt("d2").alias("distance"))
