"""Dense tiles: cell tables cut into squares that carry a border of their neighbours' cells, one vectorised task a tile.

A cell is sent to its own tile and to those whose border it lies in, so what is shuffled exceeds the cells by the tiles'
borders only, however large the neighbourhood that an operator looks at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Side of the tiles, without their borders.
SIDE = 256


@dataclass
class Block:
    """A tile with its border: ``there`` marks the cells given, ``values`` holds their numbers (NaN for null and missing
    ones), ``image`` the cells that lie in the image. Array place (0, 0) is the cell (top, left)."""

    top: int
    left: int
    reach: int
    there: np.ndarray
    image: np.ndarray
    values: dict[str, np.ndarray]

    def inner(self, a: np.ndarray) -> np.ndarray:
        return a[self.reach : a.shape[0] - self.reach, self.reach : a.shape[1] - self.reach]

    def rows(self, keep: np.ndarray, **columns: np.ndarray) -> pa.Table:
        """The tile's own cells where ``keep`` holds, with the given arrays as columns (NaN as null)."""
        r, c = np.nonzero(self.inner(keep))
        found = {"row": pa.array((r + self.top + self.reach).astype(np.int32)), "col": pa.array((c + self.left + self.reach).astype(np.int32))}
        for name, a in columns.items():
            found[name] = pa.array(self.inner(a)[r, c], from_pandas=True)
        return pa.table(found)


def places(v: str, reach: int, side: int) -> Column:
    """The numbers of the tiles that a row or column number lies in or beside, as an array."""
    at = lambda off: F.floor((F.col(v) + off) / side).cast("int")
    return F.sequence(at(-reach), at(reach))


def spread(cells: DataFrame, reach: int, side: int, height: int | None = None, width: int | None = None) -> DataFrame:
    """cells once for each tile (``_ty``, ``_tx``) that they lie in or within ``reach`` of; tiles outside an image of the
    given height and width get none."""
    for name, v, n in (("_ty", "row", height), ("_tx", "col", width)):
        cells = cells.withColumn(name, F.explode(places(v, reach, side)))
        if n is not None:
            cells = cells.where(F.col(name).between(0, (n - 1) // side))
    return cells


def on_tiles(cells: DataFrame, reach: int, run: Callable[[Block], pa.Table], schema: str, *, values: tuple[str, ...] = (), height: int | None = None, width: int | None = None, side: int | None = None) -> DataFrame:
    """The rows that ``run`` gives for every tile that a cell lies in or beside. Cells with a null row or column are left
    out; of repeated cells the one of smallest value is taken. Without height and width the image has no end."""
    side = side or SIDE
    c = cells.select("row", "col", *[F.col(v).cast("double").alias(v) for v in values]).where("row IS NOT NULL AND col IS NOT NULL")
    dealt = spread(c, reach, side, height, width)

    def task(key: tuple, table: pa.Table) -> pa.Table:
        top, left = key[0].as_py() * side - reach, key[1].as_py() * side - reach
        n = side + 2 * reach
        r, k = table["row"].to_numpy().astype(np.int64) - top, table["col"].to_numpy().astype(np.int64) - left
        there = np.zeros((n, n), bool)
        there[r, k] = True
        held = {}
        for v in values:
            x = table[v].to_numpy()
            order = np.argsort(-x, kind="stable")  # the smallest is written last, NaN before it
            order = np.concatenate([order[np.isnan(x[order])], order[~np.isnan(x[order])]])
            held[v] = np.full((n, n), np.nan)
            held[v][r[order], k[order]] = x[order]
        image = np.ones((n, n), bool)
        if height is not None:
            i, j = np.arange(top, top + n), np.arange(left, left + n)
            image = ((i >= 0) & (i < height))[:, None] & ((j >= 0) & (j < width))[None, :]
        return run(Block(top, left, reach, there, image, held))

    return dealt.groupBy("_ty", "_tx").applyInArrow(task, schema)


# --- windows over a dense array ----------------------------------------------------------------------------------
def shifted(a: np.ndarray, i: int, j: int, fill) -> np.ndarray:
    """a moved by i rows and j columns; ``fill`` where nothing comes from."""
    out = np.full_like(a, fill)
    h, w = a.shape
    if abs(i) < h and abs(j) < w:
        out[max(i, 0) : h + min(i, 0), max(j, 0) : w + min(j, 0)] = a[max(-i, 0) : h - max(i, 0), max(-j, 0) : w - max(j, 0)]
    return out


def row_runs(offsets: Iterable[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(row offset, first column offset, length) of the runs that a set of offsets consists of."""
    out: list[tuple[int, int, int]] = []
    for i, j in sorted(set(offsets)):
        if out and out[-1][0] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (i, out[-1][1], out[-1][2] + 1)
        else:
            out.append((i, j, 1))
    return out


def windowed(a: np.ndarray, offsets: list[tuple[int, int]], join: np.ufunc, fill) -> np.ndarray:
    """``join`` (minimum, maximum, logical or) of a at x - offset over all offsets; beyond a there is ``fill``. A run of a row's offsets is joined
    from two windows of a power of two, so the work follows the rows of the element and not its cells."""
    runs = row_runs(offsets)
    powers = [a]
    while 2 ** len(powers) <= max((n for _, _, n in runs), default=1):
        step = 2 ** (len(powers) - 1)
        powers.append(join(powers[-1], shifted(powers[-1], 0, step, fill)))
    out = None
    for i, j, n in runs:
        k = n.bit_length() - 1
        run = join(powers[k], shifted(powers[k], 0, n - 2**k, fill)) if n > 2**k else powers[k]
        moved = shifted(run, i, j, fill)
        out = moved if out is None else join(out, moved)
    return a if out is None else out


def reach_of(offsets: Iterable[tuple[int, int]]) -> int:
    return max((max(abs(i), abs(j)) for i, j in offsets), default=0)


def weighted(a: np.ndarray, weights: dict[tuple[int, int], float]) -> np.ndarray:
    """Sum of weight * a at x + offset; NaN where one of them is."""
    out = np.zeros_like(a)
    for (i, j), w in weights.items():
        out += w * shifted(a, -i, -j, np.nan)
    return out
