"""Patches as one row each: aligned stacks of an image cut into overlapping squares, packed as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracol.operators.raster import patch_origins
from terracol.operators.tiles import SIDE


def positions(n: int, crop: int, step: int, low: int, high: int) -> list[tuple[int, int]]:
    """(number, start) of the patches along an axis of n cells that start in low ... high - 1: the regular ones, and where
    these leave a rest a last one at the end."""
    count = (n - crop) // step + 1
    out = [(k, k * step) for k in range(-(-low // step), min(count, -(-high // step)))]
    if (count - 1) * step + crop < n and low <= n - crop < high:
        out.append((count, n - crop))
    return out


def pack_patches(pixels: DataFrame, stacks: list[str], height: int, width: int, crop: int, overlap: float) -> DataFrame:
    """(patch_id, top, left, and each stack as crop x crop numbers, row by row) of the patches that tile_patches makes; null
    where the image has no cell. A patch without any cell has no row.

    A cell is sent to the tile that it lies in and to those before it whose patches reach it, once with all its stacks.
    """
    patch_origins(min(height, 4 * crop), min(width, 4 * crop), crop, overlap)  # the same errors
    step, side = int(crop * (1 - overlap)), SIDE
    if crop > height or crop > width:
        raise ValueError("the crop is larger than the image")
    ny, nx = (height - crop) // step + 1, (width - crop) // step + 1
    strip, rest_y = ny * nx, (ny - 1) * step + crop < height
    right = strip + (nx if rest_y else 0)
    number = lambda y, x: right + ny if y == ny and x == nx else strip + x if y == ny else right + y if x == nx else y * nx + x
    tiles = lambda v: F.sequence(F.greatest(F.floor((F.col(v) - crop + 1) / side), F.lit(0)).cast("int"), F.floor(F.col(v) / side).cast("int"))
    cells = pixels.select("row", "col", *[F.col(c).cast("double").alias(c) for c in stacks]).where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))
    dealt = cells.withColumn("_ty", F.explode(tiles("row"))).withColumn("_tx", F.explode(tiles("col")))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        y0, x0 = key[0].as_py() * side, key[1].as_py() * side
        r, c = table["row"].to_numpy() - y0, table["col"].to_numpy() - x0
        there = np.zeros((side + crop, side + crop), bool)
        there[r, c] = True
        dense = []
        for name in stacks:
            a = np.full(there.shape, np.nan)
            a[r, c] = table[name].to_numpy()
            dense.append(a)
        at = [(number(i, j), top, left) for i, top in positions(height, crop, step, y0, y0 + side) for j, left in positions(width, crop, step, x0, x0 + side)]
        at = [p for p in at if there[p[1] - y0 : p[1] - y0 + crop, p[2] - x0 : p[2] - x0 + crop].any()]
        ends = pa.array(np.arange(len(at) + 1, dtype=np.int32) * crop * crop)
        cut = lambda a: np.concatenate([np.zeros(0), *(a[t - y0 : t - y0 + crop, w - x0 : w - x0 + crop].reshape(-1) for _, t, w in at)])
        ints = lambda k: pa.array([p[k] for p in at], pa.int32())
        return pa.table({"patch_id": ints(0), "top": ints(1), "left": ints(2), **{n: pa.ListArray.from_arrays(ends, pa.array(cut(a), from_pandas=True)) for n, a in zip(stacks, dense, strict=True)}})

    return dealt.groupBy("_ty", "_tx").applyInArrow(run, "patch_id int, top int, left int, " + ", ".join(f"`{n}` array<double>" for n in stacks))


def unpack_patches(packed: DataFrame, stacks: list[str], crop: int) -> DataFrame:
    """A row for each cell of the patches that any stack has a number for: r, c and the stacks, with the other columns."""
    rest = [c for c in packed.columns if c not in stacks]
    zipped = packed.select(*rest, F.posexplode(F.arrays_zip(*stacks)).alias("_k", "_v"))
    cells = zipped.select(*rest, F.floor(F.col("_k") / crop).cast("int").alias("r"), (F.col("_k") % crop).alias("c"), *[F.col(f"_v.{n}").alias(n) for n in stacks])
    return cells.where(" OR ".join(f"`{n}` IS NOT NULL" for n in stacks))


#: How each form of a patch is made of it.
FORMS = {"same": lambda a: a, "flip_rows": lambda a: a[:, ::-1], "flip_cols": lambda a: a[:, :, ::-1], "turn_90": lambda a: np.rot90(a, 1, (1, 2)), "turn_180": lambda a: np.rot90(a, 2, (1, 2)), "turn_270": lambda a: np.rot90(a, 3, (1, 2))}


def augment_packed(packed: DataFrame, stacks: list[str], crop: int) -> DataFrame:
    """Each packed patch as it is, flipped both ways and turned (``op``), as augment_patches does: a row a patch and form."""
    rest = [c for c in packed.columns if c not in stacks]
    schema = packed.select(*rest, F.lit("").alias("op"), *stacks).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                for op, form in FORMS.items():
                    made = []
                    for n in stacks:
                        column = b.column(len(rest) + stacks.index(n))
                        a = form(column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, crop, crop))
                        made.append(pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * crop * crop), pa.array(a.reshape(-1), from_pandas=True)))
                    yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array([op] * b.num_rows), *made], names=schema.names)

    return packed.select(*rest, *stacks).mapInArrow(run, schema)
