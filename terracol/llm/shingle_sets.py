"""Word-shingle sets: their SimHash, MinHash cells that bring similar sets together, and the exact Jaccard check.

A set's cells are BANDS hashes of ROWS minima each. Two sets of Jaccard similarity s share a cell with probability
1 - (1 - s^ROWS)^BANDS: all but 7 in 100,000 pairs at 0.8, and more above.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, bounded_batches, shuffle_partitions, slices, utf8

SEED = 42
BANDS, ROWS = 24, 5
#: Rows of a cell that one task compares with each other; larger cells are dealt out as pairs of such parts.
CELL_ROWS = 512
#: Hashes of a cell's sets that one task compares with each other; heavier cells are dealt out alike.
CELL_HASHES = 1 << 19
_rng = np.random.default_rng(SEED)
_FLIP = _rng.integers(0, 1 << 64, (BANDS * ROWS, 1), dtype=np.uint64)
_TIMES = _rng.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """64-bit hash of each word shingle of a lower-cased text; a text of fewer words is one shingle, none has none."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(parts) - words + 1)
    ends = ends[words - 1 :] if len(parts) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends.tolist(), strict=True)], dtype=np.uint64)


def set_id(hashes: np.ndarray) -> int:
    """A set's 64-bit hash as a signed long; 0 for the empty set."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64)) if len(hashes) else 0


def majority_bits(hashes: np.ndarray) -> int:
    """64-bit SimHash: the bits that over half of the hashes have; 0 without hashes."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def set_cells(hashes: np.ndarray) -> list[int]:
    """The BANDS cells of a set; none for the empty set."""
    if not len(hashes):
        return []
    low = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(hashes), 1 << 10):
        np.minimum(low, ((hashes[at : at + (1 << 10)] ^ _FLIP) * _TIMES).min(axis=1), out=low)
    raw, step = low.tobytes(), 8 * ROWS
    return np.array([xxhash.xxh64_intdigest(raw[k * step : (k + 1) * step], k) for k in range(BANDS)], dtype=np.uint64).view(np.int64).tolist()


def with_cells(docs: DataFrame, *, text: str, words: int) -> DataFrame:
    """doc_id, ``text_hash``, ``fp`` (the hash of the text's shingle set), ``simhash`` (the set's SimHash) and ``cells``
    of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [np.unique(shingle_hashes(t, words)) for t in part.column(2).to_pylist()]
            bits = np.array([majority_bits(x) for x in sets], dtype=np.uint64).view(np.int64)
            yield batch(doc_id=part.column(0), text_hash=part.column(1), fp=pa.array([set_id(x) for x in sets], pa.int64()), simhash=pa.array(bits), cells=pa.array([set_cells(x) for x in sets], pa.list_(pa.int64())))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(utf8(text)).alias("text_hash"), utf8(text).alias("b")).mapInArrow(run, "doc_id long, text_hash long, fp long, simhash long, cells array<long>")


def with_sets(docs: DataFrame, *, text: str, words: int) -> DataFrame:
    """``node`` (the hash of the shingle set), ``n`` (its size) and ``hashes`` (the sorted set) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            sets = [np.unique(shingle_hashes(t, words)) for t in part.column(0).to_pylist()]
            yield batch(node=pa.array([set_id(x) for x in sets], pa.int64()), n=pa.array([len(x) for x in sets], pa.int64()), hashes=pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())))

    return docs.select(utf8(text).alias("b")).mapInArrow(run, "node long, n long, hashes array<long>")


def verified_pairs(pairs: DataFrame, sets: DataFrame, jaccard: float) -> DataFrame:
    """The pairs (a, b) whose sets have at least this Jaccard similarity."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common / (F.size("x") + F.size("y") - common) >= F.lit(float(jaccard))).select("a", "b")


def _links(nodes: np.ndarray, group: np.ndarray, sets: list[np.ndarray], jaccard: float) -> list[tuple[int, int]]:
    """Links that join the groups of a cell's rows: every pair of rows not yet in one group is compared."""
    names, group, rows = np.unique(group, return_inverse=True, return_counts=True)
    if len(names) == 1:
        return []
    largest = int(np.argmax(rows))
    order = np.argsort(group == largest, kind="stable")
    nodes, group, sets = nodes[order], group[order], [sets[i] for i in order]
    n = np.array([len(x) for x in sets])
    off = np.concatenate([[0], np.cumsum(n)])
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    flag = np.zeros(len(values), np.int64)
    root = np.arange(len(names))
    out = []
    for i in range(min(len(nodes) - 1, len(nodes) - int(rows[largest]))):
        rest = root[group[i + 1 :]]
        if (rest == root[group[i]]).all():
            continue
        mine = codes[off[i] : off[i + 1]]
        flag[mine] = 1
        common = np.add.reduceat(flag[codes[off[i + 1] :]], off[i + 1 : -1] - off[i + 1])
        flag[mine] = 0
        for j in np.nonzero(common / (n[i] + n[i + 1 :] - common) >= jaccard)[0] + i + 1:
            a, b = root[group[i]], root[group[j]]
            if a != b:
                root[root == b] = a
                out.append((int(nodes[i]), int(nodes[j])))
    return out


def links_between(rows: DataFrame, sets: DataFrame, jaccard: float) -> DataFrame:
    """Edges (a, b) that join the components of a cell's nodes; rows has cell, node, component and the cell's ``rows``.

    Cells of more than CELL_ROWS rows, or CELL_HASHES hashes, are dealt into parts and every pair of parts is compared
    in a task of its own.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    weight = rows.join(sets.select("node", "n"), "node").groupBy("cell").agg(F.sum("n").alias("weight"))
    parts = F.greatest(F.ceil(F.col("rows") / CELL_ROWS), F.ceil(F.col("weight") / CELL_HASHES)).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = rows.join(weight, "cell").withColumn("parts", parts).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("node", "component", F.xxhash64("cell", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"))
    ready = dealt.join(sets.select("node", "hashes"), "node").select("cell", "node", "component", "hashes").repartition(shuffle_partitions(spark), "cell").sortWithinPartitions("cell", "node")

    def emit(held: list) -> pa.RecordBatch:
        found = _links(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), [s for x in held for s in x[2]], jaccard)
        return batch(a=pa.array([x for x, _ in found], pa.int64()), b=pa.array([y for _, y in found], pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for b in batches:
            if not b.num_rows:
                continue
            cell, node, component = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            sets_ = np.split(b.column(3).flatten().to_numpy(zero_copy_only=False), np.cumsum(b.column(3).value_lengths().to_numpy(zero_copy_only=False))[:-1])
            at = [0, *(np.nonzero(np.diff(cell))[0] + 1).tolist(), len(cell)]
            for i, j in zip(at, at[1:], strict=False):
                if held and cell[i] != now:
                    yield emit(held)
                    held = []
                now = cell[i]
                held.append((node[i:j], component[i:j], sets_[i:j]))
        if held:
            yield emit(held)

    return ready.mapInArrow(run, "a long, b long").distinct()
