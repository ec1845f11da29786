"""SimHash near-duplicates: fingerprints linked through a grid of segment bit counts.

Each 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments. The Manhattan distance of two such
vectors is at most their Hamming distance, so fingerprints at most 4 bits apart are at most 4 apart in the vector
space, and of b blocks of segments at least b - 4 have equal counts. The grid therefore has a cell for each choice of
b - 4 blocks and each value of their counts; candidates share a cell, are cut by the Manhattan distance, and are
verified by their Hamming distance. b follows the number of fingerprints, so that chance fills cells with few of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, bounded_batches, by_row_bits, discard, row_bits, shuffle_partitions, slices, unused, utf8, written
from .shingle_sets import links_between, majority_bits, shingle_hashes, verified_pairs, with_cells, with_sets

BITS = 4
#: Chance that two random two-bit segments have equal counts, and the cost of a pair as a share of a row's.
SAME_COUNT, PAIR_COST = 0.375, 0.02
#: Rows of a cell that one task compares with each other; larger cells are dealt out as pairs of such parts.
CELL_ROWS = 1024
_ODD = 0x5555555555555555


def text_fingerprint(text: bytes, words: int = 4) -> int:
    """64-bit SimHash of a lower-cased text's word shingles, repeats included; 0 without words."""
    return majority_bits(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, *, text: str = "text", words: int = 4) -> DataFrame:
    """doc_id, ``text_hash`` and ``fp``, the SimHash of the whole text as a signed long. Null and blank texts have fp 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = np.array([text_fingerprint(t, words) for t in part.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
            yield batch(doc_id=part.column(0), text_hash=part.column(1), fp=pa.array(found))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(utf8(text)).alias("text_hash"), utf8(text).alias("b")).mapInArrow(run, "doc_id long, text_hash long, fp long")


def segment_counts(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, two bits each."""
    half = F.shiftrightunsigned(fp, 1)
    odd = F.lit(_ODD)
    return F.shiftleft(fp.bitwiseAND(half).bitwiseAND(odd), 1).bitwiseOR(fp.bitwiseXOR(half).bitwiseAND(odd))


def grid_blocks(n: int, bits: int = BITS) -> int:
    """How many blocks the segments are cut into for n fingerprints: the number that makes a fingerprint cheapest. It
    costs a row in each of C(blocks, bits) grids and, PAIR_COST a piece, the others that chance puts into its cells."""

    def cost(blocks: int) -> float:
        by_chance = n * SAME_COUNT ** (32 * (blocks - bits) / blocks)
        return comb(blocks, bits) * (1 + PAIR_COST * by_chance)

    return min(range(bits + 2, 3 * bits + 1), key=cost)


def _masks(blocks: int, bits: int = BITS) -> list[int]:
    edges = [round(i * 32 / blocks) for i in range(blocks + 1)]
    block = [sum(3 << 2 * s for s in range(edges[i], edges[i + 1])) for i in range(blocks)]
    masks = [sum(block[i] for i in c) for c in combinations(range(blocks), blocks - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _links(fp: np.ndarray, cell: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by cell: each row and the first row of its cell that it is linked to through the cell's links."""
    n = len(fp)
    u = fp.view(np.uint64)
    label = np.arange(n)
    odd = np.uint64(_ODD)
    pair, one = u & (u >> np.uint64(1)) & odd, (u ^ (u >> np.uint64(1))) & odd  # segments with count 2 and with count 1
    active = np.arange(n)
    shift = 1
    pairs_a, pairs_b = [], []

    def settle():
        if not pairs_a:
            return
        a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
        pairs_a.clear()
        pairs_b.clear()
        while True:
            low = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            label[:] = label[label]
            if np.array_equal(before, label):
                return

    held = 0
    while True:
        active = active[active + shift < n]
        active = active[cell[active] == cell[active + shift]]
        if not len(active):
            break
        a, b = active, active + shift
        # Manhattan distance of the counts: 1 for a 1 against another count, 2 for a 2 against a 0
        apart = np.bitwise_count(one[a] ^ one[b]) + 2 * np.bitwise_count((pair[a] ^ pair[b]) & ~(one[a] | one[b]))
        near = apart <= bits
        a, b = a[near], b[near]
        same = np.bitwise_count(u[a] ^ u[b]) <= bits
        a, b = a[same], b[same]
        if len(a):
            pairs_a.append(a)
            pairs_b.append(b)
            held += len(a)
        if held > 1 << 20:
            settle()
            held = 0
        shift += 1
    settle()
    moved = np.nonzero(label != np.arange(n))[0]
    return moved, label[moved]


def link_fingerprints(nodes: DataFrame, bits: int = BITS, blocks: int | None = None) -> DataFrame:
    """Edges (a, b) between ``node`` ids of distinct ``fp``: a spanning forest of every grid cell's links.

    A cell of more than CELL_ROWS rows is dealt into parts by a hash of the fingerprint and every pair of parts is
    compared in a task of its own, so no task holds a whole hot cell and no link is lost. Inside a task only the
    links that join rows not yet joined leave it, at most one per row.
    """
    spark = nodes.sparkSession
    counts = segment_counts(F.col("fp"))
    masks = _masks(blocks or grid_blocks(nodes.count()))
    cells = nodes.select("node", "fp", F.posexplode(F.array(*[counts.bitwiseAND(F.lit(m)) for m in masks])).alias("grid", "cell"))
    sizes = cells.groupBy("grid", "cell").agg(F.count("*").alias("rows")).where("rows > 1")
    parts = F.ceil(F.col("rows") / CELL_ROWS).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = (
        cells.join(sizes, ["grid", "cell"])
        .withColumn("parts", parts)
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("node", "fp", F.xxhash64("grid", "cell", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"))
    )
    ready = dealt.repartition(shuffle_partitions(spark), "cell").sortWithinPartitions("cell", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            now = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            at = int(np.searchsorted(now[2], now[2][-1])) if len(now[2]) else 0
            rest = [x[at:] for x in now]
            if at:
                yield emit([x[:at] for x in now])
        if rest is not None and len(rest[0]):
            yield emit(rest)

    def emit(x: list[np.ndarray]) -> pa.RecordBatch:
        at, to = _links(x[1].copy(), x[2], bits)
        return batch(a=pa.array(x[0][to]), b=pa.array(x[0][at]))

    return ready.mapInArrow(run, "a long, b long").where("a <> b").distinct()


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over the edges, for every node.

    Each round every node takes the smallest label beside it, labels are followed one step further, and edges are
    redrawn between labels; edges inside one label go. Rounds are written to the shared folder, where the next one
    replaces them; they end when no edge is left. Only edges and the labels of linked nodes move, never to the driver.
    """
    edges = written(edges)
    labels = None
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        beside = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("to")))
        onward = beside.select(F.col("node").alias("to"), F.col("to").alias("next"))
        low = written(beside.join(onward, "to", "left").select("node", F.coalesce("next", "to").alias("to")))
        done = [beside, low, edges]
        if labels is None:
            labels = written(low.select("node", F.col("to").alias("component")))
        else:
            done.append(labels)
            step = low.select(F.col("node").alias("component"), "to")
            labels = written(labels.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component")))
        a, b = low.select(F.col("node").alias("a"), F.col("to").alias("x")), low.select(F.col("node").alias("b"), F.col("to").alias("y"))
        edges = written(edges.join(a, "a").join(b, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct())
        discard(*done)
    discard(edges)
    if labels is None:
        return nodes.select("node", F.col("node").alias("component"))
    return nodes.select("node").join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def near_duplicates(docs: DataFrame, *, text: str = "text", words: int = 5, jaccard: float = 0.8) -> DataFrame:
    """One row per document: doc_id, ``fp`` (long, the hash of its set of word shingles) and ``component_id``, the
    smallest doc_id reachable over links of documents whose sets have at least this Jaccard similarity.

    The sets' SimHashes are linked through the grid, and each set is compared with the first one of its fingerprint's
    component. A few bits cannot tell 0.8, so what these links leave apart is brought together by MinHash cells (see
    shingle_sets, which states the share of pairs at 0.8 that share none). Every link is checked exactly. First the
    members of each cell are compared with its first one, then what the components of these links leave apart in a
    cell is compared pair by pair. Equal sets are one node, however many documents share it. Null and blank texts are
    one group. Nulls, repeated rows and other columns as in simhash_duplicates.
    """
    bounded_batches(docs.sparkSession)
    found = written(with_cells(docs, text=text, words=words))
    nodes = written(_first_rows(found.groupBy(F.col("fp").alias("node"), "simhash", "cells")))
    alike = written(simhash_pairs(nodes.select("node", "simhash")))
    cells = nodes.select("node", F.explode("cells").alias("cell"))
    crowded = cells.groupBy("cell").agg(F.min("node").alias("lead"), F.count("*").alias("rows")).where("rows > 1")
    shared = written(cells.join(crowded, "cell").select("cell", "node", "lead", "rows"))
    met = shared.select("node").unionAll(alike.select("a")).unionAll(alike.select("b")).distinct()
    members = written(nodes.select("node", "low", "low_hash").join(met, "node", "left_semi"))
    sets = written(with_sets(_rows_of(docs, members.select("low", "low_hash"), text), text=text, words=words).join(members.select("node"), "node", "left_semi").distinct())
    near = written(verified_pairs(alike, sets, jaccard))
    joined = written(connected_components(members, near))
    stars = shared.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    a, b = joined.toDF("a", "_a"), joined.toDF("b", "_b")
    stars = stars.join(a, "a").join(b, "b").where("_a <> _b").select("a", "b")
    edges = written(near.unionAll(verified_pairs(stars, sets, jaccard)))
    placed = shared.join(connected_components(members, edges), "node")
    apart = placed.where("rows > 2").groupBy("cell").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("cell")
    rest = links_between(placed.join(apart, "cell").select("cell", "node", "component", "rows"), sets, jaccard)
    return _classes(found, nodes, connected_components(nodes, edges.unionByName(rest)))


def simhash_pairs(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """Pairs (a, b) of nodes (node, simhash): b and the smallest node of its component of fingerprints, which are linked at
    ``bits`` or fewer differing bits. Nodes of one fingerprint are linked."""
    prints = written(nodes.select(F.col("simhash").alias("node")).distinct())
    classes = connected_components(prints, link_fingerprints(prints.select("node", F.col("node").alias("fp")), bits))
    placed = nodes.join(classes.toDF("simhash", "component"), "simhash").select("node", "component")
    first = placed.groupBy("component").agg(F.min("node").alias("a"), F.count("*").alias("rows")).where("rows > 1")
    return placed.join(first, "component").where("node <> a").select("a", F.col("node").alias("b"))


def simhash_duplicates(docs: DataFrame, *, text: str = "text", words: int = 4, bits: int = BITS) -> DataFrame:
    """One row per document: doc_id, ``fp`` (long) and ``component_id``, the smallest doc_id reachable over links of
    fingerprints that differ in at most ``bits`` (at most 4) bits.

    Equal fingerprints are one node, however many documents share it, so groups of copies cost one row. Null and
    blank texts have fingerprint 0 and are linked like others. A null doc_id gets a component only through other
    documents; if its whole component has null ids, component_id is null. Repeated rows stay; an empty table gives
    an empty result; other columns are ignored.
    """
    if bits > BITS:
        raise ValueError("the grid covers at most 4 differing bits")
    found = written(fingerprints(docs, text=text, words=words))
    nodes = written(_first_rows(found.groupBy(F.col("fp").alias("node"))))
    classes = connected_components(nodes, link_fingerprints(nodes.select("node", F.col("node").alias("fp")), bits))
    return _classes(found, nodes, classes)


def _first_rows(groups) -> DataFrame:
    """The group's keys with ``low`` and ``low_hash``: its row of smallest doc_id (null last), of these of smallest text hash."""
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    return groups.agg(F.min(first).alias("_first")).select("*", F.col("_first.doc_id").alias("low"), F.col("_first.text_hash").alias("low_hash")).drop("_first")


def _rows_of(docs: DataFrame, rows: DataFrame, text: str, how: str = "left_semi") -> DataFrame:
    """The rows of docs with the (doc_id, text hash) of ``rows``, which has two columns of any names and is read three
    times; with left_anti all others. Only rows that hit a bit of theirs (see row_bits) are moved, whole texts are not."""
    key, of = unused(docs.columns, "_id", "_text_hash")
    named = rows.toDF(key, of).distinct()
    table = row_bits(named.select(F.xxhash64(key, of).alias("h")))
    mine, own = F.col("doc_id").cast("long"), F.xxhash64(utf8(text))
    hit = by_row_bits(docs, F.xxhash64(mine, own), table, "left_semi")
    out = hit.join(named, mine.eqNullSafe(F.col(key)) & (own == F.col(of)), how)
    return out if how == "left_semi" else by_row_bits(docs, F.xxhash64(mine, own), table, how).unionAll(out)


def _classes(found: DataFrame, nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """doc_id, fp, component_id, text_hash and first_hash (text hash of the component's first row) of every row found."""
    members = written(nodes.select("node", "low", "low_hash").join(classes, "node"))
    first = members.select("component", F.col("low").alias("doc_id"), F.col("low_hash").alias("text_hash")).groupBy("component")
    low = written(_first_rows(first))  # on its own, so that a hot component's join is split
    by_fp = members.select("node", "component").join(low, "component").select(F.col("node").alias("fp"), F.col("low").alias("component_id"), F.col("low_hash").alias("first_hash"))
    return found.join(by_fp, "fp", "left").select("doc_id", "fp", "component_id", "text_hash", "first_hash")


def simhash_report(docs: DataFrame) -> DataFrame:
    return simhash_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, by: Callable[..., DataFrame] = simhash_duplicates, *, text: str = "text", **how) -> DataFrame:
    """docs with one row of each group that ``by`` finds: the one of smallest doc_id (null last), of rows that share
    this id the one of smallest text hash, of rows that repeat id and text any.

    So null ids and repeated ids are rows like others: a group whose ids are all null keeps one row, and of two rows
    with one id and different texts each stays or goes with its own group. An empty table gives an empty result;
    other columns pass through unchanged, whatever their names.
    """
    classes = written(by(docs, text=text, **how))
    first = (F.col("doc_id").eqNullSafe(F.col("component_id"))) & (F.col("text_hash") == F.col("first_hash"))
    rows = written(classes.groupBy("doc_id", "text_hash").agg(F.bool_or(first).alias("first"), F.count("*").alias("rows")).where("rows > 1 OR NOT first"))
    kept = _rows_of(docs, rows.where("NOT first").select("doc_id", "text_hash"), text, "left_anti")
    again = rows.where("first").select("doc_id", "text_hash")
    if again.isEmpty():
        return kept
    (of,) = unused(docs.columns, "_text_hash")
    once = _rows_of(kept, again, text).withColumn(of, F.xxhash64(utf8(text))).dropDuplicates(["doc_id", of]).drop(of)
    return _rows_of(kept, again, text, "left_anti").unionAll(once)
