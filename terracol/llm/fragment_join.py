"""N-gram Jaccard join by vertical partitioning.

The n-grams have one global order: by the power of two of their document frequency, then by hash. It is cut into
fragments, and the overlap of a pair of sets is counted fragment by fragment and summed. The fragment of n-grams that
only one document has adds nothing to any pair, so it is never sent on; it is most of the text.

1. Tasks hash their documents' n-grams and send them, packed, to the range of the hash they lie in, which counts them.
   A range sends back what occurs in more than one document; so each batch of documents knows its n-grams' frequencies.
2. Two linked sets share an n-gram among the first n - ceil(0.8 n) + 1 of each in the global order. Sets that have one
   in common there, sizes and places that allow a link, are candidates: first each with one lead, then the pairs
   that the links so found leave in different components, unless what they differ in rules them out.
3. Candidates' partial overlaps are counted in tasks of one set and one fragment, and summed per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, discard, shuffle_partitions, slices, utf8, word_hashes, written
from .simhash import connected_components

#: A batch of documents: so many n-grams or, at most, sets.
BATCH_GRAMS, BATCH_SETS = 1 << 20, (1 << 16) - 1
#: Documents of a batch that share an n-gram, up to which it is sent for each of them; beyond, once with its count.
OFTEN = 4
#: Bits of an n-gram's hash that are sent besides its range.
LOW = 40
#: The order's classes are powers of two of the frequency up to 2^CLASSES; each is cut into 2^CUT_BITS ranges of the hash.
CLASSES, CUT_BITS = 15, 2
#: Parity bits of a set's shared n-grams.
BITS = 1024
#: Rows of a list of sets that one task pairs, and members that one task counts against a set.
LIST_ROWS, STAR_ROWS = 1024, 4096
_TIMES, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def gram_set(text: bytes, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct word n-grams, A-Z in lower case; a text of fewer words is one n-gram,
    one without words has none."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h, n = word_hashes(parts), min(words, len(parts))
    out = np.full(len(h) - n + 1, np.uint64(n))
    for i in range(n):
        out = out * _TIMES + h[i : len(h) - n + 1 + i]
    out ^= out >> np.uint64(32)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return np.unique(out)


def _pack(x: np.ndarray, size: int) -> bytes:
    """The low ``size`` bytes of each number."""
    return np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _unpack(raw: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(raw) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8).reshape(-1, size)
    return out.reshape(-1).view("<u8")


def parity_bits(grams: np.ndarray) -> bytes:
    """BITS bits, each whether an odd number of n-grams falls on it. Where two sets' bits differ, so do the sets: the
    number of such bits is at most that of the n-grams that only one of them has."""
    return np.packbits((np.bincount((grams % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).astype(bool)).tobytes()


def _range_bits(partitions: int) -> int:
    return max(12, (4 * partitions - 1).bit_length())


_SENT = "key long, batch long, grams binary, sets binary, often binary, counts binary, doc_ids array<long>, doc_sets array<int>, nodes array<long>, sizes array<long>"
_NAMES = [x.strip().split(" ")[0] for x in _SENT.split(",")]
_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(_TYPES), _TYPES, strict=True)], names=_NAMES)


def _sent(batches: Iterator[pa.RecordBatch], words: int, bits: int) -> Iterator[pa.RecordBatch]:
    """For each batch of documents a row without range (key -1) that lists documents, sets and the n-grams that occur
    often in it, and a row for each range with the n-grams in it and the sets that have them."""
    ids: list = []
    of: list[int] = []
    known: dict[int, int] = {}
    sets: list[np.ndarray] = []
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        name = xxhash.xxh64_intdigest(repr((ids, of, list(known))).encode()) >> 1
        sizes = np.array([len(x) for x in sets], np.int64)
        grams = (np.concatenate(sets) if sets else np.zeros(0, np.uint64)) >> np.uint64(64 - bits - LOW)
        owner = np.repeat(np.arange(len(sets), dtype=np.uint64), sizes)
        order = np.argsort(grams, kind="stable")
        grams, owner = grams[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
        count = np.diff(np.concatenate([first, [len(grams)]]))
        often = count > OFTEN
        many = np.repeat(often, count)
        nodes = np.array(list(known), np.uint64).view(np.int64)
        rows = [(-1, name, None, _pack(owner[many], 2), _pack(grams[many], 8), None, list(ids), list(of), nodes.tolist(), sizes.tolist())]
        rare, rare_owner, hot, hot_count = grams[~many], owner[~many], grams[first[often]], count[often]
        at, hot_at = (x >> np.uint64(LOW) for x in (rare, hot))
        keys = np.unique(np.concatenate([at, hot_at]))
        ends = [np.searchsorted(x, keys, side=s).tolist() for x in (at, hot_at) for s in ("left", "right")]
        for key, a, b, c, d in zip(keys.tolist(), *ends, strict=True):
            rows.append((key, name, _pack(rare[a:b], 5), _pack(rare_owner[a:b], 2), _pack(hot[c:d], 5), _pack(hot_count[c:d], 4), None, None, None, None))
            if len(rows) == 4096:
                yield _rows(rows)
                rows = []
        yield _rows(rows)

    for part in slices(batches, 256):
        for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            found = gram_set(t, words)
            node = xxhash.xxh64_intdigest(found.tobytes(), 42) if len(found) else 0
            if node not in known:
                known[node] = len(sets)
                sets.append(found)
                held += len(found)
            ids.append(i)
            of.append(known[node])
            if held >= BATCH_GRAMS or len(sets) >= BATCH_SETS or len(ids) >= 1 << 17:
                yield from flush()
                ids, of, known, sets, held = [], [], {}, [], 0
    if ids:
        yield from flush()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key: rows without range as they are; for the others what occurs in more than one document, with
    the frequency in place of ``counts`` (of the n-grams, then of those sent with a count)."""
    held: list[tuple] = []

    def flush() -> Iterator[pa.RecordBatch]:
        rare, hot = [_unpack(r[2], 5) for r in held], [_unpack(r[4], 5) for r in held]
        values, place = np.unique(np.concatenate([*rare, *hot]), return_inverse=True)
        weight = np.concatenate([*(np.ones(len(x)) for x in rare), *(_unpack(r[5], 4) for r in held)])
        total = np.bincount(place, weights=weight, minlength=len(values)).astype(np.uint64)[place]
        at, hot_at, out = 0, sum(map(len, rare)), []
        for r, x, y in zip(held, rare, hot, strict=True):
            df, hot_df = total[at : at + len(x)], total[hot_at : hot_at + len(y)]
            at, hot_at = at + len(x), hot_at + len(y)
            more = df > 1
            if more.any() or len(y):
                counts = _pack(np.minimum(np.concatenate([df[more], hot_df]), (1 << 32) - 1), 4)
                out.append((r[0], r[1], _pack(x[more], 5), _pack(_unpack(r[3], 2)[more], 2), r[4], counts, None, None, None, None))
        yield _rows(out)

    for part in slices(batches, 256):
        through = []
        for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if row[0] < 0:
                through.append(row)
                continue
            if held and held[0][0] != row[0]:
                yield from flush()
                held = []
            held.append(row)
        if through:
            yield _rows(through)
    if held:
        yield from flush()


_KNOWN = "doc_id long, node long, n long, before long, bits binary, prefix array<long>, segments array<struct<fragment int, grams array<long>>>"
_SEGMENT = pa.struct([("fragment", pa.int32()), ("grams", pa.list_(pa.int64()))])


def _ordered(batches: Iterator[pa.RecordBatch], percent: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by batch and key: a row for each document (doc_id, node, n), and one for each set that has shared
    n-grams in its prefix: how many of its n-grams come before these, the parity bits of the shared ones, the prefix, and
    the shared ones by fragment."""
    held: list[tuple] = []

    def flush() -> Iterator[pa.RecordBatch]:
        listed = held[0]
        n, node = np.array(listed[9], np.int64), np.array(listed[8], np.int64)
        of = np.array(listed[7], np.int64)
        docs = batch(doc_id=pa.array(listed[6], pa.int64()), node=pa.array(node[of]), n=pa.array(n[of]))
        nothing = len(docs)
        yield pa.RecordBatch.from_arrays([*docs.columns, pa.nulls(nothing, pa.int64()), pa.nulls(nothing, pa.binary()), pa.nulls(nothing, pa.list_(pa.int64())), pa.nulls(nothing, pa.list_(_SEGMENT))], names=[*docs.schema.names, "before", "bits", "prefix", "segments"])
        grams, owner, df, hot, hot_df = [], [_unpack(listed[3], 2)], [], [], []
        for r in held[1:]:
            high = np.uint64(r[0] << LOW)
            x, y, c = _unpack(r[2], 5), _unpack(r[4], 5), _unpack(r[5], 4)
            grams.append(x | high)
            owner.append(_unpack(r[3], 2))
            df.append(c[: len(x)])
            hot.append(y | high)
            hot_df.append(c[len(x) :])
        none = [np.zeros(0, np.uint64)]
        often = _unpack(listed[4], 8)
        hot, hot_df = np.concatenate(hot or none), np.concatenate(hot_df or none)  # by range, so in order
        grams, owner = np.concatenate([often, *grams]), np.concatenate(owner).astype(np.int64)
        df = np.concatenate([hot_df[np.searchsorted(hot, often)], *df])
        kind = np.clip(np.log2(np.maximum(df, 2).astype(np.float64)).astype(np.int64), 1, CLASSES)
        order = np.lexsort((grams, kind, owner))
        grams, owner, kind = grams[order], owner[order], kind[order]
        many = np.bincount(owner, minlength=len(n))
        begin = np.cumsum(many) - many
        before = n - many
        short = np.maximum(n + (-percent * n // 100) + 1 - before, 0)  # n - ceil(percent n / 100) + 1
        kept = np.flatnonzero((short > 0) & (many > 0))
        fragment = (kind << CUT_BITS) + (grams >> np.uint64(bits + LOW - CUT_BITS)).astype(np.int64)
        for at in range(0, len(kept), 1024):
            part = kept[at : at + 1024]
            some = np.concatenate([np.arange(begin[i], begin[i] + many[i]) for i in part.tolist()])
            heads = np.concatenate([np.arange(begin[i], begin[i] + min(short[i], many[i])) for i in part.tolist()])
            bits_of = [parity_bits(grams[begin[i] : begin[i] + many[i]]) for i in part.tolist()]
            ends = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            prefix = pa.ListArray.from_arrays(ends(np.minimum(short[part], many[part])), pa.array(grams[heads].astype(np.int64)))
            cut = np.concatenate([[0], np.flatnonzero((np.diff(owner[some]) != 0) | (np.diff(fragment[some]) != 0)) + 1])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([cut, [len(some)]]).astype(np.int32)), pa.array(grams[some].astype(np.int64)))
            segments = pa.StructArray.from_arrays([pa.array(fragment[some][cut].astype(np.int32)), lists], fields=list(_SEGMENT))
            per = np.bincount(np.searchsorted(part, owner[some][cut]), minlength=len(part))
            segments = pa.ListArray.from_arrays(ends(per), segments)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.int64()), pa.array(node[part]), pa.array(n[part]), pa.array(before[part]), pa.array(bits_of, pa.binary()), prefix, segments], names=["doc_id", "node", "n", "before", "bits", "prefix", "segments"])

    for part in slices(batches, 256):
        for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if held and row[0] < 0:
                yield from flush()
                held = []
            held.append(row)
    if held:
        yield from flush()


def ordered_sets(docs: DataFrame, *, text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Rows of documents (doc_id, node, n; prefix null) and of sets with a shared prefix; see _ordered."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    bits = _range_bits(parts)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(text).alias("b"))
    sent = slim.mapInArrow(lambda b: _sent(b, words, bits), _SENT)
    by_range = sent.withColumn("place", F.when(F.col("key") < 0, F.col("batch")).otherwise(F.col("key"))).repartition(parts, "place").drop("place").sortWithinPartitions("key")
    back = by_range.mapInArrow(_counted, _SENT).repartition(parts, "batch").sortWithinPartitions("batch", "key")
    return back.mapInArrow(lambda b: _ordered(b, percent, bits), _KNOWN)


# --- candidates and links ---------------------------------------------------------------------------------------
def _may_link(percent: int) -> Column:
    """Whether sets a and b of sizes na, nb can be linked if their first common n-gram has places ia and ib (from 0)."""
    least = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent))
    return (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= least)


def _side(df: DataFrame, side: str, *keep: str) -> DataFrame:
    return df.select(*keep, F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("at").alias(f"i{side}"))


def star_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb): of each list of sets that share a prefix n-gram (``gram``; node, n, at, rows) every set with the
    list's lead, the set that is in most lists: of a family of copies the one that has least of its own. Long lists are
    dealt into parts with a lead each, and these are paired with the lead of all."""
    degree = lists.groupBy("node").agg((-F.count("*")).alias("degree"))
    dealt = lists.join(degree, "node").withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("rows") / STAR_ROWS)))
    leads = dealt.groupBy("gram", "part").agg(F.min(F.struct("degree", "node", "n", "at")).alias("x")).select("gram", "part", "x.*")
    tops = leads.groupBy("gram").agg(F.min(F.struct("degree", "node", "n", "at")).alias("x")).select("gram", "x.*")
    members = _side(dealt, "b", "gram", "part").join(_side(leads, "a", "gram", "part"), ["gram", "part"])
    between = _side(leads, "b", "gram").join(_side(tops, "a", "gram"), "gram")
    pairs = members.unionByName(between, allowMissingColumns=True)
    return pairs.where(_may_link(percent) & (F.col("a") != F.col("b"))).select("a", "b", "na", "nb").distinct()


def cross_pairs(lists: DataFrame, percent: int, forest: bool) -> DataFrame:
    """(a, b, na, nb): of each list pairs of sets of different ``component`` that may be linked by their sizes, their
    places in the list and what they differ in at least: the n-grams that only one document has (``before``) and the
    parity bits (``bits``). With ``forest`` only pairs that join what the list's other pairs don't, else all.

    Lists of more than LIST_ROWS rows are dealt into parts, and every pair of parts is searched in a task of its own."""
    spark = lists.sparkSession
    parts = F.ceil(F.col("rows") / LIST_ROWS).cast("int")
    dealt = lists.withColumn("mine", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    side = (F.col("mine") <= F.col("other")).cast("int") + 2 * (F.col("mine") >= F.col("other")).cast("int")
    dealt = dealt.select(F.xxhash64("gram", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"), "node", "n", "at", "before", "component", side.alias("side"), "bits")
    ready = dealt.repartition(shuffle_partitions(spark), "cell").sortWithinPartitions("cell", "n", "node")

    def search(node, n, at, before, component, side, bits) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        end = np.searchsorted(n, 100 * n // percent, side="right")
        root = np.unique(component, return_inverse=True)[1]
        for i in np.flatnonzero(end > np.arange(len(n)) + 1).tolist():
            j = np.arange(i + 1, end[i])
            j = j[(root[j] != root[i]) & ((side[i] & (3 ^ side[j])) | (side[j] & (3 ^ side[i])) | (side[i] & side[j] == 3)).astype(bool)]
            least = -(-percent * (n[i] + n[j]) // (100 + percent))
            j = j[(np.minimum(n[i] - at[i], n[j] - at[j]) >= least) & (before[i] + before[j] <= n[i] + n[j] - 2 * least)]
            if not len(j):
                continue
            least = -(-percent * (n[i] + n[j]) // (100 + percent))
            apart = before[i] + before[j] + np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
            j = j[apart <= n[i] + n[j] - 2 * least]
            if forest:
                roots, first = np.unique(root[j], return_index=True)
                j = j[first]
                root[np.isin(root, roots)] = root[i]
            if len(j):
                yield np.full(len(j), i), j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, node, n, *rest, bits in grouped(batches, 1):
            for i, j in search(node, n, *rest, bits):
                small = node[i] < node[j]
                yield batch(a=np.where(small, node[i], node[j]), b=np.where(small, node[j], node[i]), na=np.where(small, n[i], n[j]), nb=np.where(small, n[j], n[i]))

    return ready.mapInArrow(run, "a long, b long, na long, nb long").distinct()


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of the rows of each value of the first ``keys`` columns, of sorted rows of numbers; binary columns of
    one length become rows of 64-bit words."""

    def array(c: pa.Array) -> np.ndarray:
        if not pa.types.is_binary(c.type):
            return c.to_numpy(zero_copy_only=False)
        return np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(len(c), -1)

    rest: list[np.ndarray] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        now = [array(c) for c in b.columns]
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
        cut = np.flatnonzero(np.any([x[1:] != x[:-1] for x in now[:keys]], axis=0)) + 1
        for i, j in zip([0, *cut[:-1].tolist()], cut.tolist(), strict=False):
            yield [x[i:j] for x in now]
        rest = [x[cut[-1] if len(cut) else 0 :] for x in now]
    if rest is not None and len(rest[0]):
        yield rest


def linked_pairs(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of (a, b, na, nb) whose overlap, counted by fragment and summed, is ``percent`` of the union or
    more. segments has node, fragment, grams. A task holds one fragment of a and streams those of the sets paired with
    it; a set with more than STAR_ROWS partners is held by several tasks."""
    spark = pairs.sparkSession
    pairs = written(pairs)
    stars = pairs.groupBy("a").agg(F.count("*").alias("rows")).select("a", F.ceil(F.col("rows") / STAR_ROWS).cast("int").alias("parts"))
    leads = segments.join(stars, segments["node"] == stars["a"]).select("a", "fragment", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.col("a").alias("b"), F.lit(0).cast("long").alias("na"), F.lit(0).cast("long").alias("nb"), "grams")
    dealt = pairs.join(stars, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    members = dealt.join(segments, F.col("b") == F.col("node")).select("a", "fragment", "part", F.lit(1).alias("kind"), "b", "na", "nb", "grams")
    ready = leads.unionByName(members).repartition(shuffle_partitions(spark), "a", "fragment", "part").sortWithinPartitions("a", "fragment", "part", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, of = np.zeros(0, np.int64), None
        for b in slices(batches, 512):
            key = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            kind = b.column(3).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(b.column(7).value_lengths().to_numpy(zero_copy_only=False))])
            grams = b.column(7).flatten().to_numpy(zero_copy_only=False)
            common = np.zeros(b.num_rows, np.int64)
            starts = np.flatnonzero(np.concatenate([[True], np.any(key[1:] != key[:-1], axis=1)])).tolist()
            for i, j in zip(starts, [*starts[1:], b.num_rows], strict=True):
                if kind[i] == 0:
                    lead, of = grams[ends[i] : ends[i + 1]], tuple(key[i])
                    i += 1
                if i < j and of == tuple(key[i]):
                    mine = grams[ends[i] : ends[j]]
                    hit = lead[np.minimum(np.searchsorted(lead, mine), len(lead) - 1)] == mine
                    common[i:j] = np.add.reduceat(hit.astype(np.int64), ends[i:j] - ends[i])
            found = np.flatnonzero(common)
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(found)) for i in (0, 4, 5, 6)), pa.array(common[found])], names=["a", "b", "na", "nb", "common"])

    partial = ready.mapInArrow(run, "a long, b long, na long, nb long, common long")
    total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
    return total.where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def jaccard_components(docs: DataFrame, *, text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, ``n`` (the size of its set of distinct word n-grams, A-Z in lower case) and
    ``component_id``, the smallest doc_id reachable over links of sets with 100 * overlap >= percent * union.

    Texts of fewer than ``words`` words are one n-gram. Null and blank texts have no set and are linked with nothing.
    Equal sets are one node, however many documents share it. A null doc_id gets a component only through other
    documents; if its whole component has null ids, component_id is null. Repeated rows stay; long texts count whole;
    an empty table gives an empty result; other columns are ignored.
    """
    known = written(ordered_sets(docs, text=text, words=words, percent=percent))
    sets = known.where("prefix IS NOT NULL")
    postings = sets.select("node", "n", "before", F.posexplode("prefix").alias("k", "gram")).select("gram", "node", "n", (F.col("before") + F.col("k")).alias("at")).dropDuplicates(["gram", "node"])
    postings = written(postings)
    sizes = postings.groupBy("gram").agg(F.count("*").alias("rows")).where("rows > 1")
    lists = written(postings.join(sizes, "gram"))
    discard(postings)
    nodes = written(lists.select("node").distinct())
    segments = written(sets.join(nodes, "node", "left_semi").dropDuplicates(["node"]).select("node", F.explode("segments").alias("s")).select("node", "s.fragment", "s.grams"))
    links = written(linked_pairs(star_pairs(lists, percent), segments, percent))
    shared = sets.select("node", "before", "bits").join(nodes, "node", "left_semi").dropDuplicates(["node"])
    for forest in (True, False):
        # what links the lists still lack: first as few as could join all, then, where some of these were none, all
        placed = written(lists.where("rows > 2").join(connected_components(nodes, links), "node"))
        apart = placed.groupBy("gram").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("gram")
        more = linked_pairs(cross_pairs(placed.join(apart, "gram").join(shared, "node"), percent, forest), segments, percent)
        links = written(links.unionByName(more))
        discard(placed)
    classes = connected_components(nodes, links)
    found = known.where("prefix IS NULL").select("doc_id", "node", "n")
    with_class = found.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    low = with_class.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("low"))
    return with_class.join(low, "component", "left").select("doc_id", "n", F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("doc_id")).alias("component_id"))


def jaccard_report(docs: DataFrame) -> DataFrame:
    return jaccard_components(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


JACCARD_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM worded
), sizes AS (
  SELECT doc_id, count(*)::BIGINT AS n FROM grams GROUP BY doc_id
), shared AS (
  SELECT * FROM grams SEMI JOIN (SELECT g FROM grams GROUP BY g HAVING count(*) > 1) s ON s.g = grams.g
), linked AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shared x JOIN shared y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * common >= 80 * (p.n + q.n - common)
), beside AS (
  SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked
), low(k, v) USING KEY (k) AS (
  SELECT doc_id AS k, doc_id AS v FROM documents
  UNION SELECT * FROM (SELECT e.b AS k, min(l.v) AS v FROM low l JOIN beside e ON l.k = e.a JOIN recurring.low r ON r.k = e.b WHERE l.v < r.v GROUP BY e.b)
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.v AS component_id FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN low l ON l.k = d.doc_id
"""
