"""Document fingerprints from prefix polynomial hashes.

A text's prefix hashes, kept modulo two primes, give the hash of any span in constant time: spans of two texts are
equal if their hashes are, and the longest common extension of two positions is found by binary search. A
document's fingerprint keeps the smallest span hash of each of 64 classes, so that the share of equal classes
estimates how many of the two texts' spans are common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions

#: Moduli and bases of the two hashes.
MODULI = (2147483647, 2147483629)
BASES = (1103515245, 1852640303)
SPAN = 8
CLASSES = 64
_EMPTY = 0xFFFF


class _Powers:
    """Powers of a base and of its inverse, grown as longer texts come."""

    def __init__(self, base: int, p: int):
        self.base, self.inverse, self.p = base, pow(base, -1, p), p
        self.up = self.down = np.ones(1, np.int64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * pow(self.base, k, self.p) % self.p])
            self.down = np.concatenate([self.down, self.down * pow(self.inverse, k, self.p) % self.p])
        return self.up[:n], self.down[:n]


_POWERS = [_Powers(b, p) for b, p in zip(BASES, MODULI, strict=True)]


class PrefixHash:
    """Prefix hashes of a sequence of code points; ``spans`` are hashes of all spans of one length."""

    def __init__(self, codes: np.ndarray, prefixes: list[np.ndarray] | None = None):
        self.codes = codes
        self.prefixes = prefixes if prefixes is not None else [self._extend(np.zeros(1, np.int64), codes, w) for w in _POWERS]

    @classmethod
    def of(cls, text: str) -> PrefixHash:
        return cls(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64))

    @staticmethod
    def _extend(prefix: np.ndarray, codes: np.ndarray, w: _Powers) -> np.ndarray:
        at = len(prefix) - 1
        terms = (codes + 1) * w.get(at + len(codes))[0][at:] % w.p
        return np.concatenate([prefix, (prefix[-1] + np.cumsum(terms)) % w.p])

    def with_tail(self, keep: int, tail: np.ndarray) -> PrefixHash:
        """The sequence's first ``keep`` codes followed by ``tail``; the kept prefix hashes are used again."""
        return PrefixHash(np.concatenate([self.codes[:keep], tail]), [self._extend(h[: keep + 1], tail, w) for h, w in zip(self.prefixes, _POWERS, strict=True)])

    def span(self, start, length: int) -> np.ndarray:
        """Hashes (62 bits) of the spans of ``length`` codes at the given starts."""
        start = np.asarray(start)
        out = []
        for h, w in zip(self.prefixes, _POWERS, strict=True):
            down = w.get(len(h))[1]
            out.append((h[start + length] - h[start]) % w.p * down[start] % w.p)
        return (out[0].astype(np.uint64) << np.uint64(31)) | out[1].astype(np.uint64)

    def spans(self, length: int, first: int = 0) -> np.ndarray:
        n = len(self.codes) - length + 1
        if n <= first:
            return np.zeros(0, np.uint64)
        out = []
        for h, w in zip(self.prefixes, _POWERS, strict=True):
            out.append((h[first + length :] - h[first : len(h) - length]) % w.p * w.get(n)[1][first:] % w.p)
        return (out[0].astype(np.uint64) << np.uint64(31)) | out[1].astype(np.uint64)

    def equal(self, i: int, other: PrefixHash, j: int, length: int) -> bool:
        return bool(self.span(i, length) == other.span(j, length))

    def common_extension(self, i: int, other: PrefixHash, j: int) -> int:
        """Length of the longest common span that starts at i here and at j in other."""
        low, high = 0, min(len(self.codes) - i, len(other.codes) - j)
        while low < high:
            mid = (low + high + 1) // 2
            if self.equal(i, other, j, mid):
                low = mid
            else:
                high = mid - 1
        return low


def _minima(spans: np.ndarray) -> np.ndarray:
    """The smallest mixed hash of each class, as 16 bits of it; classes without a span are marked."""
    x = spans * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    least = np.full(CLASSES, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, (x >> np.uint64(58)).astype(np.int64), x & np.uint64((1 << 58) - 1))
    return np.where(least == np.iinfo(np.uint64).max, _EMPTY, (least >> np.uint64(16)) % np.uint64(_EMPTY)).astype(np.uint16)


def fingerprint(h: PrefixHash, spans: np.ndarray | None = None) -> np.ndarray:
    """64 class minima over all spans of 8 code points; a shorter text has one span, itself; an empty one none."""
    if len(h.codes) < SPAN:
        return _minima(h.span([0], len(h.codes)) + np.uint64(len(h.codes)) if len(h.codes) else np.zeros(0, np.uint64))
    return _minima(h.spans(SPAN) if spans is None else spans)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal classes among those that either text fills; 1 for two empty texts."""
    filled = (a != _EMPTY) | (b != _EMPTY)
    n = int(filled.sum())
    return 1.0 if n == 0 else float(((a == b) & filled).sum()) / n


def as_hex(f: np.ndarray) -> str:
    return f.astype(">u2").tobytes().hex()


def _order(c: str = "doc_id") -> Column:
    return F.coalesce(F.col(c), F.lit(-(1 << 63)))


def _ranges(docs: DataFrame, buckets: int) -> tuple[DataFrame, list]:
    """docs with ``_part`` by ranges of doc_id, and (largest id, part) of each part that has rows: a bounded list."""
    cuts = sorted(set(docs.select(F.col("_key").cast("double").alias("k")).approxQuantile("k", [i / buckets for i in range(1, buckets)], 0.2 / buckets)))
    if cuts:
        split = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="_at", outputCol="_bucket")
        docs = split.transform(docs.withColumn("_at", F.col("_key").cast("double"))).withColumn("_part", F.col("_bucket").cast("int")).drop("_at", "_bucket")
    else:
        docs = docs.withColumn("_part", F.lit(0))
    return docs, sorted((r["part"], r["top"]) for r in docs.groupBy(F.col("_part").alias("part")).agg(F.max("_key").alias("top")).collect())


def fingerprint_with_next(docs: DataFrame, *, edit_share: int = 3) -> DataFrame:
    """Fingerprint each whole text, its edited text and compare it with the next document's, by descending doc_id.

    The edited text has its last floor(n_chars / edit_share) code points replaced by the first as many of the next
    document (all of them, if it has fewer). After the last document comes the first. Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and common_prefix (code points that the
    text and its edited text share at their start, found on the prefix hashes).

    Texts move once: rows go to ranges of doc_id that hold about equally many rows, each range gets a copy of the
    row that follows its last one, and a task walks its range with two texts in memory. Null texts are empty, rows
    with a null doc_id come last, repeated ids are ordered by text, a single row follows itself, an empty table
    gives an empty result; columns other than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _order().alias("_key"))
    buckets = shuffle_partitions(spark)
    docs, tops = _ranges(docs, buckets)
    if tops:
        # the row after a part's last one is the first row of the part below it, after the lowest part's the first of all
        follow = [(tops[k - 1][1], tops[k][0]) for k in range(len(tops))]
        guests = spark.createDataFrame(follow, "_key long, _to int")
        moved = docs.drop("_part").join(F.broadcast(guests), "_key").select("doc_id", "text", "_key", F.col("_to").alias("_part"), F.lit(1).alias("_guest"))
        docs = docs.select("doc_id", "text", "_key", "_part", F.lit(0).alias("_guest")).unionByName(moved)
    else:
        docs = docs.withColumn("_guest", F.lit(0))
    spread = docs.repartitionById(buckets, "_part").sortWithinPartitions("_part", "_guest", F.desc("_key"), "text").select("doc_id", "text", "_part", "_guest")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long"

    def digest(text: str) -> tuple:
        h = PrefixHash.of(text)
        spans = h.spans(SPAN)
        return text, h, spans, fingerprint(h, spans)

    def compare(doc_id, this: tuple, after: tuple) -> tuple:
        text, h, spans, f = this
        n = len(text)
        cut = n // edit_share
        keep = n - cut
        edited = text[:keep] + after[0][:cut]
        if edited == text:
            fe, common = f, n
        else:
            he = h.with_tail(keep, after[1].codes[:cut])
            shared = max(0, keep - SPAN + 1)
            fe = fingerprint(he, np.concatenate([spans[:shared], he.spans(SPAN, shared)]))
            common = keep + h.common_extension(keep, he, keep)
        return doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), as_hex(f), as_hex(fe), likeness(f, fe), likeness(f, after[3]), common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        held = part = None
        done = False
        for b in batches:
            out = []
            for at in range(b.num_rows):
                row = b.slice(at, 1)
                doc_id, text, p, guest = (row.column(i)[0].as_py() for i in range(4))
                if p != part:
                    part, held, done = p, None, False
                if done:
                    continue
                now = digest(text) if held is None or text != held[1][0] else held[1]
                if held is not None:
                    out.append(compare(held[0], held[1], now))
                held, done = (doc_id, now), bool(guest)
                if len(out) == 512:
                    yield _rows(out, names)
                    out = []
            if out:
                yield _rows(out, names)

    return spread.mapInArrow(run, schema)


def _rows(out: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) if i not in (0,) else pa.array(c, pa.int64()) for i, c in enumerate(zip(*out, strict=True))], names=names)
