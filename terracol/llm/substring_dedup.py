"""Removal of repeated word windows by level-wise doubling.

A window of 20 words can only be repeated if every shorter window in it is. Each window of 20 is stood for, at 5 words,
by the window of least hash inside it; where that one is repeated it alone is extended to twice its length, by the
words on either side, and the extension of least hash stands for the window at 10 words; where that is repeated too the
window itself is compared. Windows whose stand-in occurs once drop out at its level. Hashes only sieve: what is left at
20 words is decided by a 128-bit BLAKE2 digest of the words themselves, for stretches of neighbouring windows first,
whole, then for the single windows of each first stretch.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, discard, utf8, written

WINDOW = 20
FIRST_LEVEL = 5
#: Bits of a filter of repeated hashes, at most; it has 8 for each hash up to there. A false hit keeps a window for the
#: next level, no more.
FILTER_BITS = 1 << 28
#: Digests that a task remembers, so that a hot passage leaves it once or a few times.
REMEMBERED = 100_000
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_MODULI = ((2147483647, 1103515245), (2147483629, 1852640303))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_prime_powers: dict[int, np.ndarray] = {}


def levels(window: int = WINDOW, first: int = FIRST_LEVEL) -> list[int]:
    """Window lengths below ``window``, each twice the one before."""
    out = []
    while first < window:
        out.append(first)
        first *= 2
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base and of its inverse modulo 2^64, at least n of each."""
    up, down = _powers.get(base, (np.ones(1, np.uint64), np.ones(1, np.uint64)))
    while len(up) < n:
        k = len(up)
        inverse = pow(base, -1, 1 << 64)
        up = np.concatenate([up, up * np.uint64(pow(base, k, 1 << 64))])
        down = np.concatenate([down, down * np.uint64(pow(inverse, k, 1 << 64))])
        _powers[base] = up, down
    return up, down


def _prime_power(p: int, base: int, n: int) -> np.ndarray:
    up = _prime_powers.get(p, np.ones(1, np.int64))
    while len(up) < n:
        up = np.concatenate([up, up * pow(base, len(up), p) % p])
        _prime_powers[p] = up
    return up


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Prefix:
    """Span hashes of a sequence of 64-bit numbers, from prefix sums modulo 2^64."""

    def __init__(self, values: np.ndarray, base: int):
        self.base, n = base, len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _power(base, n + 1)[0][:n], out=self.sums[1:])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return _mix((self.sums[length:] - self.sums[:n]) * _power(self.base, len(self.sums))[1][:n])


def _word_hashes(data: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of words that stand one after another in ``data``: polynomials of their bytes modulo two primes."""
    if not len(length):
        return np.zeros(0, np.uint64)
    first = np.cumsum(length) - length
    place = np.arange(len(data)) - np.repeat(first, length)
    longest = int(length.max())
    out = []
    for p, base in _MODULI:
        terms = (data.astype(np.int64) + 1) * _prime_power(p, base, longest)[place]
        if longest > 1 << 20:  # sums of more would not fit
            terms %= p
        out.append((np.add.reduceat(terms, first) % p).astype(np.uint64))
    return _mix(out[0] << np.uint64(31) | out[1])


class Words:
    """Words of many texts in a row: ``doc`` has each word's text, ``at`` its place in the text."""

    def __init__(self, texts: pa.Array):
        self.texts = texts
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        word = ~_SPACE[data]
        outside = np.concatenate([[True], ~word, [True]])
        start = np.nonzero(word & (outside[:-2] | edge[:-1]))[0]
        end = np.nonzero(word & (outside[2:] | edge[1:]))[0] + 1
        self.doc = np.searchsorted(offsets, start, side="right") - 1
        self.first = np.searchsorted(start, offsets[:-1])
        self.at = np.arange(len(start)) - self.first[self.doc]
        self.size = end - start
        self.prefix = Prefix(_word_hashes(data[word], self.size), _BASES[0])

    def windows(self, window: int) -> np.ndarray:
        """Mask of the starts whose window lies in one text."""
        n = len(self.doc) - window + 1
        return self.doc[:n] == self.doc[window - 1 :] if n > 0 else np.zeros(0, bool)

    def digests(self, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both halves of the 128-bit digests of the n words from each lo, joined by one space."""
        found, text, ends, now = [], b"", None, -1
        for d, a, k in zip(self.doc[lo].tolist(), self.at[lo].tolist(), n.tolist(), strict=True):
            if d != now:
                now, text = d, b" ".join(self.texts[d].as_py().split())
                z = self.first[d + 1] if d + 1 < len(self.first) else len(self.size)
                ends = [0, *np.cumsum(self.size[self.first[d] : z] + 1).tolist()]
            found.append(blake2b(text[ends[a] : ends[a + k] - 1], digest_size=16).digest())
        both = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
        return both[:, 0].copy(), both[:, 1].copy()


def text_groups(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Batches cut to about ``most`` bytes of text; a longer text comes alone."""
    for b in batches:
        sizes = np.diff(np.frombuffer(b.column(column).buffers()[1], np.int32, b.num_rows + 1, b.column(column).offset * 4)).astype(np.int64)
        at = 0
        while at < b.num_rows:
            n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most, side="right")))
            yield b.slice(at, n)
            at += n


def _least(h: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Place of the least hash in each [low, high], the first of equal ones, from tables of powers of two."""
    tables = [np.arange(len(h))]
    while 1 << len(tables) <= int((high - low).max(initial=0)) + 1:
        t, step = tables[-1], 1 << len(tables) - 1
        a, b = t[: len(t) - step], t[step:]
        tables.append(np.where(h[b] < h[a], b, a))
    level = np.log2(high - low + 1).astype(np.int64)
    a, b = np.empty(len(low), np.int64), np.empty(len(low), np.int64)
    for k, t in enumerate(tables):
        here = level == k
        a[here], b[here] = t[low[here]], t[high[here] - (1 << k) + 1]
    return np.where(h[b] < h[a], b, a)


def extended(h: np.ndarray, window: int, length: int, before: np.ndarray | None) -> np.ndarray:
    """For each window the place of its stand-in of ``length`` words, whose hashes are h: the least of those in it, of
    those that extend the stand-in ``before`` of half the length if there is one."""
    i = np.arange(len(h) - (window - length))
    if before is None:
        return _least(h, i, i + window - length)
    return _least(h, np.maximum(i, before - length // 2), np.minimum(i + window - length, before))


class Filter:
    """A bit for each hash that was seen more than once; bounded size, no false misses."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, np.uint64(bits - 1)

    def has(self, x: np.ndarray) -> np.ndarray:
        at = x & self.bits
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def make_filter(hashes: DataFrame, most: int | None = None) -> Filter:
    """Filter of the long column ``h``, which is written and counted first: tasks set bits, words of 64 bits are joined
    by OR; ``most`` / 64 words (FILTER_BITS / 64) at most reach the driver."""
    hashes = written(hashes)
    bits = min(most or FILTER_BITS, max(64, 1 << (8 * hashes.count()).bit_length()))
    at = f"(h & {bits - 1}L)"
    rows = hashes.selectExpr(f"int(shiftright({at}, 6)) AS word", f"shiftleft(1L, int({at} & 63L)) AS bit").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(max(1, bits // 64), np.uint64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    discard(hashes)
    return Filter(words, bits)


def _survivors(w: Words, window: int, passed: list[tuple[int, Filter]]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Mask of windows whose stand-ins passed every level so far, the first level's stand-ins, the last one's places."""
    alive, first, at = w.windows(window), np.zeros(0, np.uint64), None
    if not alive.any():
        return alive, np.zeros(len(alive), np.uint64), np.zeros(len(alive), np.int64)
    for length, seen in passed:
        h = w.prefix.all(length)
        at = extended(h, window, length, at)
        first = first if len(first) else h[at]
        alive = alive & seen.has(h[at])
    return alive, first, at


def repeated_standins(docs: DataFrame, window: int, length: int, passed: list[tuple[int, Filter]]) -> DataFrame:
    """The hashes ``h`` that stand for a surviving window at two places or more."""
    model = docs.sparkSession.sparkContext.broadcast(passed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_groups(batches, 2):
            w = Words(part.column(2))
            alive, _, at = _survivors(w, window, model.value)
            if not alive.any():
                continue
            h = w.prefix.all(length)
            h, n = np.unique(h[np.unique(extended(h, window, length, at)[alive])], return_counts=True)
            yield batch(h=pa.array(h.view(np.int64)), n=pa.array(n.astype(np.int32)))

    return docs.mapInArrow(run, "h long, n int").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")


def _runs(w: Words, window: int, passed: list[tuple[int, Filter]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and past-last window of each stretch of neighbouring survivors with one stand-in, and the stand-ins."""
    alive, first, _ = _survivors(w, window, passed)
    at = np.nonzero(alive)[0]
    if not len(at):
        return at, at, first
    new = np.concatenate([[True], (np.diff(at) > 1) | (first[at[1:]] != first[at[:-1]]) | (w.doc[at[1:]] != w.doc[at[:-1]])])
    starts = np.nonzero(new)[0]
    return at[starts], at[np.append(starts[1:], len(at)) - 1] + 1, first


def _places(h: np.ndarray, lo: np.ndarray, n: np.ndarray, a: np.ndarray) -> np.ndarray:
    """How often each a is among the n hashes from lo."""
    which = np.repeat(np.arange(len(lo)), n)
    at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + lo[which]
    return np.bincount(which, h[at] == a[which], minlength=len(lo))


class Seen:
    """Digests that a task met, with their earliest places so far."""

    def __init__(self):
        self.first: dict[tuple[int, int], tuple[int, int, int]] = {}

    def later(self, k1: np.ndarray, k2: np.ndarray, doc: np.ndarray, th: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Mask of rows whose digest this task also met at an earlier (doc, th, lo), here or before."""
        order = np.lexsort((lo, th, doc, k2, k1))
        k = k1[order], k2[order]
        same = np.concatenate([[False], (k[0][1:] == k[0][:-1]) & (k[1][1:] == k[1][:-1])])
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        out = np.zeros(len(order), bool)
        out[order] = same & ((doc[order] != doc[order][head]) | (th[order] != th[order][head]) | (lo[order] != lo[order][head]))
        here = np.nonzero(~out)[0]
        for i, *x in zip(here.tolist(), *(c[here].tolist() for c in (k1, k2, doc, th, lo)), strict=True):
            key, place = (x[0], x[1]), (x[2], x[3], x[4])
            held = self.first.get(key)
            if held is None:
                if len(self.first) < REMEMBERED:
                    self.first[key] = place
            elif held < place:
                out[i] = True
            else:
                self.first[key] = place
        return out


def _ranked(rows: DataFrame) -> DataFrame:
    """``later`` for rows whose digest (k1, k2) is also at an earlier (doc, th, lo). Rows known to be later in their
    task keep that mark and come under keys of their own, so a hot digest brings few rows a task to its window."""
    rows = rows.withColumn("k1", F.when(F.col("later"), F.xxhash64("doc", "th", "lo")).otherwise(F.col("k1")))
    return rows.withColumn("later", F.col("later") | (F.rank().over(Window.partitionBy("k1", "k2").orderBy("later", "doc", "th", "lo")) > 1))


_ROW = "doc long, th long, lo int, k1 long, k2 long, later boolean"


def _rows(part: pa.RecordBatch, w: Words, at: np.ndarray, n: np.ndarray, seen: Seen) -> dict[str, pa.Array]:
    doc, th = (part.column(i).to_numpy(zero_copy_only=False)[w.doc[at]] for i in (0, 1))
    lo, (k1, k2) = w.at[at], w.digests(at, n)
    return {"doc": pa.array(doc), "th": pa.array(th), "lo": pa.array(lo.astype(np.int32)), "k1": pa.array(k1), "k2": pa.array(k2), "later": pa.array(seen.later(k1, k2, doc, th, lo))}


def _stretches(docs: DataFrame, window: int, passed: list[tuple[int, Filter]]) -> DataFrame:
    """(doc, th, lo, k1, k2, later, len, a, own): stretches of neighbouring surviving windows with one stand-in ``a``:
    ``len`` windows from word ``lo``, with the digest of their words; ``own`` if the stand-in is there more than once,
    so that a window may be repeated inside the stretch."""
    model = docs.sparkSession.sparkContext.broadcast(passed)
    length = passed[0][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for part in text_groups(batches, 2):
            w = Words(part.column(2))
            lo, hi, first = _runs(w, window, model.value)
            if not len(lo):
                continue
            n, a = hi - lo, first[lo]
            own = _places(w.prefix.all(length), lo, n + window - length, a) > 1
            yield batch(**_rows(part, w, lo, n + window - 1, seen), len=pa.array(n.astype(np.int32)), a=pa.array(a.view(np.int64)), own=pa.array(own))

    return docs.mapInArrow(run, _ROW + ", len int, a long, own boolean")


def _place_hash(doc: np.ndarray, th: np.ndarray, lo: np.ndarray) -> np.ndarray:
    a, b, c = (x.astype(np.int64).view(np.uint64) for x in (doc, th, lo))
    return _mix(_mix(a * np.uint64(_BASES[0]) ^ b) + c * np.uint64(_BASES[1]))


def _windows_of(docs: DataFrame, window: int, passed: list[tuple[int, Filter]], chosen: Filter) -> DataFrame:
    """(doc, th, lo, k1, k2, later) of every single window in the chosen stretches."""
    model = docs.sparkSession.sparkContext.broadcast((passed, chosen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed, chosen = model.value
        seen = Seen()
        for part in text_groups(batches, 2):
            w = Words(part.column(2))
            lo, hi, _ = _runs(w, window, passed)
            doc, th = (part.column(i).to_numpy(zero_copy_only=False)[w.doc[lo]] for i in (0, 1))
            take = chosen.has(_place_hash(doc, th, w.at[lo]))
            if not take.any():
                continue
            lo, n = lo[take], (hi - lo)[take]
            i = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            yield batch(**_rows(part, w, i, np.full(len(i), window), seen))

    return docs.mapInArrow(run, _ROW)


def _place_filter(places: DataFrame) -> Filter:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(h=pa.array(_place_hash(*(b.column(i).to_numpy() for i in range(3))).view(np.int64)))

    return make_filter(places.mapInArrow(run, "h long"))


def repeated_spans(docs: DataFrame, *, window: int = WINDOW, first: int = FIRST_LEVEL) -> DataFrame:
    """(doc, th, lo, hi): word spans [lo, hi) covered by windows whose words also start earlier, by doc, th and place.
    ``docs`` has ``doc`` and ``th`` (long, not null) and ``b`` (UTF-8 text)."""
    passed: list[tuple[int, Filter]] = []
    for length in levels(window, first):
        again = make_filter(repeated_standins(docs, window, length, passed))
        passed = [*passed, (length, again)]
        if not again.words.any():  # no candidate survives
            return docs.sparkSession.createDataFrame([], "doc long, th long, lo int, hi int")
    if not passed:
        raise ValueError("the first level must be shorter than the window")
    stretches = written(_ranked(_stretches(docs, window, passed)).select("doc", "th", "lo", "len", "a", "own", "later", F.xxhash64("k1", "k2").alias("kind")))
    whole = stretches.where("later").select("doc", "th", "lo", (F.col("lo") + F.col("len") + (window - 1)).cast("int").alias("hi"))
    # a stand-in that is once in one kind of stretch has nothing left to compare
    starts = stretches.where("NOT later").select("doc", "th", "lo", "a", "own")
    mixed = stretches.where("NOT later").groupBy("a").agg((F.min("kind") < F.max("kind")).alias("mixed")).where("mixed").select("a")
    places = starts.where("own").unionByName(starts.where("NOT own").join(mixed, "a", "left_semi").select(*starts.columns)).select("doc", "th", "lo")
    single = _ranked(_windows_of(docs, window, passed, _place_filter(places))).where("later").select("doc", "th", "lo", (F.col("lo") + window).cast("int").alias("hi"))
    return whole.unionAll(single)


def drop_repeats(docs: DataFrame, *, text: str = "text", window: int = WINDOW, first: int = FIRST_LEVEL) -> DataFrame:
    """doc_id, n_words, n_removed and ``kept_text``: each whole text without the words covered by a window of
    ``window`` words that also starts earlier, its kept words joined by one space.

    "Earlier" is by doc_id, then by place in the document, on the texts as given. Rows that share a doc_id and their
    text are one document, given more than once: they keep the same words and are not removed against each other. Rows
    that share a doc_id but not their text are documents of their own, ordered by a hash of the text; so are rows with
    a null doc_id, which come after all others. Null and blank texts have no words; an empty table gives an empty
    result; other columns are ignored, whatever their names.

    Copies and shared passages cost one row a stretch of windows and place. A task marks what is repeated among its
    own texts before anything is shuffled and remembers REMEMBERED digests, so a hot passage sends a row or a few for
    each task. Filters held by tasks have 8 bits a repeated hash and FILTER_BITS at most; with far more hashes they
    sieve less and more windows reach the comparison of digests, which is exact.
    """
    late = F.lit((1 << 63) - 1)
    slim = docs.select(F.coalesce(F.col("doc_id").cast("long"), late).alias("doc"), F.xxhash64(utf8(text)).alias("th"), utf8(text).alias("b"))
    spans = repeated_spans(slim, window=window, first=first).groupBy("doc", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), late).alias("doc"), F.xxhash64(utf8(text)).alias("th"), utf8(text).alias("b"))
    joined = given.join(spans, ["doc", "th"], "left").select("doc_id", "b", F.col("spans.lo").alias("lo"), F.col("spans.hi").alias("hi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_groups(batches, 1):
            n_words, n_removed, kept = [], [], []
            for b, lo, hi in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                words = b.split()
                n_words.append(len(words))
                if lo:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, lo, 1)
                    np.add.at(edge, hi, -1)
                    words = [words[i] for i in np.nonzero(np.cumsum(edge)[:-1] == 0)[0]]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield batch(doc_id=part.column(0), n_words=pa.array(n_words, pa.int64()), n_removed=pa.array(n_removed, pa.int64()), kept_text=pa.array(kept, pa.string()))

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")


def repeat_report(docs: DataFrame) -> DataFrame:
    return drop_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


REPEAT_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i + 1 : i + 20], ' ') AS k FROM d, LATERAL (SELECT unnest(range(greatest(len(w) - 19, 0))) AS i)
), late AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, i + j.range AS p FROM late, range(20) j
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM d
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
