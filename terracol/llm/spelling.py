"""Spelling variants: frequent words one edit apart, found by composing acceptors of the vocabulary with a one-edit
transducer.

A pair of lengths m and m or m + 1 shares either the first m // 2 characters or the last m - m // 2. So the vocabulary
is dealt into parts, each the words behind one state of the acceptor: of the forward one after the first half, of the
backward one after the last. A task builds a part's minimised acceptors, composes them with the transducer (keep, replace
or insert one character) and enumerates the accepted pairs. Every pair is found in one part, once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, discard, shuffle_partitions, slices, utf8, written

#: Latin letters, once A-Z are lower case.
_RUN = re.compile("[a-zÀ-ÿ]+")
#: Words of a part that one task composes; larger parts are dealt out further, by the place of the edit.
PART_WORDS = 1 << 16
#: Different words whose counts a task holds.
HELD_WORDS = 1 << 17


def runs_of(text: bytes, doc_id: int | None, spoil: int | None) -> Counter:
    """Counts of a text's runs of Latin letters, A-Z in lower case. With ``spoil`` a run loses its character
    h % length where spoil divides h, the crc32 of ``doc_id:run``."""
    found = Counter(_RUN.findall(text.lower().decode("utf-8", "replace")))
    if not spoil:
        return found
    start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
    hashes = {run: crc32(run.encode(), start) for run in found}
    # all runs are judged as they were read, since a spoiled one may equal another
    changed = [(run[: h % len(run)] + run[h % len(run) + 1 :], found.pop(run)) for run, h in hashes.items() if h % spoil == 0]
    for word, n in changed:
        found[word] += n
    return found


def vocabulary(docs: DataFrame, *, text: str = "text", min_chars: int = 6, min_count: int = 5, spoil: int | None = None) -> DataFrame:
    """(word, n): the words of at least ``min_chars`` code points that occur at least ``min_count`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for part in slices(batches, 256):
            for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                for word, n in runs_of(t, i, spoil).items():
                    if len(word) >= min_chars:
                        held[word] = held.get(word, 0) + n
            if len(held) > HELD_WORDS:
                yield batch(word=pa.array(held), n=pa.array(held.values(), pa.int64()))
                held = {}
        if held:
            yield batch(word=pa.array(held), n=pa.array(held.values(), pa.int64()))

    counts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(text).alias("b")).mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# --- acceptors --------------------------------------------------------------------------------------------------
class Acceptor:
    """The minimal deterministic acceptor of a sorted list of different words: ``arcs[state]`` maps characters to
    states; words of one length end in the one state without arcs."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = []
        known: dict[tuple, int] = {}
        open_: list[dict[str, int]] = [{}]  # the states along the last word; arcs to the next one are still missing

        def close(depth: int, last: str) -> None:
            while len(open_) > depth + 1:
                arcs = open_.pop()
                key = tuple(arcs.items())
                if key not in known:
                    known[key] = len(self.arcs)
                    self.arcs.append(arcs)
                open_[-1][last[len(open_) - 1]] = known[key]

        last = ""
        for word in words:
            same = next((i for i, (x, y) in enumerate(zip(last, word, strict=False)) if x != y), min(len(last), len(word)))
            close(same, last)
            open_ += [{} for _ in word[same:]]
            last = word
        close(0, last)
        self.arcs.append(open_[0])
        self.start = len(self.arcs) - 1


class Common:
    """Strings that two acceptors' states both accept, with the pairs of states that share none remembered."""

    def __init__(self, left: list[dict[str, int]], right: list[dict[str, int]]):
        self.left, self.right, self.none = left, right, set()

    def strings(self, p: int, q: int) -> Iterator[str]:
        left, right, none = self.left, self.right, self.none
        if (p, q) in none:
            return
        # depth first; a pair of states is remembered as empty once all below it was seen and gave nothing
        path: list[str] = []
        stack = [(p, q, iter(left[p].items()))]
        gave = [not left[p] and not right[q]]
        if gave[0]:
            yield ""
            return
        while stack:
            a, b, arcs = stack[-1]
            other = right[b]
            for c, to in arcs:
                there = other.get(c)
                if there is None or (to, there) in none:
                    continue
                if not left[to] and not right[there]:
                    gave[-1] = True
                    yield "".join(path) + c
                    continue
                path.append(c)
                stack.append((to, there, iter(left[to].items())))
                gave.append(False)
                break
            else:
                stack.pop()
                if not gave.pop():
                    none.add((a, b))
                elif gave:
                    gave[-1] = True
                if path:
                    path.pop()


def replaced(a: Acceptor) -> Iterator[tuple[str, str]]:
    """Pairs of accepted words that differ in one character, the smaller first."""
    common = Common(a.arcs, a.arcs)
    stack = [(a.start, "")]
    while stack:
        state, path = stack.pop()
        arcs = sorted(a.arcs[state].items())
        for i, (c, p) in enumerate(arcs):
            stack.append((p, path + c))
            for d, q in arcs[i + 1 :]:
                for rest in common.strings(p, q):
                    yield path + c + rest, path + d + rest


def inserted(a: Acceptor, b: Acceptor) -> Iterator[tuple[str, str]]:
    """Pairs of a word of a and the word of b that has one character more. Of the places of one run of equal
    characters the first takes the insertion."""
    common = Common(a.arcs, b.arcs)
    stack = [(a.start, b.start, "")]
    while stack:
        p, q, path = stack.pop()
        for d, to in b.arcs[q].items():
            if path[-1:] != d:
                for rest in common.strings(p, to):
                    yield path + rest, path + d + rest
            if d in a.arcs[p]:
                stack.append((a.arcs[p][d], to, path + d))


def part_pairs(words: list[str], size: int, backward: bool) -> Iterator[tuple[str, str]]:
    """The pairs one edit apart of a part's words of ``size`` and size + 1 characters: forward, those that share the first
    size // 2 characters; backward, those that share the others, and not the first."""
    half = size // 2
    turn = (lambda w: w[::-1]) if backward else (lambda w: w)
    same = size - half if backward else half
    turned = sorted(turn(w) for w in words)
    head = turned[0][:same]
    short = Acceptor([w[same:] for w in turned if len(w) == size])
    for x, y in replaced(short):
        yield turn(head + x), turn(head + y)
    long = [w[same:] for w in turned if len(w) > size]
    if long and len(long) < len(turned):
        for x, y in inserted(short, Acceptor(long)):
            x, y = turn(head + x), turn(head + y)
            if not backward or x[:half] != y[:half]:
                yield x, y


# --- pairs of the whole vocabulary ------------------------------------------------------------------------------
def near_pairs(words: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """(word, n, near, near_n): every word with each word one edit away, from (word, n) of different non-empty words.

    A word goes to four parts: with its own length and as the longer one of a pair, forward and backward. A part of more
    than ``part_words`` words is dealt out by the place of the edit: words go by what is left of them around each place
    behind the shared half, which few others share, so no part is held by one task, however many words begin alike.
    """
    spark = words.sparkSession
    size = F.char_length("word")
    rows = words.select("word", "n", F.explode(F.array(*[F.struct((size - off).alias("size"), F.lit(back).alias("back")) for off in (0, 1) for back in (False, True)])).alias("p")).select("word", "n", "p.*").where("size > IF(back, 1, 0)")
    half = F.floor(F.col("size") / 2).cast("int")
    rows = rows.withColumn("key", F.when(F.col("back"), F.expr("right(word, size - int(size / 2))")).otherwise(F.expr("left(word, int(size / 2))")))
    counts = rows.groupBy("size", "back", "key").agg(F.count("*").alias("rows")).where("rows > 1")
    rows = rows.join(counts, ["size", "back", "key"])
    small = rows.where(F.col("rows") <= part_words)
    ready = small.select("size", "back", "key", "word", "n").repartition(shuffle_partitions(spark), "size", "back", "key").sortWithinPartitions("size", "back", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        now, out = None, ([], [], [], [])

        def found() -> Iterator[pa.RecordBatch]:
            for x, y in part_pairs(list(held), now[0], now[1]) if len(held) > 1 else ():
                for a, b in ((x, y), (y, x)):
                    for column, v in zip(out, (a, held[a], b, held[b]), strict=True):
                        column.append(v)
                if len(out[0]) > 1 << 14:
                    yield flush()

        def flush() -> pa.RecordBatch:
            made = batch(word=pa.array(out[0], pa.string()), n=pa.array(out[1], pa.int64()), near=pa.array(out[2], pa.string()), near_n=pa.array(out[3], pa.int64()))
            for column in out:
                column.clear()
            return made

        for part in slices(batches, 4096):
            for size_, back, key, word, n in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if now != (size_, back, key):
                    yield from found()
                    now, held = (size_, back, key), {}
                held[word] = n
        yield from found()
        yield flush()

    pairs = ready.mapInArrow(run, "word string, n long, near string, near_n long")
    large = rows.where(F.col("rows") > part_words)
    return pairs.unionByName(_by_place(large, half))


def _by_place(rows: DataFrame, half: Column) -> DataFrame:
    """near_pairs of parts too large for a task: words meet where they are equal but for one place of the changed half."""
    long = F.char_length("word") > F.col("size")
    first, last = F.when(F.col("back"), F.lit(0)).otherwise(half), F.when(F.col("back"), half).otherwise(F.col("size"))
    # replaced: without the character at each place; inserted: the longer word without one, the shorter as it is
    cut = rows.withColumn("at", F.explode(F.sequence(first, F.when(long, last).otherwise(last - 1))))
    without = F.concat(F.expr("left(word, at)"), F.expr("substr(word, at + 2)"))
    spots = cut.where(~long).select("size", "back", "at", without.alias("rest"), "word", "n")
    other = spots.select("size", "back", "at", "rest", F.col("word").alias("near"), F.col("n").alias("near_n"))
    swapped = spots.join(other, ["size", "back", "at", "rest"]).where("word <> near").select("word", "n", "near", "near_n")
    longer = cut.where(long).select("size", "back", without.alias("rest"), F.col("word").alias("near"), F.col("n").alias("near_n")).distinct()
    shorter = rows.where(~long).select("size", "back", F.col("word").alias("rest"), "word", "n")
    met = shorter.join(longer, ["size", "back", "rest"]).where("NOT back OR left(word, int(size / 2)) <> left(near, int(size / 2))").select("word", "n", "near", "near_n")
    return swapped.unionByName(met).unionByName(met.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def variant_forms(words: DataFrame, *, ratio: int = 5, part_words: int = PART_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of (word, n): ``form`` is the near word of largest n (ties: the smallest in
    code-point order) where that is at least ``ratio`` times the word's n; ``root`` ends the chain of forms."""
    words = written(words)
    best = near_pairs(words, part_words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b"))
    found = words.join(best, "word", "left").withColumn("m", -F.col("b.m")).withColumn("has", F.coalesce(F.col("m") >= ratio * F.col("n"), F.lit(False)))
    formed = written(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("has"), F.col("b.near")).alias("form"), F.when(F.col("has"), F.col("m")).alias("form_n")))
    # a form's n is several times its word's, so chains are short and halve each round
    chains = written(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        step = written(chains.join(chains.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(chains)
        chains = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return formed.join(chains, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, *, text: str = "text", min_chars: int = 6, min_count: int = 5, ratio: int = 5, spoil: int | None = None) -> DataFrame:
    """Frequent words of all texts with the spelling each is taken to stand for: word, form, root, n, n_near, form_n.

    Words are the maximal runs of ``[A-Za-zÀ-ÿ]`` in whole texts, A-Z in lower case, of at least ``min_chars`` code
    points and ``min_count`` occurrences; two are near if one inserted, deleted or replaced code point makes them equal.
    ``spoil`` takes a character out of a share of the runs (see runs_of). Null and blank texts have no words, texts of
    any length count whole, repeated rows count each, a null doc_id only matters for ``spoil``, where it counts as an
    empty id. No words give an empty result; other columns are ignored.
    """
    return variant_forms(vocabulary(docs, text=text, min_chars=min_chars, min_count=min_count, spoil=spoil), ratio=ratio)


def variant_report(docs: DataFrame) -> DataFrame:
    return spelling_variants(docs, spoil=199)


# crc32 by its polynomial, bit by bit into a table of a byte's values, then byte by byte
VARIANT_SQL = r"""
WITH RECURSIVE bits(b, c, k) AS (
  SELECT range::BIGINT, range::BIGINT, 0 FROM range(256)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8), runs AS (
  SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(hex(encode(s))) // 2 + 1), lambda i: ('0x' || hex(encode(s))[2 * i - 1:2 * i])::BIGINT)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS h
  FROM (SELECT *, coalesce(doc_id::VARCHAR, '') || ':' || run AS s FROM runs), crc
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN run[1:h % len(run)] || run[h % len(run) + 2:] ELSE run END AS word, n FROM hashed) GROUP BY word HAVING len(word) >= 6 AND sum(n) >= 5
), cuts AS (
  SELECT word, n, i, word[1:i] || word[i + 2:] AS rest FROM (SELECT word, n, unnest(range(len(word))) AS i FROM words)
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT w.word, w.n, c.word, c.n FROM words w JOIN cuts c ON c.rest = w.word
  UNION SELECT c.word, c.n, w.word, w.n FROM words w JOIN cuts c ON c.rest = w.word
), best AS (
  SELECT word, count(*)::BIGINT AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * w.n THEN other END AS form, CASE WHEN m >= 5 * w.n THEN m END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word
), walk(word, stop) AS (
  SELECT word, word FROM formed UNION ALL SELECT w.word, f.form FROM walk w JOIN formed f ON f.word = w.stop WHERE f.form IS NOT NULL
), roots AS (SELECT w.word, w.stop AS root FROM walk w JOIN formed f ON f.word = w.stop WHERE f.form IS NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM formed f JOIN roots r ON r.word = f.word
"""
