"""Language-model scores from a hidden Markov model trained by Baum-Welch over the whole corpus.

States emit symbols: each frequent word is a symbol, the other words fall into hashed classes, inside which a word
has its smoothed share of the class. A word's probability is its symbol's times its share, so texts of any words
have an exact probability.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, slices, utf8, written

STATES = 4
#: Most words that are symbols of their own (the rest share CLASSES symbols): bounds the model and what a task sends.
SYMBOLS = 1 << 18
CLASSES = 256
#: Baum-Welch passes over all training documents: the first in so many shares, with a new model after each, then in whole
#: rounds. The same at every size.
SHARES, ROUNDS = 16, 1
#: Share of the unigram distribution in each state's emissions.
PRIOR = 0.15
CHUNK = 64
#: Places of padded chunks that a task holds at a time.
BATCH_PLACES = 1 << 18
#: The end of a text; no word is empty.
END = b""


@dataclass
class Vocabulary:
    """Training counts of the words that are symbols, and totals; all of bounded size."""

    index: dict[bytes, int]
    counts: np.ndarray
    class_counts: np.ndarray
    class_words: np.ndarray
    tokens: int
    words: int
    logs: np.ndarray = field(init=False)

    def __post_init__(self):
        self.logs = np.log10((self.counts + 0.5) / (self.tokens + 0.5 * (self.words + 1)))

    @property
    def unigram(self) -> np.ndarray:
        x = np.concatenate([self.counts.astype(float), self.class_counts + 0.5])
        return x / x.sum()


@dataclass
class Model:
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray


def _class(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) % CLASSES


def training_counts(docs: DataFrame) -> DataFrame:
    """(word binary, n) over rows (held_out, b); counts are added up in each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def rows():
            out = batch(word=pa.array(list(counts), pa.binary()), n=pa.array(list(counts.values()), pa.int64()))
            counts.clear()
            return out

        for part in slices(batches):
            for text in part.column(0).to_pylist():
                counts.update(text.lower().split())
                counts[END] += 1
            if len(counts) > 300_000:
                yield rows()
        if counts:
            yield rows()

    return docs.where("NOT held_out").select("b").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> tuple[Vocabulary, int]:
    """Totals and the most frequent words; also the count from which words are symbols. SYMBOLS words and a row for
    each class and each distinct count reach the driver."""
    tokens, words = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    spread = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(SYMBOLS + 1).collect()
    least, held = (spread[0]["n"] + 1 if spread else 1), 0
    for r in spread:
        if held + r["words"] > SYMBOLS:
            break
        least, held = r["n"], held + r["words"]
    top = counts.where(F.col("n") >= least).toArrow().to_pandas().sort_values("word")
    index = {bytes(w): i for i, w in enumerate(top["word"])}
    rest = counts.where(F.col("n") < least)
    class_counts, class_words = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, w = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for part in batches:
            at = np.array([_class(x) for x in part.column(0).to_pylist()], dtype=np.int64)
            np.add.at(c, at, part.column(1).to_numpy())
            np.add.at(w, at, 1)
        yield batch(at=pa.array(np.arange(CLASSES)), c=pa.array(c), w=pa.array(w))

    for r in rest.mapInArrow(run, "at long, c long, w long").groupBy("at").agg(F.sum("c").alias("c"), F.sum("w").alias("w")).collect():
        class_counts[r["at"]], class_words[r["at"]] = r["c"], r["w"]
    return Vocabulary(index, top["n"].to_numpy(np.int64), class_counts, class_words, tokens, words), least


def encoded(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Rows (doc_id, held_out, b) as symbols: doc_id, held_out, symbols array<int>, n_known and base (log10) of the
    words that are symbols, and ``rare``, the other words with their classes and counts."""
    model = docs.sparkSession.sparkContext.broadcast(vocab)
    schema = "doc_id long, held_out boolean, symbols array<int>, n_known long, base double, rare array<struct<word: binary, class: int, n: int>>"
    kind = pa.list_(pa.struct([("word", pa.binary()), ("class", pa.int32()), ("n", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = model.value
        get, size = v.index.get, len(v.index)
        for part in slices(batches, 512):
            symbols, known, base, rare = [], [], [], []
            for text in part.column(2).to_pylist():
                words = text.lower().split()
                words.append(END)
                found = list(map(get, words))
                others: Counter = Counter()
                if None in found:
                    for i, x in enumerate(found):
                        if x is None:
                            others[words[i]] += 1
                            found[i] = size + _class(words[i])
                s = np.array(found, dtype=np.int32)
                heads = s[s < size]
                symbols.append(s)
                known.append(len(heads))
                base.append(float(v.logs[heads].sum()))
                rare.append([{"word": w, "class": _class(w), "n": n} for w, n in others.items()])
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in symbols])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(symbols)))
            yield batch(doc_id=part.column(0), held_out=part.column(1), symbols=lists, n_known=pa.array(known, pa.int64()), base=pa.array(base), rare=pa.array(rare, kind))

    return docs.select("doc_id", "held_out", "b").mapInArrow(run, schema)


class Chunks:
    """Sequences cut into chunks of CHUNK symbols, longest chunks first, so that all chunks advance together."""

    def __init__(self, sequences: list[np.ndarray]):
        n = np.array([len(s) for s in sequences])
        per = -(-n // CHUNK)
        owner = np.repeat(np.arange(len(n)), per)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        length = np.minimum(CHUNK, n[owner] - place * CHUNK)
        order = np.argsort(-length, kind="stable")
        self.n, self.owner, self.place, self.length = len(n), owner[order], place[order], length[order]
        self.first = self.place == 0
        flat = np.concatenate(sequences)
        begin = (np.cumsum(n) - n)[self.owner] + self.place * CHUNK
        at = begin[:, None] + np.minimum(np.arange(CHUNK)[None, :], self.length[:, None] - 1)
        self.symbols = flat[at]
        self.active = [int((self.length > t).sum()) for t in range(CHUNK + 1)]
        self.by_place = np.split(np.argsort(self.place, kind="stable"), np.cumsum(np.bincount(self.place))[:-1])

    def transfer(self, m: Model) -> tuple[np.ndarray, np.ndarray]:
        """Each chunk's product of (step x emission) matrices, scaled, and the log of the scale."""
        k = len(m.start)
        b = m.emit[self.symbols[:, 0]]
        mat = np.where(self.first[:, None, None], np.eye(k)[None], m.step[None]) * b[:, None, :]
        logs = np.zeros(len(mat))

        def rescale():
            s = mat.max(axis=(1, 2))
            mat[...] /= s[:, None, None]
            logs[...] += np.log(s)

        rescale()
        for t in range(1, CHUNK):
            n = self.active[t]
            if not n:
                break
            mat[:n] = (mat[:n].reshape(-1, k) @ m.step).reshape(n, k, k) * m.emit[self.symbols[:n, t]][:, None, :]
            if t % 8 == 0:
                rescale()
        rescale()
        return mat, logs

    def forward(self, m: Model, mat: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled state vector before each chunk, and each sequence's log probability (natural)."""
        v = np.repeat(m.start[None], self.n, axis=0)
        total = np.zeros(self.n)
        before = np.empty((len(mat), len(m.start)))
        for rows in self.by_place:
            d = self.owner[rows]
            before[rows] = v[d]
            x = np.einsum("ni,nij->nj", v[d], mat[rows])
            s = x.sum(axis=1)
            v[d] = x / s[:, None]
            total[d] += np.log(s) + logs[rows]
        return before, total

    def log_probabilities(self, m: Model) -> np.ndarray:
        return self.forward(m, *self.transfer(m))[1]

    def expected(self, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of starts, of steps, and of each state at each (chunk, place)."""
        k = len(m.start)
        mat, logs = self.transfer(m)
        before, _ = self.forward(m, mat, logs)
        after = np.ones((len(mat), k))
        w = np.ones((self.n, k))
        for rows in reversed(self.by_place):
            d = self.owner[rows]
            after[rows] = w[d]
            x = np.einsum("nij,nj->ni", mat[rows], w[d])
            w[d] = x / x.sum(axis=1)[:, None]
        b = m.emit[self.symbols]
        alpha = np.zeros((len(mat), CHUNK, k))
        a = np.where(self.first[:, None], m.start[None], before @ m.step) * b[:, 0]
        alpha[:, 0] = a / a.sum(axis=1)[:, None]
        for t in range(1, CHUNK):
            n = self.active[t]
            if not n:
                break
            a = (alpha[:n, t - 1] @ m.step) * b[:n, t]
            alpha[:n, t] = a / a.sum(axis=1)[:, None]
        steps = np.zeros((k, k))
        gamma = np.zeros((len(mat), CHUNK, k))
        beta = after.copy()
        for t in range(CHUNK - 1, -1, -1):
            n, longer = self.active[t], self.active[t + 1]
            if not n:
                continue
            if longer:
                beta[:longer] = ahead[:longer] @ m.step.T  # noqa: F821  (set at t + 1)
                beta[:longer] /= beta[:longer].sum(axis=1)[:, None]
            g = alpha[:n, t] * beta[:n]
            gamma[:n, t] = g / g.sum(axis=1)[:, None]
            ahead = b[:n, t] * beta[:n]
            rows = slice(0, n) if t else ~self.first
            u = alpha[:n, t - 1] if t else before[rows]
            x = ahead if t else ahead[rows]
            if len(u):
                z = ((u @ m.step) * x).sum(axis=1)
                steps += (u / z[:, None]).T @ x
        return gamma[self.first, 0].sum(axis=0), steps * m.step, gamma

    def counts(self, m: Model, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start, steps, gamma = self.expected(m)
        inside = np.arange(CHUNK)[None, :] < self.length[:, None]
        s, g = self.symbols[inside], gamma[inside]
        return start, steps, np.stack([np.bincount(s, g[:, j], minlength=size) for j in range(g.shape[1])], axis=1)


def _groups(sequences: Iterator[np.ndarray]) -> Iterator[list[np.ndarray]]:
    held, n = [], 0
    for s in sequences:
        held.append(s)
        n += -(-len(s) // CHUNK) * CHUNK
        if n >= BATCH_PLACES:
            yield held
            held, n = [], 0
    if held:
        yield held


def _sequences(column: pa.Array) -> Iterator[np.ndarray]:
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    offsets = offsets - offsets[0]
    return (flat[a:z] for a, z in zip(offsets[:-1], offsets[1:], strict=True))


def maximise(start: np.ndarray, steps: np.ndarray, emits: np.ndarray, unigram: np.ndarray) -> Model:
    emits = (1 - PRIOR) * emits / np.maximum(emits.sum(axis=0)[None], 1e-300) + PRIOR * unigram[:, None]
    steps = steps + 1.0
    start = start + 1.0
    return Model(start / start.sum(), steps / steps.sum(axis=1)[:, None], emits / emits.sum(axis=0)[None])


def first_model(unigram: np.ndarray, states: int = STATES, seed: int = 5) -> Model:
    """Where Baum-Welch begins: seeded noise around the unigram distribution, and states that tend to stay as they are."""
    rng = np.random.default_rng(seed)
    step = np.full((states, states), 0.05 / max(1, states - 1))
    np.fill_diagonal(step, 0.95 if states > 1 else 1.0)
    noise = unigram[:, None] * rng.gamma(1.0, 1.0, (len(unigram), states)) + 1e-12
    return Model(np.full(states, 1 / states), step, noise / noise.sum(axis=0)[None])


def corpus_counts(symbols: DataFrame, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of starts, steps and emissions over the rows (symbols). A task sends a row for each symbol it
    met; they are added up by symbol, and one row a symbol reaches the driver."""
    size, states = m.emit.shape
    names = [f"s{j}" for j in range(states)]
    shared = symbols.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        start, steps, emits = np.zeros(states), np.zeros((states, states)), np.zeros((size, states))
        for group in _groups(s for b in batches for s in _sequences(b.column(0))):
            a, b, c = Chunks(group).counts(model, size)
            start += a
            steps += b
            emits += c
        at = np.nonzero(emits.any(axis=1))[0]
        rows = np.concatenate([emits[at], steps, start[None]])
        ids = np.concatenate([at, size + np.arange(states + 1)])
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), *(pa.array(rows[:, j]) for j in range(states))], names=["symbol", *names])

    # a task for each core: more would each send the same frequent symbols again
    few = symbols.coalesce(symbols.sparkSession.sparkContext.defaultParallelism)
    found = few.mapInArrow(run, "symbol int, " + ", ".join(f"{n} double" for n in names)).groupBy("symbol").agg(*[F.sum(n).alias(n) for n in names]).toArrow().to_pandas()
    counts = np.zeros((size + states + 1, states))
    counts[found["symbol"].to_numpy()] = found[names].to_numpy()
    return counts[-1], counts[size : size + states], counts[:size]


def train(coded: DataFrame, vocab: Vocabulary, states: int = STATES, shares: int = SHARES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch from seeded noise over the training rows (symbols, share), every count taken from the partitions.

    The first pass reads share after share: each one's counts, scaled to the corpus, are blended into those so far,
    with less weight for later ones, and give the next model (stepwise Baum-Welch), so the states come apart in one
    pass over all documents. Each of the ``rounds`` then takes all counts anew. A share without documents is passed
    over. SYMBOLS + CLASSES rows at most reach the driver at a time."""
    unigram = vocab.unigram
    m, kept = first_model(unigram, states), None
    for i in range(shares + rounds):
        found = corpus_counts((coded.where(F.col("share") == i) if i < shares else coded).select("symbols"), m)
        if not found[2].any():
            continue
        if i < shares:
            scale = vocab.tokens / found[2].sum()
            weight = 1.0 if kept is None else (i + 2) ** -0.6
            found = kept = tuple(weight * scale * x + (0 if kept is None else (1 - weight) * kept[j]) for j, x in enumerate(found))
        m = maximise(*found, unigram)
    return m


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def score_documents(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (both log10) of every whole text.

    Learns from the documents whose crc32(doc_id as text) mod 5 is not 1 (a null doc_id counts as an empty one).
    Tokens are A-Z lower-cased words and one end a text; null and blank texts are the end alone. base_score is the
    smoothed unigram model, score the hidden Markov model. Repeated rows are learnt from and scored one by one. An
    empty table gives an empty result; with nothing to learn from, all words are unknown. Other columns are ignored.

    Each text is read twice, to count words and to write it as symbols; training and scoring read the symbols. Word
    counts, the words that are no symbols, and expected counts are shuffled by word or symbol after being added up
    in the task; a task holds the model (bounded by SYMBOLS) and one batch of sequences. The forward recursion is
    carried over the chunks of a text, so scores are exact however long it is.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), utf8(text).alias("b"))
    counts = written(training_counts(slim))
    vocab, least = vocabulary(counts)
    coded = encoded(slim, vocab).withColumn("row", F.monotonically_increasing_id())
    coded = written(coded.withColumn("share", F.pmod(F.xxhash64("row"), F.lit(SHARES)).cast("int")), "share")
    model = train(coded.where("NOT held_out").select("symbols", "share"), vocab)
    spark = docs.sparkSession

    total = F.lit(float(vocab.tokens + 0.5 * (vocab.words + 1)))
    classes = spark.createDataFrame([(i, float(vocab.class_counts[i] + 0.5 * (vocab.class_words[i] + 1))) for i in range(CLASSES)], "class int, mass double")
    rare = coded.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.class", "r.n")
    known = counts.where(F.col("n") < least).select("word", F.col("n").alias("c"))
    joined = rare.join(known, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    joined = joined.join(F.broadcast(classes), "class")
    sums = joined.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("n") * F.log10((F.col("c") + 0.5) / total)).alias("rare_base"),
        F.sum(F.col("n") * F.log10((F.col("c") + 0.5) / F.col("mass"))).alias("rare_share"),
    )
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [Chunks(g).log_probabilities(shared.value) for g in _groups(_sequences(b.column(0)))]
            score = np.concatenate(found) / np.log(10) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(score)], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"])

    scored = coded.select("symbols", "row", "doc_id", "held_out", F.size("symbols").cast("long").alias("n_tokens"), "n_known", "base").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    zero = F.lit(0.0)
    return scored.join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("rare_share", zero)).alias("score"),
    )
