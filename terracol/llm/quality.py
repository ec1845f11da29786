"""Quality classifier by importance resampling: the ratio of two hashed n-gram models, sampled by Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, discard, slices, unused, utf8, word_hashes, written

#: Hash buckets of unigrams and bigrams together; also the number of rows that reach the driver.
BUCKETS = 1 << 18
#: Labelled rows that the target model and the share are taken from, at most, picked by a hash of their doc_id.
LABELLED = 16_384
SEED = 23
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def features(text: bytes) -> np.ndarray:
    """Buckets of all words and neighbouring pairs of words of a text."""
    h = word_hashes(text.split())
    pairs = (h[:-1] * _A ^ (h[1:] + _B)) * _B if len(h) > 1 else np.zeros(0, np.uint64)
    return (np.concatenate([h, pairs]) % np.uint64(BUCKETS)).astype(np.int64)


def labelled_sample(labels: DataFrame) -> dict[int, int]:
    """doc_id -> 1 (good: quality 1, not toxic), 0 (quality 0) or -1 (toxic only: neither), of LABELLED rows at most;
    rows with a null doc_id or quality are left out."""
    rows = labels.where("doc_id is not null and quality is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(LABELLED)
    kind = F.when(F.col("quality") != 1, 0).when(F.coalesce("toxic", F.lit(0)) == 1, -1).otherwise(1)
    return {r["doc_id"]: r["kind"] for r in rows.select("doc_id", kind.alias("kind")).collect()}


def ngram_counts(docs: DataFrame, target_ids: frozenset) -> np.ndarray:
    """Counts by bucket over all documents, and over the target documents: a (2, BUCKETS) array."""
    target = docs.sparkSession.sparkContext.broadcast(target_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for part in slices(batches, 256):
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                f = features(text)
                np.add.at(counts[0], f, 1)
                if doc_id in target.value:
                    np.add.at(counts[1], f, 1)
        at = np.nonzero(counts[0])[0]
        yield batch(bucket=pa.array(at.astype(np.int32)), raw=pa.array(counts[0][at]), target=pa.array(counts[1][at]))

    rows = docs.select("doc_id", utf8().alias("b")).mapInArrow(run, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow().to_pandas()
    out = np.zeros((2, BUCKETS), np.int64)
    out[0, rows["bucket"]], out[1, rows["bucket"]] = rows["raw"], rows["target"]
    return out


class Ratio:
    """log p_target - log p_raw of each bucket. The target's count is held against the count expected under the raw
    model, both with ``steady`` more, so a bucket that the target sample is too small to judge has a ratio near one."""

    def __init__(self, counts: np.ndarray, steady: float = 8.0):
        self.steady, self.target = steady, counts[1]
        self.share = counts[1].sum() / max(1, counts[0].sum())
        self.expected = counts[0] * self.share
        self.table = np.log(counts[1] + steady) - np.log(self.expected + steady)

    def log_weight(self, f: np.ndarray, own: bool) -> float:
        """Sum over a document's n-grams; with ``own``, of a target document, after its own counts are taken out."""
        if not len(f):
            return 0.0
        if not own:
            return float(self.table[f].sum())
        at, n = np.unique(f, return_counts=True)
        return float((n * (np.log(self.target[at] - n + self.steady) - np.log(np.maximum(self.expected[at] - n * self.share, 0) + self.steady))).sum())


def weigh(docs: DataFrame, ratio: Ratio, target: frozenset, *, seed: int = SEED, text: str = "text", names: tuple[str, str] = ("log_weight", "key")) -> DataFrame:
    """Append, under ``names``, the log weight (sum of the log ratios of all n-grams of the whole text) and the key
    that the draw goes by (log weight plus Gumbel noise from a hash of doc_id and seed). No column may have these names."""
    model = docs.sparkSession.sparkContext.broadcast((ratio, target))
    keep = docs.columns
    weight, key = names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, target = model.value
        for part in slices(batches):
            texts = part.column(keep.index(text)).cast(pa.binary()).to_pylist()
            ids = part.column(keep.index("doc_id")).to_pylist()
            weights = [ratio.log_weight(features(t or b""), i in target) for i, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(weights, pa.float64())], names=[*keep, weight])

    scored = docs.mapInArrow(run, docs.select("*").schema.add(weight, "double"))
    unit = (F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return scored.withColumn(key, F.col(weight) - F.log(-F.log(unit)))


def kth_key(scores: DataFrame, k: int, column: str = "key", fan: int = 1024) -> float:
    """The k-th largest value of a column, by narrowing a range with counts of ``fan`` bins; a few rows reach the driver."""
    low, high, total = scores.agg(F.min(column), F.max(column), F.count(column)).first()
    if k <= 0 or not total:
        return float("inf")
    if k >= total:
        return low
    while True:
        width = (high - low) / fan
        inside = scores.where(F.col(column).between(low, high))
        if width <= 0 or low + width == low:
            return low
        at = F.least(F.floor((F.col(column) - low) / width), F.lit(fan - 1))
        bins = {r["at"]: r for r in inside.groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()}
        above = scores.where(F.col(column) > high).count()
        for b in sorted(bins, reverse=True):
            if above + bins[b]["n"] >= k:
                low, high = bins[b]["low"], bins[b]["high"]
                if low == high or above + bins[b]["n"] == k:
                    return low
                break
            above += bins[b]["n"]


def good_share(good: int, n: int) -> float:
    """Upper 95 % bound (one-sided, normal) of the share of which ``good`` of n rows were seen; 1 for no rows."""
    s = good / n if n else 1.0
    return min(1.0, s + 1.645 * (s * (1 - s) / max(n, 1)) ** 0.5)


def fit(docs: DataFrame, labels: DataFrame, *, share: float | None = None, seed: int = SEED) -> tuple[Ratio, frozenset, float]:
    """The ratio of the two models, the ids of the target documents, and the key of the last document drawn."""
    kinds = labelled_sample(labels)
    target = frozenset(k for k, v in kinds.items() if v == 1)
    if share is None:
        share = good_share(sum(v != 0 for v in kinds.values()), len(kinds)) if target else 1.0
    ratio = Ratio(ngram_counts(docs, target))
    if share >= 1:
        return ratio, target, -np.inf
    scores = written(weigh(docs.select("doc_id", "text"), ratio, target, seed=seed).select("key"))
    least = kth_key(scores, round(share * scores.count()))
    discard(scores)
    return ratio, target, least


def resample(docs: DataFrame, labels: DataFrame, *, share: float | None = None, seed: int = SEED) -> DataFrame:
    """The documents that importance resampling draws: docs' own columns, log_weight and key (docs' columns of these
    names are left out).

    The target model counts the hashed unigrams and bigrams of good labelled documents (LABELLED rows at most), the
    raw model those of all documents; a document's log weight is the log ratio of its probabilities under the two. Of
    N documents round(share x N) are drawn without replacement: those with the largest log weights plus Gumbel noise.
    ``share`` is by default the upper 95 % bound of the share of quality 1 that the labelled documents show, as a clean
    document lost costs more than a bad one kept; bad labels are used for nothing else.

    Null and blank texts have log weight 0. A null doc_id draws as 0 does; repeated rows draw alike and are kept or
    rejected together, as are ties at the last place. Without good labels, or at a share of 1, all documents are
    kept; an empty table gives an empty result; other columns pass through. Texts never move: counts of BUCKETS rows
    a task and the scores' counts are all that is shuffled.
    """
    return _drawn(docs.drop("log_weight", "key"), labels, ("log_weight", "key"), share, seed)


def _drawn(docs: DataFrame, labels: DataFrame, names: tuple[str, str], share: float | None, seed: int) -> DataFrame:
    ratio, target, least = fit(docs, labels, share=share, seed=seed)
    return weigh(docs, ratio, target, seed=seed, names=names).where(F.col(names[1]) >= F.lit(float(least)))


def keep_good(docs: DataFrame, labels: DataFrame, *, share: float | None = None, seed: int = SEED) -> DataFrame:
    """The rows of docs that :func:`resample` draws, with docs' own columns, whatever their names."""
    return _drawn(docs, labels, tuple(unused(docs.columns, "_log_weight", "_key")), share, seed).select(*docs.columns)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, log_weight and key of every document kept."""
    return resample(docs.select("doc_id", "text"), labels).select("doc_id", "log_weight", "key")
