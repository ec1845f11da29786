"""Mixing sources to target weights by repeating documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import unused, written

#: ASCII white space, as a character class of both regular expressions and btrim.
_SPACE = " \t\n\x0b\x0c\r"
#: Bins of a hash that a source's documents stand in.
BINS = 1 << 16
FEW = 1 << 8
#: Sources up to this number are sent to every executor; more are joined by a shuffle.
BROADCAST_SOURCES = 20_000


def word_count(text: str = "text") -> Column:
    """Number of runs of anything but ASCII white space; null: 0."""
    bare = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(_SPACE))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """(source, source_size, target, rate) from (source, size) rows.

    Sources in code point order, null last, take the weights in turn and share the sum of all sizes; no target goes
    over ``cap`` times its source's size, and what is cut there is shared out again by weight. That share-out has a
    closed form: in order of cap / weight, the first sources are at their cap and the rest get one multiple of
    their weight. Only one row a source meets in a task.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("most", F.lit(float(cap)) * F.col("source_size")).withColumn("bound", F.col("most") / F.col("weight"))
    order = Window.orderBy("bound", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    ).withColumn("at", F.row_number().over(order))
    per = per.withColumn("level", F.min_by(F.when(F.col("level") <= F.col("bound"), F.col("level")), F.when(F.col("level") <= F.col("bound"), F.col("at"))).over(everything))
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("level") * F.col("weight")))
    return per.select("source", "source_size", target.alias("target")).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))


def hash_unit(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on key and seed alone."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{seed}")).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def hash_bin(key: Column, seed: int) -> Column:
    """One of BINS bins that depends on key and seed alone."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{seed}")).cast("binary")), 1, 4), 16, 10).cast("int")


def _drawn_bins(bins: DataFrame, rates: DataFrame, small: bool, seed: int) -> DataFrame:
    """rates with ``cut``: a source's bins below it are drawn once more. Those are the bins, in order, that together
    hold the words that whole copies leave open; the bin in which that number falls is drawn with the probability of
    the share of it that is missing. Bins are added up in groups of FEW first, then inside the group that holds the
    cut, so a window has FEW or BINS / FEW rows a source."""
    need = (F.col("rate") - F.floor("rate")) * F.col("source_size")
    b = bins.join(F.broadcast(rates) if small else rates, bins["source"].eqNullSafe(rates["source"])).select(bins["source"], "bin", "size", need.alias("need")).where("need > 0")
    groups = b.groupBy("source", F.floor(F.col("bin") / FEW).alias("group")).agg(F.sum("size").alias("size"), F.first("need").alias("need"))
    groups = groups.withColumn("after", F.sum("size").over(Window.partitionBy("source").orderBy("group"))).withColumn("before", F.col("after") - F.col("size"))
    whole = groups.where("after <= need").select("source", ((F.col("group") + 1) * FEW).alias("cut"))
    split = groups.where("before < need AND after > need").select(F.col("source").alias("_source"), "group", "before")
    inside = b.join(split, b["source"].eqNullSafe(split["_source"]) & (F.floor(F.col("bin") / FEW) == F.col("group"))).select("source", "bin", "size", "need", "before")
    inside = inside.withColumn("after", F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("bin"))).withColumn("before", F.col("after") - F.col("size"))
    crossing = hash_unit(F.concat(F.coalesce("source", F.lit("")), F.lit(":cut")), seed) * F.col("size") < F.col("need") - F.col("before")
    part = inside.where((F.col("after") <= F.col("need")) | ((F.col("before") < F.col("need")) & crossing)).select("source", (F.col("bin") + 1).cast("long").alias("cut"))
    cuts = whole.unionByName(part).groupBy("source").agg(F.max("cut").alias("cut"))
    return rates.join(cuts, rates["source"].eqNullSafe(cuts["source"]), "left").select(rates["source"], "source_size", "target", "rate", F.coalesce("cut", F.lit(0)).alias("cut"))


MADE = ("size", "source_size", "target", "rate", "copies")


def _planned(docs: DataFrame, names: tuple[str, ...], weights: tuple[float, ...], cap: float, seed: int) -> DataFrame:
    """docs with MADE under the given names, none of which docs has."""
    size, source_size, target, rate, copies = names
    source, cut, at = unused([*docs.columns, *names], "_source", "_cut", "_bin")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    bins = written(docs.select("source", hash_bin(key, seed).alias("bin"), word_count().alias("size")).groupBy("source", "bin").agg(F.sum("size").alias("size")))
    rates = written(source_targets(bins.select("source", "size"), weights, cap))
    small = rates.count() <= BROADCAST_SOURCES
    rates = written(_drawn_bins(bins, rates, small, seed)).toDF(source, source_size, target, rate, cut)
    joined = docs.join(F.broadcast(rates) if small else rates, F.col("source").eqNullSafe(F.col(source)), "left")
    joined = joined.withColumn(size, word_count()).withColumn(at, hash_bin(key, seed))
    taken = (F.floor(rate) + (F.col(at) < F.col(cut)).cast("long")).cast("long")
    return joined.withColumn(copies, taken).select(*docs.columns, *names)


def mix_plan(docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, seed: int = 17) -> DataFrame:
    """Append ``size``, ``source_size``, ``target``, ``rate`` and ``copies`` to the columns of docs.

    A document is taken floor(rate) times, and once more with the probability of the rate's fraction, by a hash of its
    doc_id and ``seed``. The draws of a source depend on each other: documents stand in BINS bins by their hash, and
    bins are drawn in order until the words that whole copies leave open are there, so a source's taken words miss
    their target by the words of one bin at most (one document, where a source has far fewer documents than BINS).
    Reruns and other partitionings give the same copies. Sizes are word counts of whole texts (null: 0).

    A null source is a source of its own; a null doc_id hashes as an empty string, so such rows are drawn together,
    as are repeated ids and rows. Sources without words have target and copies 0; an empty table gives an empty
    result. Columns of docs with the names of the outputs are replaced, others pass through whatever their names.

    Only word sums per source and bin are shuffled (added up before the shuffle, so a hot source costs BINS rows a
    task at most); the per-source rates, one row a source, are broadcast up to BROADCAST_SOURCES and joined by a
    shuffle beyond. Texts don't move.
    """
    return _planned(docs.drop(*MADE), MADE, weights, cap, seed)


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, seed: int = 17) -> DataFrame:
    """The mixed table: every document's row ``copies`` times (see :func:`mix_plan`), with docs' own columns whatever
    their names and ``copy`` (from 0; a column of docs with this name is left out)."""
    docs = docs.drop("copy")
    names = tuple(unused(docs.columns, *("_" + m for m in MADE)))
    plan = _planned(docs, names, weights, cap, seed).where(F.col(names[-1]) > 0)
    return plan.select(*docs.columns, F.explode(F.sequence(F.lit(0), F.col(names[-1]).cast("int") - 1)).alias("copy"))


def mix_report(docs: DataFrame) -> DataFrame:
    plan = mix_plan(docs.select("doc_id", "source", "text"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM per
), capped AS (
  SELECT *, 3.0::DOUBLE * source_size AS most, 3.0::DOUBLE * source_size / weight AS bound FROM weighed
), levels AS (
  SELECT *, row_number() OVER (ORDER BY bound, source NULLS LAST) AS place,
    ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER (ORDER BY bound, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER (ORDER BY bound, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) AS level
  FROM capped
), chosen AS (SELECT (SELECT level FROM levels WHERE level <= bound ORDER BY place LIMIT 1) AS level),
targets AS (
  SELECT source, source_size, CASE WHEN chosen.level IS NULL THEN most ELSE least(most, chosen.level * weight) END AS target FROM levels, chosen
), rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM targets),
placed AS (SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':17'), 1, 4))::BIGINT AS bin FROM sized),
bins AS (SELECT source, bin, sum(size)::BIGINT AS size FROM placed GROUP BY source, bin),
open AS (
  SELECT b.source, bin, b.size, (rate - floor(rate)) * source_size AS need, (sum(b.size) OVER (PARTITION BY b.source ORDER BY bin))::BIGINT AS upto
  FROM bins b JOIN rates ON b.source IS NOT DISTINCT FROM rates.source
), cuts AS (
  SELECT source, max(bin) + 1 AS cut FROM open
  WHERE need > 0 AND (upto <= need OR (upto - size < need AND ('0x' || substr(md5(coalesce(source, '') || ':cut:17'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE * size < need - (upto - size)))
  GROUP BY source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + (bin < coalesce(cut, 0))::INT))::BIGINT AS taken
FROM placed JOIN rates ON placed.source IS NOT DISTINCT FROM rates.source LEFT JOIN cuts ON placed.source IS NOT DISTINCT FROM cuts.source
"""
