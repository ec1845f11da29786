"""A training corpus from raw documents: quality, boilerplate lines, near-duplicates, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and gives the next one's documents; run() writes each stage's result to the
shared folder and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracol.llm import line_dedup, mixing, piece_codec, quality, simhash
from terracol.llm.common import read_table, written
from terracol.llm.queries import piece_model


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws, as many as labels say have quality 1; junk goes.

    Null and blank texts have weight 0 and are drawn like others; long texts count whole; ties at the last place and
    repeated rows stay or go together. An empty table stays empty, without good labels all documents stay, and other
    columns pass through whatever their names.
    """
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that over 5 % of their source's differing texts have, and 5 at least; no document goes.

    Copies count once: they are left to the next stage, and so are lines of fewer than 5 texts, which a pair of near
    copies has in any small source. n_chars is that of the new text. Null texts stay null (n_chars too), documents
    without a source stay as they are, a line at exactly 5 % stays, an empty table stays empty, and other columns
    pass through.
    """
    kept = line_dedup.drop_boilerplate(docs, host="source", ratio=0.05, min_line_pages=5, copies_once=True)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingle sets of Jaccard similarity 0.8 or more: SimHashes are linked
    through op5's grid, what 4 bits cannot tell is brought together by MinHash cells (the README has figures), and
    every link is checked exactly.

    It is the one of smallest doc_id (null last), of rows that share this id the one of smallest text hash, of
    repeated rows any. Null and blank texts are one group. Links are made of whole texts; chains of links are one
    group. An empty table stays empty; other columns pass through.
    """
    return simhash.keep_one(docs, simhash.near_duplicates, words=5, jaccard=0.8)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks: floor(rate) times and one drawn copy more or none.

    Sources weigh 5, 2, 1 in turn, none over 3 times its words; a null source is one of its own. Null and blank texts
    have no words and are taken as often as others of their source; rows that repeat an id are drawn together. An
    empty table stays empty; other columns pass through whatever their names.
    """
    return mixing.mix(docs).select(*docs.columns)


def sentencepiece_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents' token ids, and the text that they decode to: doc_id, lang, source, n_tokens, ids, decoded.

    A row for each row given, repeated ones too. Null texts count as empty, which has no ids; long texts are encoded
    whole. An empty table stays empty; other columns are left out.
    """
    coded = piece_codec.round_trip(docs, piece_model())
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_deduplication),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("sentencepiece_codec", sentencepiece_tokens),
]

#: SQL can express neither the classifier nor the fingerprints' components; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
