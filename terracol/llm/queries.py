"""One registered query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import fill_in_middle, fingerprints, fragment_join, hidden_markov, line_dedup, mixing, piece_codec, quality, simhash, spelling, substring_dedup, token_counts, topk
from .common import read_table


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.piece_report(read_table(spark, sf_dir, "documents"), piece_model())


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(read_table(spark, sf_dir, "pages"))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_with_next(read_table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_report(read_table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read_table(spark, sf_dir, "documents"))


def op7_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k_report(read_table(spark, sf_dir, "embeddings"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_count_report(read_table(spark, sf_dir, "documents"), piece_model())


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_markov.score_documents(read_table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeat_report(read_table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.middle_report(read_table(spark, sf_dir, "documents"))


def op12_fragment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fragment_join.jaccard_report(read_table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_report(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_sentencepiece_codec, op3_line_dedup, op4_document_fingerprints, op5_simhash_near_dedup, op6_source_mixing, op7_exact_topk_search, op8_token_counts, op9_lm_scoring, op10_substring_dedup, op11_fill_in_middle, op12_fragment_join, op13_spelling_variants)}

#: DuckDB SQL of the queries that SQL can express.
ORACLES = {"op3_line_dedup": line_dedup.LINE_SQL, "op6_source_mixing": mixing.MIX_SQL, "op7_exact_topk_search": topk.TOP_K_SQL, "op10_substring_dedup": substring_dedup.REPEAT_SQL, "op11_fill_in_middle": fill_in_middle.MIDDLE_SQL, "op12_fragment_join": fragment_join.JACCARD_SQL, "op13_spelling_variants": spelling.VARIANT_SQL}
