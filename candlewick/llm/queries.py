"""The registered queries of the corpus operators, each over its whole table, with oracle SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from candlewick.llm import alignment, ann, clustering, langid, lattice_lm, line_dedup, minhash, mixing, quality, subword_sampling, suffix_index, token_counts, toxicity
from candlewick.llm.common import table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_equal", "n_near")


def op2_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subword_sampling.sample_encodings(table(spark, sf_dir, "documents"), PIECES, check=True)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean_lines(table(spark, sf_dir, "documents"), text=False)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85, bands=32)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_index.digest(suffix_index.without_repeats(table(spark, sf_dir, "documents")))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.scores(table(spark, sf_dir, "documents"), PIECES)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), WORD_BPE)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest(table(spark, sf_dir, "documents"), BYTE_BPE, PIECES)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clusters(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    of = (
        op1_line_dedup, op2_sentencepiece_sampling, op3_quality_rules, op4_language_id, op5_minhash, op6_suffix_dedup, op7_lm_scores, op8_mixing, op9_nearest, op10_token_counts,
        op11_alignment, op12_toxicity, op13_clusters,
    )
    return {f.__name__: f for f in of}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.oracle(), "op3_quality_rules": quality.oracle(), "op13_clusters": clustering.oracle()}
