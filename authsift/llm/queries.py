"""The registered queries of the operators: each over its whole table, with production parameters."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from authsift.llm import (
    conversation_repair, decontaminate, fill_in_middle, language_model, mixing, neardup, pii, quality_model, quality_rules, secrets,
    spans, sql, token_counts, toxicity)
from authsift.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.deduplicated(table(spark, sf_dir, "documents"), ending=True) \
        .select("doc_id", "text", "n_sentences", "n_removed", "words_removed")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scores(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.report(table(spark, sf_dir, "documents"), n=3, num=85)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repaired(table(spark, sf_dir, "conversations"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return token_counts.counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_pii, op2_secrets, op3_quality_classifier, op4_mixing, op5_sentence_spans, op6_decontamination,
    op7_language_model, op8_toxicity, op9_near_duplicates, op10_quality_rules, op11_conversation_repair,
    op12_token_counts, op13_fill_in_middle)}

ORACLE: dict[str, str] = {
    "op2_secrets": sql.SECRETS,
    "op4_mixing": sql.MIX,
    "op6_decontamination": sql.LEAKS,
    "op9_near_duplicates": sql.NEAR,
    "op11_conversation_repair": sql.TALKS,
    "op13_fill_in_middle": sql.FIM,
}
