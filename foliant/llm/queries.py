"""The registered queries of the numbered operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from foliant.llm import chunks, decontam, html_text, languages, licenses, mixing, negatives, ngram_join, quality, spelling, tokens, toxicity, warc

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents")).drop("tkey")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source", "tkey")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontam.decontaminate(docs, benchmark).drop("key")


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_output(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.shared_passages(table(spark, sf_dir, "documents")).drop("key")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th vector among all of them."""
    return negatives.mined(table(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, forms and roots of all words of all documents."""
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, its share, and the set of languages found."""
    return languages.languages(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc,
        op2_ngram_join,
        op3_toxicity,
        op4_html_text,
        op5_license_scan,
        op6_quality_rules,
        op7_mixing,
        op8_decontamination,
        op9_token_output,
        op10_substring_dedup,
        op11_hard_negatives,
        op12_spelling_variants,
        op13_language_id,
    )
}
ORACLES = {
    "op1_warc": warc.ORACLE,
    "op6_quality_rules": quality.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op8_decontamination": decontam.ORACLE,
    "op11_hard_negatives": negatives.ORACLE,
    "op12_spelling_variants": spelling.ORACLE,
}
