"""The training-data pipeline: toxicity, near duplicates, decontamination, mixing, token files.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and reread as the next stage's documents.

Defined cases, of every stage: an empty table gives an empty table; a null id, text, language, source or length, repeated
rows and ties fail nothing; further columns, whatever their names, are carried to the end of mixing; texts of any length
are read whole. What each stage does with nulls is said at the stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.shared import stored
from foliant.llm import decontam, mixing, ngram_join, tokens, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine predicts to be toxic go.

    A null or empty text scores the model's bias, as a text of unknown words does, and stays; so does everything if there
    are no labels. Repeated rows go or stay together.
    """
    return toxicity.clean_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays.

    Texts of no words are copies of nothing and all stay; of equal texts the smallest id stays, a null id last.
    """
    return ngram_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with too many words of benchmark phrases go; a text without words has none and stays."""
    return decontam.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; a text without words is never taken, a null source is one of its own."""
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back: a row per document in ascending order of ids, null ids first; a null text is the end id alone."""
    return tokens.token_output(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: MinHash, a trained model and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
