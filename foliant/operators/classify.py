"""Document types, message routing and final-message selection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_chunk_inputs(chunks: DataFrame, n: int = 800) -> DataFrame:
    return chunks.where("is_first_chunk").select("source", F.substring("text", 1, n).alias("text"))


def nearest_centroid(vectors: DataFrame, labelled: DataFrame, key: str, vec: str, label: str) -> DataFrame:
    """(key, predicted): the label whose mean vector is nearest by cosine.

    Centroids are one row per label; they are grouped from element rows, so labelled rows stay distributed.
    """
    from foliant.operators.vectors import cosine_matrix

    places = labelled.select(label, F.posexplode(F.col(vec).cast("array<double>")).alias("i", "x")).groupBy(label, "i").agg(F.avg("x").alias("x"))
    centroids = places.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("centre"))
    scores = cosine_matrix(vectors, centroids, key=key, vec=vec, query_key=label, query_vec="centre")
    w = Window.partitionBy(key).orderBy(F.desc("score"), label)
    return scores.withColumn("r", F.row_number().over(w)).where("r = 1").select(key, F.col(label).alias("predicted"), "score")


def classify_with(docs: DataFrame, key: str, text: str, classifier: Callable[[], Callable[[list[str]], list[str]]]) -> DataFrame:
    """(key, predicted): labels of a caller's classifier, which is made once per Python worker; a null text has none."""

    @F.pandas_udf("string")
    def label(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = classifier()
        for p in parts:
            yield pd.Series(model(p.tolist()), dtype=object)

    known = docs.where(F.col(text).isNotNull()).select(key, clean_type_label(label(text)).alias("predicted"))
    return known.unionAll(docs.where(F.col(text).isNull()).select(key, F.lit(None).cast("string")))


def skip_classified(docs: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Documents without a stored result."""
    return docs.join(stored.select(key).distinct(), key, "left_anti")


def clean_type_label(label: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(label)), r"^the document type is ", "")


def classification_rate(docs: DataFrame, types: DataFrame, key: str, label: str) -> DataFrame:
    done = types.where(F.col(label).isNotNull() & (F.col(label) != "not classified")).select(key, F.lit(1).alias("__d")).distinct()
    joined = docs.select(key).join(done, key, "left")
    return joined.agg(F.count("*").alias("n_docs"), F.count("__d").alias("n_classified"), F.round(F.coalesce(F.try_divide(F.count("__d").cast("double"), F.count("*")), F.lit(0.0)), 6).alias("rate"))


def route_messages(messages: DataFrame) -> DataFrame:
    """The action that each conversation's last message asks for."""
    last = messages.groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    low = F.lower("text")
    action = F.when(low.contains("parse"), "parse").when(low.contains("match"), "match").when(low.contains("?"), "answer").otherwise("summarize")
    return last.select("conv_id", action.alias("action"))


def select_final_message(messages: DataFrame, least: int = 200) -> DataFrame:
    """Per conversation the latest assistant message of enough length, else the latest one."""
    rows = messages.where("role = 'assistant'")
    order = F.struct((F.length("text") >= least).alias("long"), "turn")
    return rows.groupBy("conv_id").agg(F.max_by("turn", order).alias("turn"), F.max_by("text", order).alias("text"))
