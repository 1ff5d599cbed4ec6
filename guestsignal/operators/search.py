"""Similarity search over distinct sentences, mapped back to review instances."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from guestsignal.config import DEFAULTS
from guestsignal.functions.numbers import rounded
from guestsignal.functions.vectors import dot
from guestsignal.operators.scale import materialise

# Sentences that are looked up for a first answer.
CANDIDATES = 1_024

RESULT_COLUMNS = (
    "review_id",
    "hotel_id",
    "hotel_name",
    "sentence_text",
    "aspect",
    "polarity",
    "review_date",
    "verified",
    "similarity",
)


def embed_sentences(
    sentences: DataFrame, load: Callable[[], Callable[[pd.Series], list]]
) -> DataFrame:
    """Hook for an encoder of the caller's over distinct sentences: `load` runs once per
    task and returns a function from a series of sentences to their vectors, which are
    stored with unit length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()
        for batch in batches:
            vectors = np.asarray(list(encode(batch["sentence_text"])), dtype=np.float32)
            lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
            unit = vectors / np.where(lengths > 0, lengths, 1.0)
            yield pd.DataFrame(
                {"sentence_text": batch["sentence_text"].to_numpy(), "embedding": list(unit)}
            )

    return sentences.select("sentence_text").mapInPandas(
        run, "sentence_text string, embedding array<float>"
    )


def sentence_similarity(embeddings: DataFrame, query: Column, name: str = "sentence_text") -> DataFrame:
    """Dot product of every (unit) sentence vector with the query, a literal array or a
    scalar subquery; a narrow projection either way."""
    asked = embeddings.select(name, "embedding", query.alias("_query"))
    return asked.select(name, dot(F.col("embedding"), F.col("_query")).alias("similarity"))


def filtered_pool(
    instances: DataFrame, hotel_id: str | None = None, aspect: str | None = None
) -> DataFrame:
    """Filler rows stay in: search may quote them."""
    pool = instances
    if hotel_id:
        pool = pool.filter(F.col("hotel_id") == hotel_id)
    if aspect:
        pool = pool.filter(F.col("aspect") == aspect)
    return pool


def search_index(instances: DataFrame) -> DataFrame:
    """The newest instance of every sentence per hotel and aspect, to search again and again.

    Whatever the filters, the instance a search would show is among these.
    """
    return _newest(instances, ["sentence_text", "hotel_id", "aspect"])


def _newest(instances: DataFrame, keys: list[str]) -> DataFrame:
    order = W.partitionBy(*keys).orderBy(
        F.col("recency_weight").desc(), F.col("review_id"), F.col("aspect")
    )
    return (
        instances.withColumn("_copy", F.row_number().over(order))
        .filter("_copy = 1")
        .drop("_copy")
    )


def search(
    instances: DataFrame,
    embeddings: DataFrame,
    query: Column,
    k: int = DEFAULTS.search_k,
    hotel_id: str | None = None,
    aspect: str | None = None,
    candidates: int = CANDIDATES,
) -> DataFrame:
    """The k most similar distinct sentences, each with its most recent instance.

    `instances` may be the aspect instances or, cheaper, their search_index. The vectors are scanned
    once for more candidates than asked for (each task keeps its best), and only instances
    of those are looked at. That is proven complete when k sentences are found and the last of them is
    more similar than the last candidate, so that no tie can be outside; otherwise, as
    with a rare filter, it is repeated with sixteen times as many candidates.
    """
    scores = sentence_similarity(embeddings, query).filter(F.col("similarity") > 0)
    pool = filtered_pool(instances, hotel_id, aspect)
    order = [
        F.col("similarity").desc(),
        F.col("recency_weight").desc(),
        F.col("review_id"),
        F.col("sentence_text"),
    ]
    asked = max(candidates, k)
    while True:
        best = scores.orderBy(F.col("similarity").desc(), "sentence_text").limit(asked)
        near = materialise(best, "candidates")
        one_each = _newest(pool.join(near, "sentence_text"), ["sentence_text"])
        found = materialise(one_each.orderBy(*order).limit(k), "found")
        worst = F.min("similarity").alias("least")
        seen, got = (t.agg(F.count(F.lit(1)).alias("n"), worst).first() for t in (near, found))
        if seen.n < asked or (got.n == k and got.least > seen.least):
            shown = [c for c in RESULT_COLUMNS if c != "similarity"]
            return found.orderBy(*order).select(
                *shown, rounded(F.col("similarity"), 6).alias("similarity")
            )
        asked *= 16


def search_text(
    instances: DataFrame,
    embeddings: DataFrame,
    text: str,
    load: Callable[[], Callable[[pd.Series], list]],
    **options,
) -> DataFrame:
    """The same for a text, through the encoder hook that made the embeddings."""
    asked = instances.sparkSession.createDataFrame([(text,)], "sentence_text string")
    vector = materialise(embed_sentences(asked, load), "asked")
    return search(instances, embeddings, vector.agg(F.first("embedding")).scalar(), **options)
