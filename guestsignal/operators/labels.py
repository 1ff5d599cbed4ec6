"""Aspect and polarity labels of distinct sentences, with audited corrections."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guestsignal.config import DEFAULTS, Settings
from guestsignal.functions.numbers import rounded
from guestsignal.functions.taxonomy import ASPECT_KEYS, GENERAL, Lexicon
from guestsignal.functions.text import words
from guestsignal.operators.scale import materialise, skew_safe_left_join

# A scorer adds aspect_scores (map aspect -> [0, 1]) and sentiment (map name -> [0, 1]).
Scorer = Callable[[DataFrame], DataFrame]
# Overrides of more bytes are not sent to every task; what a row costs besides its texts.
OVERRIDE_BYTES, ROW_BYTES = 32 << 20, 64
SCORED_FIELDS = "aspect_scores map<string,double>, sentiment map<string,double>"


def lexicon_scorer(lexicon: Lexicon) -> Scorer:
    """Word-list scorer made of built-in expressions: h hits score h / (h + 1).

    One pass cuts the sentence into words and keeps those any list knows; the lists are
    counted on the few words that are left.
    """
    lists = {**lexicon.aspects, "+": lexicon.positive, "-": lexicon.negative}
    known = sorted({word for one in lists.values() for word in one})

    def score(sentences: DataFrame) -> DataFrame:
        kept = sentences.withColumn(
            "_words", F.filter(words(F.col("sentence_text")), lambda w: w.isin(*known))
        )
        found = lambda one: F.size(F.filter("_words", lambda w: w.isin(*one)))
        counts = {f"_n{i}": found(one) for i, one in enumerate(lists.values())}
        hits = dict(zip(lists, (F.col(c) for c in counts)))
        good, bad = hits.pop("+"), hits.pop("-")
        scores = [part for a, n in hits.items() for part in (F.lit(a), n / (n + 1.0))]
        return (
            kept.withColumns(counts)
            .withColumns(
                {
                    "aspect_scores": F.create_map(*scores),
                    "sentiment": F.create_map(
                        F.lit("positive"), good / (good + bad + 1.0),
                        F.lit("negative"), bad / (good + bad + 1.0),
                    ),
                }
            )
            .drop("_words", *counts)
        )

    return score


def pandas_scorer(load: Callable[[], Callable[[pd.Series], pd.DataFrame]]) -> Scorer:
    """Hook for a model of the caller's: `load` runs once per task and returns a function
    from a series of sentences to the columns aspect_scores and sentiment (dicts)."""

    def score(sentences: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            predict = load()
            for batch in batches:
                yield pd.concat([batch, predict(batch["sentence_text"])], axis=1)

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sentences.schema)
        return sentences.mapInPandas(run, f"{fields}, {SCORED_FIELDS}")

    return score


def threshold_aspects(
    scores: Column, keys: tuple[str, ...] = ASPECT_KEYS, threshold: float = 0.50
) -> Column:
    """Aspects at or above the threshold in taxonomy order, else the filler label."""
    reached = {k: F.try_element_at(scores, F.lit(k)) >= threshold for k in keys}
    nothing = ~reduce(or_, [F.coalesce(hit, F.lit(False)) for hit in reached.values()])
    return F.array_compact(
        F.array(*[F.when(hit, k) for k, hit in reached.items()], F.when(nothing, GENERAL))
    )


def polarity_of(sentiment: Column) -> Column:
    """P(positive) - P(negative), a missing one counting as zero."""
    positive, negative = (
        F.coalesce(F.try_element_at(sentiment, F.lit(name)), F.lit(0.0))
        for name in ("positive", "negative")
    )
    return rounded(positive - negative, 4)


def top_score(scores: Column) -> Column:
    return rounded(F.array_max(F.map_values(scores)), 4)


def label_sentences(
    sentences: DataFrame,
    scorer: Scorer,
    keys: tuple[str, ...] = ASPECT_KEYS,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Score rows that have a sentence_text. Give distinct sentences to a costly scorer."""
    scored = scorer(sentences)
    return scored.withColumns(
        {
            "aspects": threshold_aspects(
                F.col("aspect_scores"), keys, settings.aspect_threshold
            ),
            "polarity": polarity_of(F.col("sentiment")),
            "top_aspect_score": top_score(F.col("aspect_scores")),
        }
    ).drop("sentiment")


def unlabelled_sentences(instances: DataFrame, labels: DataFrame) -> DataFrame:
    return instances.select("sentence_text").distinct().join(
        labels.select("sentence_text"), "sentence_text", "left_anti"
    )


def extend_labels(
    instances: DataFrame,
    labels: DataFrame,
    scorer: Scorer,
    keys: tuple[str, ...] = ASPECT_KEYS,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Keep the labels there are and score only the sentences that lack one."""
    new = label_sentences(unlabelled_sentences(instances, labels), scorer, keys, settings)
    return labels.unionByName(new.select(*labels.columns))


def stored_corrections(overrides: DataFrame) -> tuple[DataFrame, int]:
    """Corrections by sentence, stored once, and their size in bytes; a repeated sentence raises."""
    packed = F.trim("aspects")
    corrections = materialise(
        overrides.filter(F.col("sentence_text").isNotNull()).select(
            "sentence_text",
            F.when(packed != "", F.split(packed, r"\|")).alias("_aspects"),
            F.col("polarity").cast("double").alias("_polarity"),
            F.lit(True).alias("_hit"),
        ),
        "overrides",
    )
    size = F.octet_length("sentence_text") + F.coalesce(
        F.octet_length(F.array_join("_aspects", "|")), F.lit(0)
    )
    found = (
        corrections.groupBy("sentence_text")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(size + F.lit(ROW_BYTES)).alias("bytes"))
        .agg(F.min(F.when(F.col("n") > 1, F.col("sentence_text"))).alias("twice"), F.sum("bytes").alias("bytes"))
        .first()
    )
    if found.twice is not None:
        raise ValueError(f"overrides repeat sentences, such as {found.twice!r}")
    return corrections, found.bytes or 0


def apply_overrides(
    labels: DataFrame,
    overrides: DataFrame | None,
    row_id: str | list[str] = "sentence_text",
    broadcast_bytes: int = OVERRIDE_BYTES,
) -> DataFrame:
    """Exact-sentence corrections: non-blank aspects (packed `a|b`) and non-null polarity win.

    `labels` may be labels of distinct sentences or of all instances (`row_id` tells their rows
    apart). Overrides are written by people, so they are few: up to `broadcast_bytes`, measured here,
    they go to every task and the labels stay where they are. More of them are met in a
    skew-safe join.
    """
    if overrides is None:
        return labels.withColumn("overridden", F.lit(False))
    corrections, size = stored_corrections(overrides)
    if size <= broadcast_bytes:
        met = labels.join(F.broadcast(corrections), "sentence_text", "left")
    else:
        met = skew_safe_left_join(labels, corrections, "sentence_text", row_id)
    return (
        met.withColumn("aspects", F.coalesce("_aspects", "aspects"))
        .withColumn("polarity", F.coalesce("_polarity", "polarity"))
        .withColumn("overridden", F.coalesce("_hit", F.lit(False)))
        .drop("_aspects", "_polarity", "_hit")
    )


def override_audit(labels: DataFrame, overrides: DataFrame) -> DataFrame:
    """How many labels each stated reason changed."""
    return (
        overrides.join(labels.filter("overridden").select("sentence_text"), "sentence_text")
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("n_overridden"))
    )


def pack_scores(scores: Column, keys: tuple[str, ...] = ASPECT_KEYS) -> Column:
    """`a:0.98;b:0.01` for the CSV edge."""
    return F.concat_ws(
        ";",
        *[
            F.format_string(f"{k}:%.2f", F.coalesce(F.try_element_at(scores, F.lit(k)), F.lit(0.0)))
            for k in keys
        ],
    )


def unpack_scores(packed: Column) -> Column:
    return F.transform_values(
        F.str_to_map(packed, F.lit(";"), F.lit(":")), lambda _, v: v.try_cast("double")
    )
