"""Aspect instances: one row per (review, sentence, aspect) with its weight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guestsignal.config import DEFAULTS, Settings
from guestsignal.functions.taxonomy import ASPECT_KEYS, GENERAL
from guestsignal.operators.labels import Scorer, apply_overrides, label_sentences
from guestsignal.operators.scale import skew_safe_left_join


def join_labels(instances: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels back onto all instances; a sentence without one is neutral filler."""
    slim = labels.select("sentence_text", "aspects", "polarity")
    joined = skew_safe_left_join(instances, slim, "sentence_text", "review_id")
    return joined.withColumns(
        {
            "aspects": F.coalesce("aspects", F.array(F.lit(GENERAL))),
            "polarity": F.coalesce("polarity", F.lit(0.0)),
        }
    )


def label_in_place(
    instances: DataFrame,
    scorer: Scorer,
    overrides: DataFrame | None = None,
    keys: tuple[str, ...] = ASPECT_KEYS,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """For scorers made of built-in expressions: same labels, no distinct and no join.

    A narrow projection over the instances costs less than moving them through a shuffle
    to meet their label; a model should go through distinct sentences and join_labels.
    """
    labelled = label_sentences(instances, scorer, keys, settings)
    corrected = apply_overrides(labelled, overrides, ["review_id", "sentence_pos"])
    return corrected.drop("aspect_scores", "top_aspect_score")


def explode_aspects(labelled: DataFrame) -> DataFrame:
    """One row per aspect; every sentence has at least the filler label.

    The outer form changes nothing about the rows. The plain one makes Spark infer a
    filter on the array's size, and with that compute all labels twice.
    """
    kept = [c for c in labelled.columns if c != "aspects"]
    return labelled.select(*kept, F.explode_outer("aspects").alias("aspect"))


def add_weight(exploded: DataFrame) -> DataFrame:
    return exploded.withColumns(
        {
            "weight": F.col("recency_weight") * F.col("trust_weight"),
            "is_general": F.col("aspect") == GENERAL,
        }
    )


def aspect_instances(labelled: DataFrame) -> DataFrame:
    return add_weight(explode_aspects(labelled))


def scored_rows(instances: DataFrame) -> DataFrame:
    return instances.filter(~F.col("is_general"))
