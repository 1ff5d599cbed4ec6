"""Sentence instances and the distinct sentences an expensive labeller has to see."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guestsignal.functions.text import split_sentences

# Registers of the distinct sketches: 2 ** 12.
SKETCH_LG_K = 12

# Everything later steps need from a review, carried along instead of joined back.
REVIEW_COLUMNS = (
    "review_id",
    "hotel_id",
    "hotel_name",
    "hotel_category",
    "rating",
    "review_date",
    "year_month",
    "season",
    "verified",
    "traveler_type",
    "recency_weight",
    "trust_weight",
)


def sentence_instances(
    reviews: DataFrame, carry: tuple[str, ...] = REVIEW_COLUMNS
) -> DataFrame:
    """One row per sentence. A text always has one, so the outer form only keeps Spark from
    splitting every text a second time for an inferred size filter."""
    return reviews.select(
        *carry,
        F.posexplode_outer(split_sentences(F.col("review_text"))).alias(
            "sentence_pos", "sentence_text"
        ),
    )


def distinct_sentences(instances: DataFrame) -> DataFrame:
    return instances.select("sentence_text").distinct()


def corpus_stats(reviews: DataFrame, instances: DataFrame) -> DataFrame:
    """Exact counts; one pass over the instances gives the sentences and the distinct ones."""
    n_reviews = reviews.agg(F.count(F.lit(1)).alias("n")).scalar()
    each = instances.groupBy("sentence_text").agg(F.count(F.lit(1)).alias("n"))
    return each.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_instances"), F.count(F.lit(1)).alias("n_unique")
    ).select(n_reviews.alias("n_reviews"), "n_instances", "n_unique")


def sentence_sketches(instances: DataFrame, *by: str, lg_k: int = SKETCH_LG_K) -> DataFrame:
    """Number of sentences and a HyperLogLog sketch of the distinct ones per group: a few kB each, to
    be stored with the group's files and merged with those of other groups or later days."""
    return instances.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_instances"),
        F.hll_sketch_agg("sentence_text", F.lit(lg_k)).alias("sketch"),
    )


def merged_stats(sketches: DataFrame, *by: str) -> DataFrame:
    """n_instances and about n_unique over any union of sketched groups; the standard error is about
    1.04 / sqrt(2 ** lg_k), 1.6 % for the default."""
    merged = sketches.groupBy(*by).agg(
        F.sum("n_instances").alias("n_instances"), F.hll_union_agg("sketch").alias("_all")
    )
    return merged.withColumn("n_unique", F.hll_sketch_estimate("_all")).drop("_all")
