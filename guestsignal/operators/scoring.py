"""Entity x aspect sentiment: weighted sums, shrinkage and segment conditioning.

segment_sums is the only pass over the aspect instances. Everything else here is derived
from its (entity, aspect, segment) rows, all with partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guestsignal.config import DEFAULTS, SEGMENTS, Settings
from guestsignal.functions.numbers import rounded, shrink
from guestsignal.operators.evidence import scored_rows
from guestsignal.operators.scale import materialise

CELL = ("hotel_id", "aspect")


def raw_segment_sums(instances: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Unrounded sums per (hotel, aspect, traveler type)."""
    weight, polarity, cut = F.col("weight"), F.col("polarity"), settings.polarity_cut
    return (
        scored_rows(instances)
        .groupBy(*CELL, "traveler_type")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("weight").alias("wsum"),
            F.sum(polarity * weight).alias("wpol"),
            F.sum(F.when(polarity >= cut, weight).otherwise(0.0)).alias("pos"),
            F.sum(F.when(polarity <= -cut, weight).otherwise(0.0)).alias("neg"),
        )
    )


def segment_sums(raw_sums: DataFrame) -> DataFrame:
    """The long artifact: rounded weight and weighted polarity per traveler type."""
    return raw_sums.select(
        *CELL,
        "traveler_type",
        "n",
        rounded(F.col("wsum"), 4).alias("wsum"),
        rounded(F.col("wpol"), 4).alias("wpol"),
    )


def segment_sums_wide(raw_sums: DataFrame, segments: tuple[str, ...] = SEGMENTS) -> DataFrame:
    """wsum_<type> and wpol_<type> columns, zero where a type has no rows."""
    columns = []
    for segment in segments:
        own = F.col("traveler_type") == segment
        for name in ("wsum", "wpol"):
            total = F.sum(F.when(own, F.col(name)).otherwise(0.0))
            columns.append(rounded(total, 4).alias(f"{name}_{segment}"))
    return raw_sums.groupBy(*CELL).agg(*columns)


def aspect_priors(raw_sums: DataFrame) -> DataFrame:
    """Weighted mean polarity per aspect; never more rows than the taxonomy has aspects."""
    total = F.sum("wsum")
    return raw_sums.groupBy("aspect").agg(
        F.when(total > 0, F.sum("wpol") / total).alias("prior")
    )


def aspect_scores(
    raw_sums: DataFrame, priors: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """n, evidence, raw and shrunk score, positive and negative mass per (hotel, aspect)."""
    cells = raw_sums.groupBy(*CELL).agg(
        F.sum("n").alias("n"),
        F.sum("wsum").alias("_w"),
        F.sum("wpol").alias("_p"),
        F.sum("pos").alias("_pos"),
        F.sum("neg").alias("_neg"),
    )
    raw = F.when(F.col("_w") > 0, F.col("_p") / F.col("_w"))
    score = shrink(F.col("_w"), raw, F.col("prior"), settings.shrinkage)
    return cells.join(F.broadcast(priors), "aspect").select(
        *CELL,
        "n",
        rounded(F.col("_w"), 4).alias("evidence_weight"),
        rounded(raw, 4).alias("raw_score"),
        rounded(score, 4).alias("score"),
        rounded(F.col("_pos"), 4).alias("pos_weight"),
        rounded(F.col("_neg"), 4).alias("neg_weight"),
    )


def conditioned_scores(
    sums: DataFrame,
    priors: DataFrame,
    segments: tuple[str, ...],
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Scores as one traveler type sees them, for each type in `segments`.

    One aggregation carries the totals and, per requested type, the sums of that type;
    boosting a type adds (boost - 1) times its own sums to the totals.
    """
    extra = settings.segment_boost - 1.0
    own = lambda s, c: F.sum(F.when(F.col("traveler_type") == s, F.col(c)).otherwise(0.0))
    boosted = F.array(
        *[
            F.struct(
                F.lit(s).alias("traveler_type"),
                (F.sum("wsum") + extra * own(s, "wsum")).alias("w"),
                (F.sum("wpol") + extra * own(s, "wpol")).alias("p"),
            )
            for s in segments
        ]
    )
    cells = (
        sums.groupBy(*CELL)
        .agg(F.sum("n").alias("n"), boosted.alias("_by_type"))
        .select(*CELL, "n", F.inline("_by_type"))
    )
    raw = F.when(F.col("w") > 0, F.col("p") / F.col("w")).otherwise(0.0)
    score = shrink(F.col("w"), raw, F.col("prior"), settings.shrinkage)
    return cells.join(F.broadcast(priors), "aspect").select(
        *CELL,
        "traveler_type",
        "n",
        rounded(F.col("w"), 4).alias("evidence_weight"),
        rounded(score, 4).alias("score"),
    )


def hotel_summary(reviews: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Identity and shrunk overall rating per hotel.

    The name and category most of its reviews give a hotel are its own (of equally frequent ones
    the smaller pair). They are group keys at first, so the one pass over the reviews is a hash
    aggregation of numbers; its small result is stored and gives the global mean as well.
    """
    k = settings.shrinkage
    named = materialise(
        reviews.groupBy("hotel_id", "hotel_name", "hotel_category").agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum("rating").alias("_r"),
            F.count("rating").alias("_rated"),
            F.count_if("verified").alias("_v"),
        ),
        "named",
    )
    overall = named.agg((F.sum("_r") / F.sum("_rated")).alias("g")).scalar()
    identity = F.struct("hotel_name", "hotel_category")
    grouped = (
        named.groupBy("hotel_id")
        .agg(
            F.min_by(identity, F.struct(-F.col("_n"), identity)).alias("_identity"),
            F.sum("_n").alias("n_reviews"),
            F.sum("_r").alias("_sum"),
            (F.sum("_v") / F.sum("_n")).alias("_verified"),
        )
        .select("*", "_identity.*")
    )
    shrunk = (F.col("_sum") + k * overall) / (F.col("n_reviews") + k)
    return grouped.select(
        "hotel_id",
        "hotel_name",
        "hotel_category",
        F.trim(F.element_at(F.split("hotel_name", ","), -1)).alias("city"),
        "n_reviews",
        rounded(F.col("_sum") / F.col("n_reviews"), 3).alias("mean_rating"),
        rounded(shrunk, 3).alias("shrunk_rating"),
        rounded((shrunk - 3.0) / 2.0, 4).alias("rating_norm"),
        rounded(F.col("_verified"), 3).alias("verified_share"),
    )
