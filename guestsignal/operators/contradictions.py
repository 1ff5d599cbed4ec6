"""Where reviewers disagree, and which reviewer group explains it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guestsignal.config import DEFAULTS, EXPLAINING_SEGMENTS, Settings
from guestsignal.functions import wording
from guestsignal.functions.numbers import rounded, signed_2dp
from guestsignal.functions.text import capitalised
from guestsignal.operators.evidence import scored_rows

CELL = ("hotel_id", "aspect")


def _group_sums(prefix: str, member: Column | None) -> list[Column]:
    pick = (lambda c: c) if member is None else (lambda c: F.when(member, c).otherwise(0.0))
    rows = F.count(F.lit(1)) if member is None else F.count_if(member)
    return [
        rows.alias(f"{prefix}_n"),
        F.sum(pick(F.col("weight"))).alias(f"{prefix}_w"),
        F.sum(pick(F.col("polarity") * F.col("weight"))).alias(f"{prefix}_p"),
    ]


def cell_splits(
    instances: DataFrame,
    segments: tuple[str, ...] = EXPLAINING_SEGMENTS,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """All sums both the disagreement and its explanations need, in one aggregation."""
    polarity, weight, cut = F.col("polarity"), F.col("weight"), settings.polarity_cut
    sums = _group_sums("all", None) + _group_sums("ver", F.col("verified"))
    for i, segment in enumerate(segments):
        sums += _group_sums(f"s{i}", F.col("traveler_type") == segment)
    return (
        scored_rows(instances)
        .groupBy(*CELL)
        .agg(
            F.sum(F.when(polarity >= cut, weight).otherwise(0.0)).alias("pos"),
            F.sum(F.when(polarity <= -cut, weight).otherwise(0.0)).alias("neg"),
            *sums,
        )
    )


def disagreement(splits: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Cells with enough rows whose positive and negative mass are close to balance."""
    share = F.col("pos") / (F.col("pos") + F.col("neg"))
    index = rounded(2 * F.least(F.col("_share"), 1 - F.col("_share")), 4)
    return (
        splits.filter(
            (F.col("pos") + F.col("neg") > 0)
            & (F.col("all_n") >= settings.min_disagreement_rows)
        )
        .withColumn("_share", share)
        .withColumn("disagreement", index)
        .filter(F.col("disagreement") >= settings.min_disagreement)
        .withColumn("n", F.col("all_n"))
        .withColumn("pos_share", rounded(F.col("_share"), 3))
        .drop("_share")
    )


def _mean(prefix: str) -> Column:
    return F.when(F.col(f"{prefix}_w") > 0, F.col(f"{prefix}_p") / F.col(f"{prefix}_w"))


def _rest_mean(prefix: str) -> Column:
    weight = F.col("all_w") - F.col(f"{prefix}_w")
    return F.when(weight > 0, (F.col("all_p") - F.col(f"{prefix}_p")) / weight)


def split_gap(prefix: str, settings: Settings = DEFAULTS) -> Column:
    """Mean of a group minus mean of everyone else, where both have enough rows."""
    own, others = F.col(f"{prefix}_n"), F.col("all_n") - F.col(f"{prefix}_n")
    enough = (own >= settings.min_split_rows) & (others >= settings.min_split_rows)
    return F.when(enough, _mean(prefix) - _rest_mean(prefix))


def _story(prefix: str, text: str, leans: tuple[str, str], *subject: Column) -> Column:
    """One of the fixed texts; only used where both means exist."""
    gap = _mean(prefix) - _rest_mean(prefix)
    lean = F.when(gap > 0, leans[0]).otherwise(leans[1])
    means = signed_2dp(_mean(prefix)), signed_2dp(_rest_mean(prefix))
    return F.format_string(text, *subject, lean, *means)


def resolution(
    segments: tuple[str, ...] = EXPLAINING_SEGMENTS, settings: Settings = DEFAULTS
) -> Column:
    """Text of the widest split; of equally wide ones the later candidate. Null without one."""
    stories = [("ver", _story("ver", wording.VERIFIED_SPLIT, wording.VERIFIED_LEANS))]
    for i, segment in enumerate(segments):
        subject = capitalised(F.lit(segment))
        text = _story(f"s{i}", wording.SEGMENT_SPLIT, wording.SEGMENT_LEANS, subject)
        stories.append((f"s{i}", text))
    candidates = [
        F.when(
            F.abs(split_gap(prefix, settings)) >= settings.min_split_gap,
            F.struct(
                F.round(F.abs(split_gap(prefix, settings)), 10).alias("gap"),
                F.lit(place).alias("place"),
                text.alias("text"),
            ),
        )
        for place, (prefix, text) in enumerate(stories)
    ]
    return F.array_max(F.array_compact(F.array(*candidates)))["text"]


def contradictions(
    splits: DataFrame,
    segments: tuple[str, ...] = EXPLAINING_SEGMENTS,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    return disagreement(splits, settings).select(
        *CELL,
        "n",
        "pos_share",
        "disagreement",
        resolution(segments, settings).alias("resolution"),
    )


def segment_gaps(
    splits: DataFrame,
    segments: tuple[str, ...] = EXPLAINING_SEGMENTS,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Long view of the one-against-the-rest gaps."""
    rows = [
        F.struct(
            F.lit(s).alias("traveler_type"),
            F.col(f"s{i}_n").alias("n_segment"),
            rounded(split_gap(f"s{i}", settings), 4).alias("gap"),
        )
        for i, s in enumerate(segments)
    ]
    return splits.select(*CELL, F.inline(F.array(*rows)))


__all__ = ["cell_splits", "contradictions", "disagreement", "resolution", "segment_gaps", "split_gap"]
