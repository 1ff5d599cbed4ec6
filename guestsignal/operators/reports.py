"""The dashboard's questions over the artifact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guestsignal.config import OVERALL, SEASON_ORDER
from guestsignal.functions import wording
from guestsignal.functions.numbers import rounded
from guestsignal.operators.evidence import scored_rows
from guestsignal.operators.scale import global_row_number

SHOWN_TIERS = ("strong", "moderate")


def estate_totals(hotels: DataFrame, scores: DataFrame, profiles: DataFrame) -> DataFrame:
    n_aspects = scores.agg(F.count_distinct("aspect").alias("n")).scalar()
    n_profiles = profiles.agg(F.count(F.lit(1)).alias("n")).scalar()
    totals = hotels.agg(
        F.sum("n_reviews").alias("n_reviews"), F.count(F.lit(1)).alias("n_hotels")
    )
    return totals.select(
        "n_reviews",
        "n_hotels",
        n_aspects.alias("n_aspects"),
        n_profiles.alias("n_profiles"),
    )


def compare_profiles(rich: DataFrame, profile_ids: list[str]) -> DataFrame:
    """The chosen profiles' recommendations side by side; the filter reaches the scan."""
    return rich.filter(F.col("profile_id").isin(profile_ids)).select(
        "profile_id", "archetype", F.inline("recommendations")
    )


def hotel_kpis(hotels: DataFrame, hotel_id: str) -> DataFrame:
    return hotels.filter(F.col("hotel_id") == hotel_id)


def hotel_timeline(monthly: DataFrame, drift: DataFrame, hotel_id: str) -> DataFrame:
    """Monthly mean rating; a trend worth showing stands on the newest month."""
    one = lambda df: df.filter(
        (F.col("hotel_id") == hotel_id) & (F.col("aspect") == OVERALL)
    )
    months = one(monthly)
    newest = months.agg(F.max("date").alias("d")).scalar()
    trend = one(drift).filter(~F.col("trend_tier").isin("none", "negligible"))
    note = trend.select(
        "hotel_id", F.format_string("%s (%s)", "trend_dir", "trend_tier").alias("note")
    )
    return (
        months.join(note, "hotel_id", "left")
        .withColumn("annotation", F.when(F.col("date") == newest, F.col("note")))
        .select("hotel_id", "date", "value", "n", "annotation")
        .orderBy("date")
    )


def aspect_scorecard(scores: DataFrame, priors: DataFrame, hotel_id: str) -> DataFrame:
    return (
        scores.filter(F.col("hotel_id") == hotel_id)
        .join(F.broadcast(priors), "aspect", "left")
        .select("aspect", "score", F.coalesce("prior", F.lit(0.0)).alias("prior"))
        .orderBy("score", "aspect")
    )


def season_matrix(instances: DataFrame, hotel_id: str | None = None) -> DataFrame:
    """Mean polarity per aspect and season, one column per season."""
    pool = scored_rows(instances)
    if hotel_id:
        pool = pool.filter(F.col("hotel_id") == hotel_id)
    means = [
        rounded(F.avg(F.when(F.col("season") == s, F.col("polarity"))), 6).alias(s)
        for s in SEASON_ORDER
    ]
    return pool.groupBy("hotel_id", "aspect").agg(*means)


def hotel_contradictions(contradictions: DataFrame, hotel_id: str, k: int = 5) -> DataFrame:
    return (
        contradictions.filter(F.col("hotel_id") == hotel_id)
        .withColumn("resolution", F.coalesce("resolution", F.lit(wording.NO_DRIVER)))
        .orderBy(F.col("disagreement").desc(), "aspect")
        .limit(k)
    )


def _moving(direction: str):
    return (
        (F.col("aspect") == OVERALL)
        & (F.col("trend_dir") == direction)
        & F.col("trend_tier").isin(*SHOWN_TIERS)
    )


def _seasonal():
    return (F.col("aspect") != OVERALL) & F.col("seasonal_tier").isin(*SHOWN_TIERS)


def signal_counts(drift: DataFrame) -> DataFrame:
    return drift.agg(
        F.count_if(_moving("improving")).alias("improving"),
        F.count_if(_moving("declining")).alias("declining"),
        F.count_if(_seasonal()).alias("seasonal"),
    )


def leaderboard(hotels: DataFrame) -> DataFrame:
    """All hotels with their place by adjusted rating, ranked in range partitions."""
    order = [F.col("shrunk_rating").desc(), F.col("hotel_id").asc()]
    return global_row_number(hotels, order, "place").select(
        "place",
        "hotel_id",
        "hotel_name",
        "hotel_category",
        "n_reviews",
        "mean_rating",
        "shrunk_rating",
    )


def _named(drift: DataFrame, hotels: DataFrame) -> DataFrame:
    return drift.join(hotels.select("hotel_id", "hotel_name"), "hotel_id")


def top_movers(drift: DataFrame, hotels: DataFrame, direction: str, k: int = 8) -> DataFrame:
    rho = F.col("trend_rho")
    order = rho.desc() if direction == "improving" else rho.asc()
    picked = drift.filter(_moving(direction)).orderBy(order, "hotel_id").limit(k)
    return _named(picked, hotels).select(
        "hotel_id", "hotel_name", "trend_dir", "trend_rho", "trend_tier"
    )


def seasonal_alerts(drift: DataFrame, hotels: DataFrame, k: int = 12) -> DataFrame:
    picked = (
        drift.filter(_seasonal())
        .orderBy(F.col("season_gap").desc(), "hotel_id", "aspect")
        .limit(k)
    )
    return _named(picked, hotels).select(
        "hotel_id",
        "hotel_name",
        "aspect",
        "best_season",
        "worst_season",
        "season_gap",
        "seasonal_tier",
    )


def raw_seasonal_signals(
    drift: DataFrame, hotels: DataFrame, level: float = 0.05, k: int = 10
) -> DataFrame:
    picked = (
        drift.filter((F.col("aspect") != OVERALL) & (F.col("kw_p") < level))
        .orderBy("kw_p", "hotel_id", "aspect")
        .limit(k)
    )
    return _named(picked, hotels).select(
        "hotel_id", "hotel_name", "aspect", "best_season", "worst_season", "season_gap", "kw_p"
    )


def raw_trend_signals(
    drift: DataFrame, hotels: DataFrame, level: float = 0.05, k: int = 10
) -> DataFrame:
    picked = (
        drift.filter((F.col("aspect") == OVERALL) & (F.col("trend_p") < level))
        .orderBy("trend_p", "hotel_id")
        .limit(k)
    )
    return _named(picked, hotels).select(
        "hotel_id", "hotel_name", "trend_dir", "trend_rho", "trend_p"
    )
