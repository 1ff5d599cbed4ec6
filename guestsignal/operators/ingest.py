"""Raw reviews and profiles -> typed, validated, weighted tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from guestsignal.config import DEFAULTS, UNKNOWN_SEGMENT, Settings
from guestsignal.functions.bands import season_of
from guestsignal.functions.text import clean_text, has_content

REQUIRED_REVIEW_COLUMNS = (
    "review_id",
    "hotel_id",
    "hotel_name",
    "hotel_category",
    "rating",
    "review_date",
    "review_text",
    "verified",
)
REQUIRED_PROFILE_COLUMNS = ("profile_id", "description")
# Readers put the text of a record they can't parse here; null for all others.
DAMAGED = "damaged_record"


def require_columns(df: DataFrame, required: tuple[str, ...], what: str) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{what} missing required columns: {missing}")
    return df


def fill_segment(df: DataFrame) -> DataFrame:
    if "traveler_type" not in df.columns:
        return df.withColumn("traveler_type", F.lit(UNKNOWN_SEGMENT))
    return df.withColumn(
        "traveler_type", F.coalesce(F.col("traveler_type"), F.lit(UNKNOWN_SEGMENT))
    )


def add_calendar(df: DataFrame, date: str = "review_date") -> DataFrame:
    day = F.col(date)
    return df.withColumns(
        {
            "year": F.year(day),
            "month": F.month(day),
            "year_month": F.date_format(day, "yyyy-MM"),
            "season": season_of(F.month(day)),
        }
    )


def _typed(raw: DataFrame) -> DataFrame:
    number = F.col("rating").try_cast("double")
    return fill_segment(raw).withColumns(
        {
            "_filled": F.coalesce(has_content(F.col("review_text")), F.lit(False)),
            "review_text": clean_text(F.coalesce(F.col("review_text"), F.lit(""))),
            "_rating": F.when(number.between(1, 5), number),
            "_date": F.col("review_date").cast("string").try_cast("timestamp").cast("date"),
            "verified": F.coalesce(
                F.col("verified").cast("string").try_cast("boolean"), F.lit(False)
            ),
        }
    )


def _damaged(df: DataFrame) -> Column:
    return F.col(DAMAGED).isNotNull() if DAMAGED in df.columns else F.lit(False)


def _usable(df: DataFrame) -> Column:
    return (
        ~_damaged(df)
        & F.col("_filled")
        & F.col("_rating").isNotNull()
        & F.col("_date").isNotNull()
    )


def clean_reviews(raw: DataFrame) -> DataFrame:
    """Validated rows with final types and calendar columns, not yet deduplicated."""
    require_columns(raw, REQUIRED_REVIEW_COLUMNS, "reviews")
    kept = (
        _typed(raw)
        .filter(_usable(raw))
        .withColumn("rating", F.col("_rating").cast("int"))
        .withColumn("review_date", F.col("_date"))
        .drop("_filled", "_rating", "_date", DAMAGED)
    )
    return add_calendar(kept)


def rejected_reviews(raw: DataFrame) -> DataFrame:
    """The rows clean_reviews drops, as they came, with the reason; of a record that could not be
    parsed that is its text, in `damaged_record`."""
    require_columns(raw, REQUIRED_REVIEW_COLUMNS, "reviews")
    carried = raw.withColumn("_raw", F.struct(*raw.columns))
    reason = (
        F.when(_damaged(raw), "damaged record")
        .when(~F.col("_filled"), "empty text")
        .when(F.col("_rating").isNull(), "rating outside 1..5")
        .otherwise("unreadable date")
    )
    return _typed(carried).filter(~_usable(raw)).select("_raw.*", reason.alias("reject_reason"))


def dedupe_first(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key: the first in a total order.

    The `= 1` filter becomes a group limit in front of the shuffle, so a key with very
    many copies sends one row per map task, not all copies, to one reducer.
    """
    ranks = {f"_order{i}": column for i, column in enumerate(order)}
    first = W.partitionBy(key).orderBy(*ranks)
    numbered = df.withColumns(ranks).withColumn("_first", F.row_number().over(first))
    return numbered.filter("_first = 1").drop("_first", *ranks)


def add_recency(
    df: DataFrame,
    settings: Settings = DEFAULTS,
    date: str = "review_date",
    anchor: Column | None = None,
) -> DataFrame:
    """0.5 ^ (age / half-life); age counts whole days back from the newest row.

    The anchor is a scalar subquery: over `df` itself, or a cheaper one the caller knows
    to give the same day.
    """
    if anchor is None:
        anchor = df.agg(F.max(date).alias("anchor")).scalar()
    age = F.greatest(F.datediff(anchor, F.col(date)), F.lit(0))
    return df.withColumn(
        "recency_weight", F.pow(F.lit(0.5), age / F.lit(settings.half_life_days))
    )


def add_trust(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    weight = F.when(F.col("verified"), settings.verified_weight).otherwise(
        settings.unverified_weight
    )
    return df.withColumn("trust_weight", weight)


def load_reviews(
    raw: DataFrame, order: list[Column] | None = None, settings: Settings = DEFAULTS
) -> DataFrame:
    """Validate, deduplicate by review_id, then weight.

    `order` says which of several rows with one id comes first. By default the oldest
    does, then the smaller hotel id, rating and hash of the whole row; rows that still
    tie are copies. The hash keeps the texts out of the sort, and out of the shuffle of
    the second, narrow pass that finds the newest date.
    """
    cleaned = clean_reviews(raw)
    whole = F.xxhash64(*sorted(cleaned.columns))
    ranking = order or [F.col("review_date"), F.col("hotel_id"), F.col("rating"), whole]
    unique = dedupe_first(cleaned, "review_id", ranking)
    return add_trust(add_recency(unique, settings), settings)


def load_profiles(raw: DataFrame) -> DataFrame:
    """Profiles with clean descriptions, without the records that could not be parsed."""
    require_columns(raw, REQUIRED_PROFILE_COLUMNS, "profiles")
    return raw.filter(~_damaged(raw)).drop(DAMAGED).withColumn(
        "description", clean_text(F.coalesce(F.col("description"), F.lit("")))
    )
