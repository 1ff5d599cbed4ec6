"""Names for numeric ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from guestsignal.config import SEASON_MONTHS, TIERS

# Lower edges of the sentiment bands; the two lowest edges are strict.
BAND_EDGES = (
    (0.5, "very_positive", True),
    (0.15, "positive", True),
    (-0.15, "neutral", False),
    (-0.5, "negative", False),
)
LOWEST_BAND = "very_negative"
DEFAULT_STARS = 3


def confidence_tier(adjusted_p: Column) -> Column:
    tier = F.when(adjusted_p.isNull(), F.lit("none"))
    for limit, name in TIERS:
        tier = tier.when(adjusted_p < limit, F.lit(name))
    return tier.otherwise(F.lit("negligible"))


def season_of(month: Column) -> Column:
    season = None
    for name, months in SEASON_MONTHS.items():
        hit = month.isin(*months)
        season = F.when(hit, name) if season is None else season.when(hit, name)
    return season


def sentiment_band(value: Column) -> Column:
    band = None
    for edge, name, inclusive in BAND_EDGES:
        hit = value >= edge if inclusive else value > edge
        band = F.when(hit, name) if band is None else band.when(hit, name)
    return band.otherwise(F.lit(LOWEST_BAND))


def star_number(category: Column) -> Column:
    """'4-star' -> 4; anything unreadable counts as three; always within 0..5."""
    number = F.trim(F.split(category, "-").getItem(0)).try_cast("int")
    return F.least(F.greatest(F.coalesce(number, F.lit(DEFAULT_STARS)), F.lit(0)), F.lit(5))
