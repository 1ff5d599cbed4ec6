"""Every tunable of the analytics in one immutable record."""

from __future__ import annotations

from dataclasses import dataclass

# The calendar and the tiers are part of the result contract.
SEASON_ORDER = ("spring", "summer", "autumn", "winter")
SEASON_MONTHS = {
    "spring": (3, 4, 5),
    "summer": (6, 7, 8),
    "autumn": (9, 10, 11),
    "winter": (12, 1, 2),
}
TIERS = ((0.01, "strong"), (0.05, "moderate"), (0.10, "weak"))
DRIFT_PENALTY = {"strong": 0.08, "moderate": 0.05, "weak": 0.02}
SEGMENTS = ("business", "leisure", "family", "couple", "group", "solo", "unknown")
# Segments tried as an explanation of a disagreement; a later one wins a tie.
EXPLAINING_SEGMENTS = ("business", "family", "couple", "solo", "group", "leisure")
UNKNOWN_SEGMENT = "unknown"
OVERALL = "overall"


@dataclass(frozen=True)
class Settings:
    half_life_days: float = 365.0
    verified_weight: float = 1.0
    unverified_weight: float = 0.8
    segment_boost: float = 1.35
    shrinkage: float = 8.0
    aspect_threshold: float = 0.50
    polarity_cut: float = 0.30
    min_per_season: int = 5
    min_for_trend: int = 12
    top_n: int = 5
    rating_weight: float = 0.15
    category_weight: float = 0.10
    min_evidence: float = 2.0
    quotes: int = 3
    quote_polarity: float = 0.15
    matched_cut: float = 0.05
    min_disagreement_rows: int = 10
    min_disagreement: float = 0.40
    min_split_gap: float = 0.35
    min_split_rows: int = 5
    repeat_bonus: float = 0.25
    min_rule_dims: int = 2
    backstop_similarity: float = 0.50
    backstop_factor: float = 0.6
    max_dims: int = 5
    max_justification: int = 800
    max_generated: int = 600
    search_k: int = 10


DEFAULTS = Settings()
