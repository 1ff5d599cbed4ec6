"""Schemas of everything that is read without inference."""

from __future__ import annotations

# Raw fields arrive as text; validation decides what they mean.
RAW_REVIEWS = (
    "review_id string, hotel_id string, hotel_name string, hotel_category string, "
    "rating string, review_date string, review_text string, verified string, "
    "traveler_type string"
)
RAW_PROFILES = "profile_id string, description string, vector array<float>"
OVERRIDES = "sentence_text string, aspects string, polarity string, reason string"
LABELS_CSV = (
    "sentence_text string, aspects string, polarity double, top_aspect_score double, "
    "aspect_scores string"
)
EMBEDDING_STORE = "sentence_hash bigint, sentence_text string, embedding array<float>"
