from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from guestsignal.functions.text import clean_text
from guestsignal.operators import ingest

SCHEMA = (
    "review_id string, hotel_id string, hotel_name string, hotel_category string, rating string, "
    "review_date string, review_text string, verified string, traveler_type string"
)


def raw(spark, rows):
    full = [
        (
            r.get("id", str(i)), "h1", "Inn, Oslo", "3-star", r.get("rating", "4"),
            r.get("date", "2025-01-01"), r.get("text", "Fine."), r.get("verified", "true"),
            r.get("type"),
        )
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(full, SCHEMA)


def test_rating_bounds_and_truncation(spark):
    given = ["0", "0.9", "1", "4.7", "5", "5.1", "4", "x", None]
    kept = ingest.clean_reviews(raw(spark, [{"rating": r, "id": str(r)} for r in given]))
    assert {r.review_id: r.rating for r in kept.collect()} == {"1": 1, "4.7": 4, "5": 5, "4": 4}


def test_text_cleanup(spark):
    messy = " a\u0097b�c  \t d e\x1f "
    row = spark.createDataFrame([(messy,)], "t string").select(clean_text(F.col("t"))).first()
    assert row[0] == "a—b—c d e"


def test_blank_text_bad_date_and_reject_reasons(spark):
    rows = [{"id": "ok"}, {"id": "blank", "text": "  \t"}, {"id": "null", "text": None},
            {"id": "date", "date": "soon"}, {"id": "low", "rating": "0"}]
    table = raw(spark, rows)
    assert [r.review_id for r in ingest.clean_reviews(table).collect()] == ["ok"]
    reasons = {r.review_id: r.reject_reason for r in ingest.rejected_reviews(table).collect()}
    assert reasons == {"blank": "empty text", "null": "empty text", "date": "unreadable date",
                       "low": "rating outside 1..5"}


def test_dedupe_comes_after_the_filters(spark):
    rows = [{"id": "a", "rating": "9", "date": "2024-01-01"},
            {"id": "a", "rating": "2", "date": "2024-01-02"},
            {"id": "a", "rating": "3", "date": "2024-01-03"}]
    loaded = ingest.load_reviews(raw(spark, rows), [F.col("review_date")]).collect()
    assert [(r.review_id, r.rating) for r in loaded] == [("a", 2)]


def test_weights_halve_per_year_and_anchor_is_newest_kept_row(spark):
    newest = dt.date(2025, 12, 31)
    days = {"now": 0, "one": 365, "two": 730}
    rows = [{"id": k, "date": str(newest - dt.timedelta(d)), "verified": "false" if k == "one" else "true"}
            for k, d in days.items()]
    rows.append({"id": "rejected", "rating": "x", "date": "2030-01-01"})
    loaded = {r.review_id: r for r in ingest.load_reviews(raw(spark, rows)).collect()}
    assert {k: round(r.recency_weight, 9) for k, r in loaded.items()} == {
        "now": 1.0, "one": 0.5, "two": 0.25}
    assert loaded["one"].trust_weight == 0.8 and loaded["now"].trust_weight == 1.0


def test_calendar_and_segment(spark):
    rows = [{"id": m, "date": f"2024-{m}-15"} for m in ("02", "03", "08", "11", "12")]
    loaded = {r.review_id: r for r in ingest.clean_reviews(raw(spark, rows)).collect()}
    assert [loaded[m].season for m in ("02", "03", "08", "11", "12")] == [
        "winter", "spring", "summer", "autumn", "winter"]
    assert loaded["08"].year_month == "2024-08" and loaded["08"].traveler_type == "unknown"
    without = raw(spark, [{}]).drop("traveler_type")
    assert ingest.clean_reviews(without).first().traveler_type == "unknown"


def test_text_false_is_not_verified(spark):
    rows = [{"id": v or "null", "verified": v} for v in ("true", "false", "maybe", None)]
    kept = ingest.clean_reviews(raw(spark, rows)).collect()
    assert {r.review_id: r.verified for r in kept} == {
        "true": True, "false": False, "maybe": False, "null": False}


def test_missing_columns_raise(spark):
    with pytest.raises(ValueError, match="rating"):
        ingest.clean_reviews(raw(spark, [{}]).drop("rating"))
