from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from guestsignal.operators import contracts, explain

SCHEMA = ("review_id string, hotel_id string, aspect string, sentence_text string, polarity double, "
          "recency_weight double, trust_weight double, review_date date, verified boolean, is_general boolean")
DAY = dt.date(2025, 1, 1)


def instances(spark, rows):
    return spark.createDataFrame(
        [(r, "h", a, s, p, w, 1.0, DAY + dt.timedelta(d), True, a == "general") for r, a, s, p, w, d in rows], SCHEMA)


def picked(spark, rows, aspects):
    packed = explain.packed_quotes(explain.best_quotes(instances(spark, rows)))
    wanted = F.array(*[F.lit(a) for a in aspects])
    row = packed.select(explain.pick_quotes(F.col("quotes"), wanted).alias("q")).first()
    return [] if row is None else [(q.review_id, q.quote, q.aspect) for q in row.q]


def test_quote_polarity_is_strict_and_filler_never_quoted(spark):
    rows = [("1", "a", "low", 0.15, 1.0, 0), ("2", "a", "ok", 0.16, 1.0, 0), ("3", "general", "hi", 0.9, 1.0, 0)]
    assert picked(spark, rows, ["a", "general"]) == [("2", "ok", "a")]


def test_one_quote_per_sentence(spark):
    rows = [("1", "a", "same", 0.9, 0.5, 0), ("2", "b", "same", 0.9, 0.9, 0), ("3", "b", "other", 0.2, 0.5, 0)]
    assert picked(spark, rows, ["a", "b"]) == [("2", "same", "b"), ("3", "other", "b")]


def test_prelimited_quotes_equal_picking_from_everything(spark):
    rng = random.Random(6)
    rows = [(f"{i:03}", rng.choice("abcd"), f"s{rng.randint(0, 12)}", rng.choice([0.1, 0.5, 0.8]),
             rng.choice([0.25, 0.5, 1.0]), rng.randint(0, 3)) for i in range(150)]
    for aspects in ("ab", "acd", "d", "abcd"):
        pool = sorted((-round(p * w, 12), -d, r, s, a) for r, a, s, p, w, d in rows if a in aspects and p > 0.15)
        expected, seen = [], set()
        for _, _, r, s, a in pool:
            if s not in seen and len(expected) < 3:
                seen.add(s)
                expected.append((r, s, a))
        assert picked(spark, rows, list(aspects)) == expected


def guard(spark, text, quotes=("room 12",)):
    frame = spark.createDataFrame([(text, list(quotes))], "t string, q array<string>")
    return frame.select(explain.guard_text(
        F.col("t"), F.lit("Grand Palace, Rome"), F.lit("4-star"), F.col("q"), F.lit("TEMPLATE"))).first()[0]


def test_generated_text_guard(spark):
    assert guard(spark, "Polished: the grand one has 4 stars and room 12.") == "the grand one has 4 stars and room 12."
    for bad in ("", "no name", "Grand with 7 pools", "Grand " + "x" * 600):
        assert guard(spark, bad) == "TEMPLATE"
    assert guard(spark, None) == "TEMPLATE"
    assert guard(spark, "answer : Grand.") == "Grand."


def test_justification_and_caveat_texts(spark):
    frame = spark.createDataFrame(
        [([("safety", 0.5), ("value", 0.04), ("service", 0.125)], "Nice.", [(-0.5, "value", None), (-0.9, "safety", "Solo lean.")])],
        "c array<struct<aspect:string,score:double>>, q string, k array<struct<minus:double,aspect:string,resolution:string>>")
    row = frame.select(
        explain.justification(F.lit("Inn"), F.lit(2), F.col("c"), F.col("q")).alias("j"),
        explain.contradiction_caveat(F.col("k"), F.array(F.lit("value"), F.lit("safety"))).alias("both"),
        explain.contradiction_caveat(F.col("k"), F.array(F.lit("value"))).alias("plain"),
        explain.contradiction_caveat(F.col("k"), F.array(F.lit("luxury"))).alias("none"),
        explain.matched_aspects(F.col("c")).alias("m"),
    ).first()
    assert row.j == ('Inn ranks #2 for this traveler on safety (+0.50), service (+0.13), '
                     'weighted by what matters most to them. Guests note: "Nice."')
    assert row.both == "Reviewers are split on safety. Solo lean."
    assert row.plain == "Reviewers are split on value for money." and row.none is None
    assert row.m == ["safety", "service"]


RICH = ("profile_id string, archetype string, profile_summary string, desired_dims array<string>, recommendations array<struct<"
        "rank:int,hotel_id:string,hotel_name:string,hotel_category:string,score:double,matched_aspects:array<string>,"
        "aspect_scores:map<string,double>,justification:string,supporting_evidence:array<struct<review_id:string,quote:string,"
        "aspect:string,date:string,verified:boolean,sentiment:double>>,caveats:string>>")


def rich(spark, **changes):
    quote = ("r", "q", "a", "2025-01-01", True, 0.5)
    rec = {"rank": 1, "hotel_id": "h", "hotel_name": "n", "hotel_category": "c", "score": 5.4, "matched": ["a"],
           "scores": {"a": 0.1}, "why": "x" * 800, "quotes": [quote], "caveats": None} | changes
    return spark.createDataFrame([("p", "slug", "sum", ["a"], [tuple(rec.values())])], RICH)


def test_contract(spark):
    assert contracts.contract_violations(rich(spark)).count() == 0
    broken = {"rank": 6, "why": "x" * 801, "hotel_name": None, "quotes": []}
    for field, value in broken.items():
        table = rich(spark, **{field: value})
        assert contracts.contract_violations(table).count() == 1
        with pytest.raises(ValueError, match="contract"):
            contracts.enforce_contract(table)
    everyone = spark.createDataFrame([("p",), ("silent",)], "profile_id string")
    assert [tuple(r) for r in contracts.contract_violations(rich(spark), everyone).collect()] == [
        ("silent", "no recommendation")]


def test_submission_is_a_projection(spark):
    row = contracts.submission_output(rich(spark)).first()
    assert row.top_hotels[0].asDict() == {
        "rank": 1, "hotel_id": "h", "hotel_name": "n", "hotel_category": "c", "score": 5.4}


def test_one_hotel_with_very_long_quotes_meets_all_picks(spark):
    """All picks are of one hotel: they go to several tasks, and so do its quotes, of any size."""
    long = "so good " * 40_000
    quotes = explain.best_quotes(instances(spark, [("1", "a", long, 0.9, 1.0, 0), ("2", "b", "short", 0.5, 1.0, 0)]))
    picks = [(f"i{k}", "solo", "mid", [("a", 0.6), ("b", 0.4)], 1, "h", "Inn", "3-star", 0.5, 3.0, [("a", 0.5)], 0.0) for k in range(400)]
    described = spark.createDataFrame(picks, (
        "intent string, traveler_type string, budget string, dim_weights array<struct<aspect:string,weight:double>>, rank int, "
        "hotel_id string, hotel_name string, hotel_category string, composite double, display_score double, "
        "contributions array<struct<aspect:string,score:double>>, drift_penalty double"))
    split = spark.createDataFrame([("h", "b", 0.5, "Why not.")], "hotel_id string, aspect string, disagreement double, resolution string")
    drift = spark.createDataFrame(
        [("h", "a", "strong", "summer", "winter", "none", None), ("h", "overall", "none", None, None, "weak", "declining"),
         ("h", "zz", "strong", "summer", "winter", "none", None), ("g", "a", "strong", "summer", "winter", "none", None)],
        "hotel_id string, aspect string, seasonal_tier string, best_season string, worst_season string, trend_tier string, trend_dir string")
    told = explain.explained_picks(described, quotes, split, {}, drift=drift).collect()
    assert len(told) == 400
    assert {tuple(e.quote for e in r.supporting_evidence) for r in told} == {(long, "short")}
    assert {r.caveats for r in told} == {
        "Reviewers are split on b. Why not. a varies by season — strongest in summer, weakest in winter (strong confidence). "
        "Overall rating has been declining over time (weak confidence)."}
    without = explain.explained_picks(described.limit(1), quotes, split.limit(0), {}).first()
    assert without.caveats is None
