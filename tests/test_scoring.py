from __future__ import annotations

import pytest

from guestsignal.operators import scoring

SCHEMA = ("hotel_id string, aspect string, traveler_type string, polarity double, weight double, "
          "is_general boolean")


def cells(spark, rows):
    return scoring.raw_segment_sums(
        spark.createDataFrame([("h", a, t, p, w, a == "general") for a, t, p, w in rows], SCHEMA))


def test_mass_cut_is_inclusive_and_filler_is_left_out(spark):
    raw = cells(spark, [("a", "solo", 0.30, 1.0), ("a", "solo", 0.29, 1.0), ("a", "solo", -0.30, 2.0),
                        ("a", "solo", -0.29, 1.0), ("general", "solo", 1.0, 9.0)])
    row = scoring.aspect_scores(raw, scoring.aspect_priors(raw)).collect()
    assert len(row) == 1
    assert (row[0].n, row[0].pos_weight, row[0].neg_weight) == (4, 1.0, 2.0)


def test_shrinkage_formula(spark):
    raw = cells(spark, [("a", "solo", 1.0, 2.0), ("a", "family", -1.0, 1.0)])
    row = scoring.aspect_scores(raw, scoring.aspect_priors(raw)).first()
    assert row.raw_score == pytest.approx(1 / 3, abs=1e-4)
    assert row.score == pytest.approx(1 / 3, abs=1e-4)  # one hotel only: prior equals raw


def test_conditioning_boosts_the_own_type_and_keeps_unusual_types(spark):
    raw = cells(spark, [("a", "solo", 1.0, 2.0), ("a", "astronaut", -1.0, 2.0)])
    priors = scoring.aspect_priors(raw)
    rows = {r.traveler_type: r for r in scoring.conditioned_scores(
        scoring.segment_sums(raw), priors, ("solo", "family")).collect()}
    assert rows["solo"].evidence_weight == 4.7 and rows["family"].evidence_weight == 4.0
    assert rows["solo"].score == pytest.approx((4.7 * (0.7 / 4.7)) / 12.7, abs=1e-4)
    assert rows["family"].score == 0.0


def test_zero_weight_group_falls_back_to_the_prior(spark):
    raw = cells(spark, [("a", "solo", 1.0, 0.0), ("b", "solo", 1.0, 1.0)])
    sums = scoring.segment_sums(raw)
    priors = spark.createDataFrame([("a", 0.25), ("b", 0.5)], "aspect string, prior double")
    rows = {r.aspect: r.score for r in scoring.conditioned_scores(sums, priors, ("solo",)).collect()}
    assert rows["a"] == 0.25
    scores = {r.aspect: r.raw_score for r in scoring.aspect_scores(raw, priors).collect()}
    assert scores["a"] is None


def test_hotel_summary(spark):
    rows = [("h", "Grand, Old, Lyon", "4-star", "2", 5, True), ("h", "Grand, Old, Lyon", "4-star", "1", 2, False),
            ("g", "Plain", "x", "3", 3, False)]
    table = spark.createDataFrame(rows, "hotel_id string, hotel_name string, hotel_category string, "
                                        "review_id string, rating int, verified boolean")
    out = {r.hotel_id: r for r in scoring.hotel_summary(table).collect()}
    mean = 10 / 3
    assert out["h"].city == "Lyon" and out["g"].city == "Plain"
    assert out["h"].mean_rating == 3.5 and out["h"].verified_share == 0.5
    assert out["h"].shrunk_rating == pytest.approx((7 + 8 * mean) / 10, abs=1e-3)
    assert out["h"].rating_norm == pytest.approx(((7 + 8 * mean) / 10 - 3) / 2, abs=1e-4)


def test_wide_sums_fill_absent_types_with_zero(spark):
    row = scoring.segment_sums_wide(cells(spark, [("a", "solo", 0.5, 2.0)])).first().asDict()
    assert row["wsum_solo"] == 2.0 and row["wpol_solo"] == 1.0 and row["wsum_family"] == 0.0
