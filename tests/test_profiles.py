from __future__ import annotations

from dataclasses import replace

import pytest

from guestsignal.config import DEFAULTS
from guestsignal.functions.taxonomy import DEFAULT_RULES
from guestsignal.operators import profiles


def enrich(spark, text, **options):
    table = spark.createDataFrame([("p", text)], "profile_id string, description string")
    return profiles.enrich_profiles(table, **options).first()


def test_a_full_profile(spark):
    row = enrich(spark, "Solo woman on a tight budget who wants safe streets, local markets and safe rooms.")
    assert row.traveler_type == "solo" and row.budget == "tight"
    assert row.desired_dims == ["safety", "local_culture", "value"]
    assert [d.weight for d in row.dim_weights] == [0.3846, 0.3077, 0.3077]
    assert row.archetype == "solo_female_safety"
    assert row.category_fit == {"3-star": 1.0, "4-star": 0.4, "5-star": -0.4}
    assert row.profile_summary == \
        "Solo traveler (tight budget) prioritizing safety, local culture, value for money."


def test_defaults_without_any_rule(spark):
    row = enrich(spark, "Just passing through.")
    assert (row.traveler_type, row.budget, row.desired_dims, row.archetype) == (
        "leisure", "mid", [], "leisure")


def test_first_rule_wins_and_band_name_is_readable(spark):
    row = enrich(spark, "A couple with kids, mid-to-high budget, quiet room.")
    assert row.traveler_type == "family" and row.budget == "mid_high"
    assert row.profile_summary.startswith("Family traveler (mid-high budget)")


def test_only_five_dims_are_kept(spark):
    row = enrich(spark, "safe, quiet, central, beach, nightlife, breakfast, spa; spa")
    assert len(row.desired_dims) == 5 and row.desired_dims[0] == "wellness_spa"
    assert row.desired_dims[1:] == ["safety", "location_central", "quietness", "nightlife"]
    assert sum(d.weight for d in row.dim_weights) == pytest.approx(1.0, abs=1e-3)


def test_a_theme_is_not_repeated_in_the_slug(spark):
    assert enrich(spark, "family with kids near the beach and food").archetype == "family_foodie_beach"


def test_backstop_only_below_two_rule_hits(spark):
    schema = "profile_id string, description string, vector array<float>"
    table = spark.createDataFrame(
        [("one", "quiet", [1.0, 0.0]), ("two", "quiet, safe", [1.0, 0.0]), ("no vector", "quiet", None)], schema)
    bank = spark.createDataFrame(
        [("beach_access", [0.0, 1.0]), ("beach_access", [0.9, 0.1]), ("quietness", [0.6, 0.8]), ("luxury", [0.4, 0.9])],
        "aspect string, vector array<double>")
    out = {r.profile_id: r for r in profiles.enrich_profiles(table, DEFAULT_RULES, bank).collect()}
    assert out["one"].desired_dims == ["quietness", "beach_access"]
    assert [d.weight for d in out["one"].dim_weights] == [0.6494, 0.3506]  # 1 against 0.6 * 0.9
    assert sorted(out["one"].embedding_dims) == ["beach_access", "quietness"]
    assert out["two"].embedding_dims == [] and len(out["two"].desired_dims) == 2
    assert out["no vector"].desired_dims == ["quietness"]


def test_repeat_bonus_is_a_setting(spark):
    row = enrich(spark, "spa spa quiet", settings=replace(DEFAULTS, repeat_bonus=1.0))
    assert [d.weight for d in row.dim_weights] == [0.6667, 0.3333]
