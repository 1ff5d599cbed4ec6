from __future__ import annotations

import random
from decimal import ROUND_HALF_UP, Decimal

import pytest

from guestsignal.config import DEFAULTS, DRIFT_PENALTY
from guestsignal.functions.taxonomy import CATEGORY_FIT
from guestsignal.operators import ranking

ASPECTS = ("a", "b", "c")
TYPES = ("solo", "family")
PROFILES = ("profile_id string, traveler_type string, budget string, "
            "dim_weights array<struct<aspect:string,weight:double>>")


def half_up(value, digits):
    return float(Decimal(repr(round(value, 8))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def world(spark, seed, n_hotels, n_profiles):
    rng = random.Random(seed)
    hotels = [(f"h{i:03}", f"Hotel {i}, X", f"{rng.randint(3, 6)}-star", round(rng.uniform(-1, 1), 2))
              for i in range(n_hotels)]
    cond = [(h[0], a, t, rng.choice([1.5, 2.0, 9.0]), round(rng.uniform(-1, 1), 1))
            for h in hotels for a in ASPECTS for t in TYPES if rng.random() < 0.8]
    drift = [(h[0], a, rng.choice(["improving", "declining", None]), rng.choice(["strong", "moderate", "weak", "negligible", "none"]))
             for h in hotels for a in ASPECTS]
    shapes = [[("a", 1.0)], [("b", 0.5556), ("a", 0.4444)], [("c", 0.4), ("b", 0.3), ("a", 0.3)], [], [("zz", 1.0)]]
    people = [(f"p{i}", rng.choice(TYPES), rng.choice([*CATEGORY_FIT]), rng.choice(shapes)) for i in range(n_profiles)]
    frames = (
        spark.createDataFrame(people, PROFILES),
        spark.createDataFrame(cond, "hotel_id string, aspect string, traveler_type string, evidence_weight double, score double"),
        spark.createDataFrame(hotels, "hotel_id string, hotel_name string, hotel_category string, rating_norm double"),
        spark.createDataFrame(drift, "hotel_id string, aspect string, trend_dir string, trend_tier string"),
    )
    return (people, cond, hotels, drift), frames


def brute_force(people, cond, hotels, drift):
    score = {(h, a, t): s for h, a, t, _, s in cond}
    evidence = {(h, a, t): e for h, a, t, e, _ in cond}
    penalty = {(h, a): DRIFT_PENALTY.get(tier, 0.0) for h, a, d, tier in drift if d == "declining"}
    out = {}
    for p, t, budget, dims in people:
        ranked = []
        for h, _, category, rating in hotels:
            if dims and evidence.get((h, dims[0][0], t), -1) < DEFAULTS.min_evidence:
                continue
            value = sum(w * score.get((h, a, t), 0.0) for a, w in dims) + 0.15 * rating
            value += 0.10 * CATEGORY_FIT[budget].get(category, 0.0)
            value -= sum(penalty.get((h, a), 0.0) for a, _ in dims)
            ranked.append((-half_up(value, 4), h, half_up((value + 1) * 2.5, 3)))
        for place, (minus, h, shown) in enumerate(sorted(ranked)[:5], 1):
            out[p, place] = (h, -minus, shown)
    return out


@pytest.mark.parametrize("blocks", [(8192, 8192), (7, 3)])
def test_ranking_against_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(ranking, "HOTELS_PER_BLOCK", blocks[0])
    monkeypatch.setattr(ranking, "INTENTS_PER_BLOCK", blocks[1])
    plain, (people, cond, hotels, drift) = world(spark, 4, 40, 60)
    described = ranking.rank_all(people, cond, hotels, drift, TYPES, ASPECTS)
    rows = ranking.ranked_profiles(people, described).collect()
    assert {(r.profile_id, r["rank"]): (r.hotel_id, r.composite, r.display_score) for r in rows} == brute_force(*plain)


def test_blocks_are_skipped_by_proof_and_nothing_is_lost(spark, monkeypatch):
    """Small blocks of many hotels: most pairs of intent and block are ruled out, ties included."""
    monkeypatch.setattr(ranking, "HOTELS_PER_BLOCK", 25)
    monkeypatch.setattr(ranking, "BLOCK_SHARE", 0.001)
    plain, (people, cond, hotels, drift) = world(spark, 9, 700, 80)
    wanted = ranking.intents(people)
    cards = ranking.materialise(ranking.hotel_cards(cond, hotels, drift, TYPES, ASPECTS))
    best, work = ranking.rank_in_blocks(wanted, cards, ASPECTS)
    described = ranking.describe_picks(best, wanted, cards, ASPECTS)
    rows = ranking.ranked_profiles(people, described).collect()
    assert {(r.profile_id, r["rank"]): (r.hotel_id, r.composite, r.display_score) for r in rows} == brute_force(*plain)
    done = work.collect()
    assert max(r.n_blocks for r in done) > 10
    met, pairs = sum(r.n_met for r in done), sum(r.n_pairs for r in done)
    assert met < 0.5 * pairs, f"{met} of {pairs} pairs met"


def test_one_hotel_in_every_top_five(spark):
    hotels = [("h0", "Best, X", "3-star", 1.0), *[(f"h{i}", f"Other {i}, X", "3-star", 0.0) for i in range(1, 9)]]
    cond = [(h[0], a, "solo", 9.0, 1.0 if h[0] == "h0" else -0.1 * int(h[0][1])) for h in hotels for a in ASPECTS]
    people = [(f"p{i}", "solo", "mid", [("a", 0.5 + i / 1000), ("b", 0.5 - i / 1000)]) for i in range(300)]
    described = ranking.rank_all(
        spark.createDataFrame(people, PROFILES),
        spark.createDataFrame(cond, "hotel_id string, aspect string, traveler_type string, evidence_weight double, score double"),
        spark.createDataFrame(hotels, "hotel_id string, hotel_name string, hotel_category string, rating_norm double"),
        None, ("solo",), ASPECTS).collect()
    assert len(described) == 1500
    assert {(r.hotel_id, r.hotel_name) for r in described if r["rank"] == 1} == {("h0", "Best, X")}


def test_ties_go_to_the_smaller_id_and_empty_worlds_give_no_rows(spark):
    hotels = spark.createDataFrame([(h, h, "3-star", 0.0) for h in ("c", "a", "b")],
                                   "hotel_id string, hotel_name string, hotel_category string, rating_norm double")
    cond = spark.createDataFrame([(h, "a", "solo", 5.0, 0.2) for h in ("c", "a", "b")],
                                 "hotel_id string, aspect string, traveler_type string, evidence_weight double, score double")
    people = spark.createDataFrame([("p", "solo", "mid", [("a", 1.0)]), ("q", "solo", "mid", [("b", 1.0)])], PROFILES)
    described = ranking.rank_all(people, cond, hotels, None, ("solo",), ("a", "b"))
    rows = ranking.ranked_profiles(people, described).collect()
    assert [(r.profile_id, r["rank"], r.hotel_id) for r in sorted(rows, key=lambda r: r["rank"])] == [
        ("p", 1, "a"), ("p", 2, "b"), ("p", 3, "c")]


def test_profiles_share_the_work_of_one_intent(spark):
    people = spark.createDataFrame([(f"p{i}", "solo", "mid", [("a", 1.0)]) for i in range(50)], PROFILES)
    assert ranking.intents(people).count() == 1
