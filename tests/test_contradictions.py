from __future__ import annotations

from dataclasses import replace

from guestsignal.config import DEFAULTS
from guestsignal.operators import contradictions as contra

SCHEMA = ("hotel_id string, aspect string, polarity double, weight double, verified boolean, "
          "traveler_type string, is_general boolean")


def found(spark, rows, **settings):
    table = spark.createDataFrame([("h", "a", p, 1.0, v, t, False) for p, v, t in rows], SCHEMA)
    return contra.contradictions(contra.cell_splits(table), settings=replace(DEFAULTS, **settings)).collect()


def half(n, **kind):
    return [(1.0 if i % 2 else -1.0, kind.get("v", True), kind.get("t", "unknown")) for i in range(n)]


def test_needs_ten_rows(spark):
    assert found(spark, half(9)) == []
    row = found(spark, half(10))[0]
    assert (row.n, row.pos_share, row.disagreement, row.resolution) == (10, 0.5, 1.0, None)


def test_neutral_rows_count_for_size_but_not_for_share(spark):
    rows = half(4) + [(0.29, True, "unknown")] * 6
    assert found(spark, rows)[0].pos_share == 0.5


def test_verified_split_is_explained(spark):
    rows = [(1.0, True, "unknown")] * 5 + [(-1.0, False, "unknown")] * 5
    assert found(spark, rows)[0].resolution == \
        "Verified reviewers are more positive (+1.00 vs -1.00 unverified)."


def test_small_side_explains_nothing(spark):
    rows = [(1.0, True, "unknown")] * 6 + [(-1.0, False, "unknown")] * 4
    assert found(spark, rows)[0].resolution is None


def test_of_equal_gaps_the_later_candidate_wins(spark):
    rows = [(1.0, True, "solo")] * 5 + [(-1.0, False, "group")] * 5
    assert found(spark, rows)[0].resolution == "Group travelers rate it lower (-1.00 vs +1.00 for others)."


def test_unknown_is_never_the_explanation(spark):
    rows = [(1.0, True, "unknown"), (-1.0, True, "astronaut")] * 6
    assert found(spark, rows)[0].resolution is None
