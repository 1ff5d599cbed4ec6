from __future__ import annotations

import datetime as dt
import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from guestsignal.config import DEFAULTS, SEASON_ORDER
from guestsignal.functions.bands import confidence_tier
from guestsignal.functions.tails import beta_cdf, chi2_tail, t_two_sided
from guestsignal.operators import temporal
from guestsignal.operators.scale import materialise

SCHEMA = "hotel_id string, aspect string, value double, season string, review_date date"
DAY = dt.date(2024, 3, 1)


def table(spark, rows):
    return spark.createDataFrame(
        [(h, a, float(v), s, DAY + dt.timedelta(d)) for h, a, v, s, d in rows], SCHEMA)


def one(spark, rows, **options):
    return temporal.drift_tests(table(spark, rows), **options).first()


def mid_ranks(values):
    ordered = sorted(values)
    return [(ordered.index(v) + 1 + len(ordered) - ordered[::-1].index(v)) / 2 for v in values]


def kruskal(groups):
    pooled = [v for g in groups for v in g]
    ranks, n, start, total = mid_ranks(pooled), len(pooled), 0, 0.0
    for g in groups:
        total += sum(ranks[start:start + len(g)]) ** 2 / len(g)
        start += len(g)
    ties = sum(pooled.count(v) ** 3 - pooled.count(v) for v in set(pooled))
    return (12 / (n * (n + 1)) * total - 3 * (n + 1)) / (1 - ties / (n**3 - n))


def test_tail_values():
    # Standard table values.
    assert chi2_tail(np.array([3.841459, 5.991465, 7.814728, 11.0705]), np.array([1., 2., 3., 5.])) == \
        pytest.approx([0.05] * 4, abs=1e-6)
    rho = 2.228139 / math.sqrt(10 + 2.228139**2)
    assert t_two_sided(np.array([rho, 1.0, 0.0, np.nan]), np.array([12.] * 4))[:3] == \
        pytest.approx([0.05, 0.0, 1.0], abs=1e-6)
    assert beta_cdf(np.array([2.0]), np.array([3.0]), np.array([0.4]))[0] == pytest.approx(0.5248)


def test_tails_of_very_large_cells():
    """Close to the normal tail; the continued fraction settles for any size."""
    for n in (1e3, 1e6, 1e9, 1e12):
        z = np.array([0.1, 1.0, 1.959964, 4.0])
        found = t_two_sided(z / np.sqrt(n - 2 + z * z), np.full(4, n))
        assert found == pytest.approx([math.erfc(v / math.sqrt(2)) for v in z], rel=100 / n + 1e-4)
    assert t_two_sided(np.array([0.3, 0.9]), np.array([1e6, 1e6])) == pytest.approx([0.0, 0.0], abs=1e-300)


def test_kruskal_and_extremes_against_brute_force(spark):
    rng = random.Random(5)
    rows = [("h", a, rng.choice([-1, -0.4, 0.1, 0.1, 0.8]), s, i)
            for a in "ab" for s in SEASON_ORDER for i in range(rng.choice([4, 5, 9]))]
    for r in temporal.drift_tests(table(spark, rows)).collect():
        groups = {s: [v for _, a, v, t, _ in rows if a == r.aspect and t == s] for s in SEASON_ORDER}
        kept = {s: g for s, g in groups.items() if len(g) >= 5}
        assert r.n_seasons == len(kept)
        if len(kept) >= 2:
            assert r.kw_h == pytest.approx(kruskal(list(kept.values())))
            means = {s: sum(g) / len(g) for s, g in kept.items()}
            assert r.season_gap == pytest.approx(max(means.values()) - min(means.values()), abs=1e-4)


def test_season_ties_small_seasons_and_no_variance(spark):
    equal = [("h", "a", v, s, i) for s in ("winter", "autumn", "summer") for i, v in enumerate([0, 1] * 3)]
    row = one(spark, equal)
    assert (row.best_season, row.worst_season, row.season_gap) == ("summer", "summer", 0.0)
    assert row.kw_h == pytest.approx(0.0, abs=1e-12) and row.kw_p == pytest.approx(1.0)
    flat = one(spark, [("h", "a", 0.5, s, i) for s in ("winter", "spring") for i in range(5)])
    assert flat.kw_p is None and flat.best_season == "spring" and flat.season_gap == 0.0
    short = one(spark, [("h", "a", i, s, i) for s, k in (("winter", 5), ("spring", 4)) for i in range(k)])
    assert short.kw_p is None and short.best_season is None and short.season_gap is None


def test_trend_limits(spark):
    rising = [("h", "a", i, "spring", i) for i in range(12)]
    row = one(spark, rising)
    assert (row.trend_rho, row.trend_p, row.trend_dir) == (1.0, 0.0, "improving")
    falling = one(spark, [("h", "a", -i, "spring", i) for i in range(12)])
    assert (falling.trend_rho, falling.trend_dir) == (-1.0, "declining")
    for rows in (rising[:11],  # too few
                 [("h", "a", 1, "spring", i) for i in range(12)],  # one value
                 [("h", "a", i, "spring", 0) for i in range(12)]):  # one day
        assert one(spark, rows).trend_rho is None


def test_spearman_against_brute_force(spark):
    rng = random.Random(8)
    rows = [("h", "a", rng.randint(0, 6), "spring", rng.randint(0, 9)) for _ in range(40)]
    x, y = mid_ranks([r[4] for r in rows]), mid_ranks([r[2] for r in rows])
    assert one(spark, rows).trend_rho == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-4)


def test_two_step_ranks_equal_one_window(spark):
    rng = random.Random(3)
    rows = [("h", a, rng.choice([rng.uniform(-50, 50), 0.0, 7.25]), rng.choice(SEASON_ORDER), rng.randint(0, 60))
            for a in "ab" for _ in range(300)]
    values = table(spark, rows)
    columns = ["aspect", "n", "kw_h", "trend_rho", "best_season"]
    one_window = sorted(temporal.drift_tests(values, bounded_values=True).select(columns).collect())
    for range_rows in (10, 50_000):
        found = temporal.drift_tests(values, bounded_values=False, range_rows=range_rows).select(columns)
        for a, b in zip(one_window, sorted(found.collect())):
            assert (a.n, a.trend_rho, a.best_season) == (b.n, b.trend_rho, b.best_season)
            assert a.kw_h == pytest.approx(b.kw_h)


def test_a_hot_cell_of_close_values_is_ranked_by_many_tasks(spark):
    """All values lie between 1000 and 1020: ranges follow the cell's own quantiles."""
    rows = spark.range(80_000).select(
        F.lit("h").alias("hotel_id"), F.lit("a").alias("aspect"),
        (1000 + F.pmod(F.xxhash64("id"), F.lit(20_000_000)) / 1e6).alias("value"),
        F.element_at(F.array(*map(F.lit, SEASON_ORDER)), (F.col("id") % 4 + 1).cast("int")).alias("season"),
        F.date_add(F.lit(DAY), (F.col("id") % 50).cast("int")).alias("review_date"))
    blocks = temporal.tie_blocks(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranks = temporal._value_ranks(blocks, SEASON_ORDER, 5, False, range_rows=2000)
        per_task = [r.n for r in ranks.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(per_task) == 8 and max(per_task) < 0.3 * sum(per_task)
    window = temporal._value_ranks(blocks, SEASON_ORDER, 5, True)
    columns = ["value", "mid", "kw_mid", "tie", "n", "kw_n"]
    assert ranks.select(columns).exceptAll(window.select(columns)).isEmpty()


def test_kruskal_keeps_its_digits_in_a_large_cell(spark):
    """Seasons differ by a few ranks in 3e6 rows of two values; the plain formula cancels here."""
    blocks = spark.createDataFrame(
        [("h", "a", s, float(v), 750_000 + (5 if (s, v) == ("spring", 1) else 0)) for s in ("spring", "winter") for v in (0, 1)],
        "hotel_id string, aspect string, season string, value double, t bigint")
    ranks = temporal._value_ranks(blocks, SEASON_ORDER, 5, True)
    # for two seasons and two values H is Pearson's statistic of the 2 x 2 table times (n - 1) / n
    a, b, c, d = 750_000, 750_005, 750_000, 750_000
    exact = (a + b + c + d - 1) * (a * d - b * c) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))
    assert temporal._seasonal(ranks, SEASON_ORDER, 5).first().kw_h == pytest.approx(exact, rel=1e-6)


def test_benjamini_hochberg_with_ties_and_nulls(spark):
    rng = random.Random(2)
    ps = [rng.choice([0.01, 0.2, 1.0, rng.random()]) for _ in range(120)] + [None] * 5
    rows = [(f"h{i}", "a", p) for i, p in enumerate(ps)]
    tests = materialise(spark.createDataFrame(rows, "hotel_id string, aspect string, p double"))
    found = {r.hotel_id: r.adj for r in temporal.adjust_for_many_tests(tests, "p", "adj").collect()}
    real = sorted((p, f"h{i}") for i, p in enumerate(ps) if p is not None)
    expected, low = {}, 1.0
    for rank in range(len(real), 0, -1):
        low = min(low, real[rank - 1][0] * len(real) / rank)
        expected[real[rank - 1][1]] = low
    assert found.keys() == {r[0] for r in rows}
    for h, value in found.items():
        assert value == (None if h not in expected else pytest.approx(expected[h]))


def test_tiers_are_strict(spark):
    frame = spark.createDataFrame([(None,), (0.0099,), (0.01,), (0.05,), (0.10,)], "p double")
    assert [r[0] for r in frame.select(confidence_tier(F.col("p"))).collect()] == [
        "none", "strong", "moderate", "weak", "negligible"]


def test_caveat_texts(spark):
    rows = [("safety", "strong", "weak", "improving"), ("overall", "strong", "moderate", "declining"),
            ("safety", "none", "negligible", None)]
    frame = spark.createDataFrame(rows, "aspect string, seasonal_tier string, trend_tier string, trend_dir string"
                                  ).withColumns({"best_season": F.lit("spring"), "worst_season": F.lit("winter")})
    out = frame.select(temporal.seasonal_caveat().alias("s"), temporal.trend_caveat().alias("t")).collect()
    assert out[0].s == "Safety varies by season — strongest in spring, weakest in winter (strong confidence)."
    assert out[0].t == "Safety has been improving over time (weak confidence)."
    assert out[1].s is None and out[1].t == "Overall rating has been declining over time (moderate confidence)."
    assert out[2].s is None and out[2].t is None


def test_seasons_are_an_argument(spark):
    rows = [("h", "a", i % 3, d, i) for d in ("x", "y") for i in range(6)]
    assert one(spark, rows, seasons=("x", "y"), settings=replace(DEFAULTS, min_per_season=6)).n_seasons == 2
