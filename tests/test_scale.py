from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from guestsignal.operators import scale


def test_skew_safe_join_equals_a_plain_left_join(spark):
    rng = random.Random(1)
    rows = [(f"r{i}", "hot" if rng.random() < 0.4 else f"k{rng.randint(0, 30)}") for i in range(2000)]
    rows.append(("r-null", None))
    big = spark.createDataFrame(rows, "id string, key string")
    side = spark.createDataFrame([("hot", 1, "x"), *[(f"k{i}", i, None) for i in range(0, 30, 2)]],
                                 "key string, n int, note string")
    expected = big.join(side, "key", "left").select("id", "key", "n", "note")
    for share in (0.1, 1.0):  # with and without a hot key
        found = scale.skew_safe_left_join(big, side, "key", "id", share)
        assert sorted(found.collect(), key=str) == sorted(expected.collect(), key=str)


def test_skew_safe_join_on_two_columns_with_a_key_in_every_row_and_long_matches(spark):
    """One pair of keys holds nearly all rows and its match is long: rows go to several tasks and
    nothing but hashes is broadcast."""
    rows = [(f"r{i}", "hot" if i % 10 else f"k{i % 7}", "x" if i % 3 else "y") for i in range(4000)]
    rows += [("n1", None, "x"), ("n2", "hot", None)]
    big = spark.createDataFrame(rows, "id string, k1 string, k2 string")
    pairs = [(a, b) for a in ("hot", "k0", "k3") for b in "xy"]
    side = spark.createDataFrame([(a, b, f"{a}{b}" * 20_000) for a, b in pairs], "k1 string, k2 string, text string")
    joined = scale.skew_safe_left_join(big, side, ["k1", "k2"], "id", 0.02)
    got = sorted((r.id, r.k1, r.k2, r.size) for r in joined.select("id", "k1", "k2", F.length("text").alias("size")).collect())
    assert got == sorted((i, a, b, len(f"{a}{b}") * 20_000 if (a, b) in pairs else None) for i, a, b in rows)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = scale.skew_safe_left_join(big, side, ["k1", "k2"], "id", 0.02)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        per_task = joined.groupBy(F.spark_partition_id()).agg(F.count_if(F.col("k1") == "hot").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(r.n > 0 for r in per_task) >= 6 and max(r.n for r in per_task) < 0.5 * len(rows)
    assert "SortMergeJoin" in plan


def test_hot_keys_and_their_pieces_are_bounded_by_the_share(spark):
    big = spark.createDataFrame([("hot",)] * 60 + [(f"k{i}",) for i in range(40)], "key string")
    want = spark.createDataFrame([("hot",)], "key string").select(F.xxhash64("key")).first()[0]
    assert [tuple(r) for r in scale.hot_keys(big, "key", 0.05).collect()] == [(want, 8)]
    assert [tuple(r) for r in scale.hot_keys(big, "key", 0.1).collect()] == [(want, 6)]


def test_value_ranges_follow_the_order_and_split_only_large_groups(spark):
    rng = random.Random(4)
    rows = {("big", round(1000 + 20 * rng.random(), 6)) for _ in range(20_000)}
    rows |= {("big", -5.0), ("big", 1e300)} | {(f"small{i % 50}", float(i)) for i in range(2000)}
    table = spark.createDataFrame(list(rows), "g string, v double").repartition(4)
    found = scale.value_ranges(table, ["g"], "v", range_rows=1000).collect()
    assert {(r.g, r.v) for r in found} == rows and len(found) == len(rows)
    big = sorted((r.v, r._range) for r in found if r.g == "big")
    assert [r for _, r in big] == sorted(r for _, r in big)
    sizes = Counter(r for _, r in big)
    assert 15 <= len(sizes) <= 21 and max(sizes.values()) < 3000
    assert all(r._range == 0 for r in found if r.g != "big")
    again = scale.value_ranges(table.repartition(7), ["g"], "v", range_rows=1000).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert scale.value_ranges(table.limit(0), ["g"], "v").count() == 0


def test_value_ranges_share_bounds_the_ranges(spark):
    table = spark.range(5000).select((F.col("id") % 2).alias("g"), "id")
    found = scale.value_ranges(table, ["g"], "id", share=0.1, range_rows=1)
    assert found.select("g", "_range").distinct().count() <= 20


def test_global_row_number_over_heavy_ties(spark):
    rows = [(i, 1 if i % 3 else i % 7) for i in range(500)]
    table = spark.createDataFrame(rows, "id int, v int").repartition(8)
    numbered = scale.global_row_number(table, [F.col("v").desc(), F.col("id").asc()], "place")
    expected = [i for i, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]
    assert [r.id for r in numbered.orderBy("place").collect()] == expected
    assert {r.place for r in numbered.collect()} == set(range(1, 501))


def test_global_step_up_over_ties_reads_no_frame_to_the_end_for_each_row(spark):
    rng = random.Random(5)
    rows = [(f"h{i % 900}", "a", rng.choice([0.0, 0.01, 0.5, 1.0, rng.random() ** 3])) for i in range(1800)]
    rows += rows[:40] + [(None, "b", 0.02), ("h1", None, 0.5)]
    table = scale.materialise(spark.createDataFrame(rows, "hotel_id string, aspect string, p double").repartition(6))
    adjusted = scale.global_step_up(table, "p", ["hotel_id", "aspect"], "adj")
    plan = adjusted._jdf.queryExecution().executedPlan().toString()
    # Spark reads such a frame anew for each row: the square of a range's rows
    assert "Window" in plan and "unboundedfollowing" not in plan.lower()
    expected, least = {}, 1.0
    for rank, p in reversed(list(enumerate(sorted(r[2] for r in rows), 1))):
        least = min(least, p * len(rows) / rank)
        expected[p] = min(least, expected.get(p, 1.0))
    found = adjusted.collect()
    assert sorted(((r.hotel_id, r.aspect, r.p) for r in found), key=str) == sorted(rows, key=str)
    assert all(abs(r.adj - expected[r.p]) < 1e-12 for r in found)
