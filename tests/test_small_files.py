"""Stored tables whose files are small and whose rows are not: nothing of them is sent to all tasks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from guestsignal.operators import contracts, scale

RICH = """profile_id string, archetype string, profile_summary string, desired_dims array<string>, recommendations
array<struct<rank:int,hotel_id:string,hotel_name:string,hotel_category:string,score:double,justification:string,
supporting_evidence:array<struct<review_id:string,quote:string,aspect:string,date:string,verified:boolean,sentiment:double>>>>"""


@pytest.fixture
def planned(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_contract_meets_the_profiles_by_ids_in_a_sorted_join(spark, planned):
    pick = (1, "h", "Inn", "3-star", 4.0, "x" * 801, [("r", "q", "a", "2025-01-01", True, 0.5)])
    rows = [(p, "solo", "s", ["a"], [pick]) for p in ("p", "p", "q")]
    rich = scale.materialise(spark.createDataFrame(rows, RICH), "rich")
    everyone = spark.createDataFrame([("p",), ("q",), ("s",), ("s",), (None,)], "profile_id string")
    broken = contracts.contract_violations(rich, scale.materialise(everyone, "people"))
    plan = planned(broken)
    assert "Broadcast" not in plan and "SortMergeJoin" in plan and "quote" not in plan
    assert sorted(map(tuple, broken.collect()), key=str) == sorted(
        [(p, "justification length") for p in ("p", "p", "q")]
        + [(p, "no recommendation") for p in ("s", "s", None)], key=str)


def test_big_side_is_not_sent_to_all_tasks_if_rows_without_match_are_dropped(spark, planned):
    big = scale.materialise(spark.range(300).select(
        F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 > 0, "hot").alias("key")), "big")
    side = scale.materialise(spark.createDataFrame([("hot", 1)], "key string, n int"), "side")
    kept = scale.skew_safe_left_join(big, side, "key", "id", 0.5).filter("n is not null")
    plan = planned(kept)
    assert "SortMergeJoin" in plan and "Inner, BuildLeft" not in plan
    assert sorted(int(r.id) for r in kept.collect()) == [i for i in range(300) if i % 3]
