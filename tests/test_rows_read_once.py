"""What several steps read is made once: value rows, tie blocks and order rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from guestsignal.operators import temporal
from guestsignal.plans import catalog_orders

DAY = dt.date(2025, 1, 1)


def reviews(spark):
    rows = [("h", a, p, r, s, d, g) for a in ("a", None) for p, r in ((0.5, 3), (None, 4), (0.25, None))
            for s, d in (("winter", DAY), (None, None)) for g in (True, False, None)]
    return spark.createDataFrame(rows, "hotel_id string, aspect string, polarity double, rating int, season string, "
                                       "review_date date, is_general boolean")


def test_values_of_the_same_rows_need_one_pass(spark):
    rows = reviews(spark)
    once, twice = temporal.values_in_one_pass(rows), temporal.test_values(rows, rows)
    assert once.schema.simpleString() == twice.schema.simpleString()
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert "Union" not in once._jdf.queryExecution().optimizedPlan().toString()


def test_both_tests_read_stored_tie_blocks(spark):
    rows = reviews(spark)
    plan = temporal.drift_tests(temporal.values_in_one_pass(rows), store_ties=True)._jdf.queryExecution().executedPlan().toString()
    assert "/ties-" in plan and "review_date" not in plan


def test_order_rows_are_stored_without_ids_and_calendar(spark, tmp_path):
    item = ("l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_returnflag string, l_discount double, "
            "l_quantity double, l_shipdate timestamp, l_linestatus string")
    tables = {
        "lineitem": ([(1, 1, 1, 7, "A", 0.05, 3.0, dt.datetime(2025, 1, 1), "F"), (1, 2, 1, 7, "N", 0.07, 4.0, None, "O")], item),
        "orders": ([(1, "2-HIGH")], "o_orderkey bigint, o_orderpriority string"),
        "supplier": ([(7, "S", 1)], "s_suppkey bigint, s_name string, s_nationkey int"),
        "nation": ([(1, "N")], "n_nationkey int, n_name string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    found = catalog_orders.order_rows(spark, str(tmp_path))
    assert sorted((r.aspect, r.season, r.year_month, r.is_general) for r in found.collect()) == [
        ("A", "winter", "2025-01", False), ("N", None, None, False)]
    kept = {name for f in found.inputFiles() for name in spark.read.parquet(f).columns}
    assert kept == {"hotel_id", "hotel_name", "hotel_category", "aspect", "polarity", "rating", "review_date",
                    "verified", "traveler_type"}
