"""The joins that make reviews of line items, and what scores of types store."""

from __future__ import annotations

import pytest

from guestsignal.operators import scale
from guestsignal.plans import catalog_orders as orders
from guestsignal.sources import driver_views as v


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    put(
        "lineitem",
        [
            (k % 7 if k % 11 else None, k % 5, k % 4 if k % 13 else None, k, float(k % 50), 0.01 * (k % 11), "ANR"[k % 3], "FO"[k % 2], "1995-01-%02d" % (1 + k % 28))
            for k in range(200)
        ],
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_discount double, l_returnflag string, l_linestatus string, l_shipdate string",
    )
    put("orders", [(k, "1-URGENT" if k and k % 2 else "4-NOT SPECIFIED") for k in [0, 1, 2, 3, 4, 4, None]], "o_orderkey bigint, o_orderpriority string")
    put("supplier", [(0, "S0", 1), (1, "S1", 2), (1, "S1", 2), (2, None, 1), (None, "S", 1)], "s_suppkey bigint, s_name string, s_nationkey int")
    put("nation", [(1, "ONE"), (2, "TWO")], "n_nationkey int, n_name string")
    return str(folder)


def rows_of(df):
    return sorted(map(str, df.collect()))


def joins_of(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Join" in line and "l_suppkey" in line]


def test_suppliers_are_sent_whatever_spark_expects(spark, tables, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sent = v.order_reviews(spark, tables)
        assert ["BroadcastHashJoin" in line for line in joins_of(sent)] == [True]
        monkeypatch.setattr(v, "SENT_BYTES", 0)
        shuffled = v.order_reviews(spark, tables)
        assert ["BroadcastHashJoin" in line for line in joins_of(shuffled)] == [False]
        assert rows_of(sent) == rows_of(shuffled) != []
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_masses_are_not_stored_for_scores_of_types(spark, tables, monkeypatch):
    kept = {}

    def keep(df, name="table"):
        kept[name] = df.columns
        return scale.materialise(df, name)

    monkeypatch.setattr(orders, "materialise", keep)
    assert orders.conditioned(spark, tables).count()
    assert kept["sums"] == ["hotel_id", "aspect", "traveler_type", "n", "wsum", "wpol"]


def test_no_supplier(spark, tables, monkeypatch):
    table = v.table
    monkeypatch.setattr(v, "table", lambda s, d, name: table(s, d, name).limit(0) if name == "supplier" else table(s, d, name))
    assert v.order_reviews(spark, tables).count() == 0
