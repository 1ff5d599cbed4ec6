"""Every named query against its SQL on the smallest given tables, and the shape of the plans."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from guestsignal.plans import catalog

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="given tables are absent")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"create view {name} as select * from '{path}'")
    return connection


def plain(rows, columns):
    cell = lambda v: "" if v is None else repr(v + 0.0) if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    result = entry.queries()[name](spark, SF_DIR)
    columns = sorted(result.columns)
    relation = duck.sql(entry.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    theirs = [dict(zip(relation.columns, r)) for r in relation.fetchall()]
    assert plain(result.collect(), columns) == plain(theirs, columns)


# Products of two tables, and Python called row by row.
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


@pytest.mark.parametrize("name", ["eb_shrink", "conditioned_scores", "kruskal_wallis", "spearman_trend",
                                  "contradictions", "label_join", "aspect_instances", "best_quotes",
                                  "semantic_search", "descriptor_sim", "recency_weight", "hotel_summary"])
def test_plans_have_no_products_and_no_row_udf(spark, name):
    plan = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in FORBIDDEN if word in plan]


def test_dedupe_is_limited_before_the_shuffle(spark):
    plan = entry.queries()["dedupe_reviews"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1, Partial" in plan


def test_reports_read_the_given_tables_once(spark, monkeypatch):
    """One plan scans the line items, once, to store the instances; reports read those, and one for a
    single hotel pushes its filter into the scan."""
    from guestsignal.operators import scale
    from guestsignal.plans import catalog_orders, catalog_profiles

    stored, write = [], scale.materialise
    text = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def noted(df, name="table"):
        stored.append(text(df))
        return write(df, name)

    for module in ("scale", "temporal", "scoring", "ranking"):
        monkeypatch.setattr(f"guestsignal.operators.{module}.materialise", noted)
    for module in (catalog_orders, catalog_profiles):
        monkeypatch.setattr(module, "materialise", noted)
    for name in ("hotel_timeline", "top_movers", "raw_signals", "rank_hotels"):
        stored.clear()
        plan = text(entry.queries()[name](spark, SF_DIR))
        assert sum(p.count("lineitem.parquet") for p in [*stored, plan]) == 1, name
        if name == "hotel_timeline":
            assert plan.count("EqualTo(hotel_id,7)") >= 2 and "EqualTo(hotel_id" in plan.split("PushedFilters")[1]


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
