"""Plan regressions: each registered query reads each fact once, with a
pruned schema, and the fan-out reports never join fact rows to fact rows."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from wardflow.checks.plans import final_plan, plan_facts

QUERIES = entry.queries()
#: These need the calendar, so they read the bounds of the dates besides.
DATED = {"severity_weekday_wait", "severity_weekday_wait_hospital", "severity_weekday_grid", "audit_references", "audit_keys",
         "audit_row_counts", "audit_dimension_bounds"}
LINEITEM_ALL = {"l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"}


@pytest.fixture(scope="module")
def facts(spark, sf0001):
    return {name: plan_facts(final_plan(fn(spark, sf0001))) for name, fn in QUERIES.items()}


def test_visits_fact_scanned_at_most_once(facts):
    over = {n: f.scans.get("lineitem", 0) for n, f in facts.items() if f.scans.get("lineitem", 0) > 1 + (n in DATED)}
    assert over == {}


def test_orders_scanned_at_most_once_per_fact_role(facts):
    # orders feeds the shifts and the financial rows (and severity of visits)
    over = {n: f.scans.get("orders", 0) for n, f in facts.items() if f.scans.get("orders", 0) > 3 + (n in DATED)}
    assert over == {}


def test_scans_are_pruned(facts):
    for name, f in facts.items():
        cols = f.read_columns.get("lineitem")
        if cols:
            assert cols < LINEITEM_ALL, name
    assert facts["hourly_arrivals"].read_columns["lineitem"] == {
        "l_orderkey", "l_suppkey", "l_linenumber", "l_shipdate"}


@pytest.mark.parametrize("name", ["radar_profiles", "regional_choropleth", "sector_gap"])
def test_fanout_reports_join_partial_aggregates(spark, sf0001, name):
    plan = final_plan(QUERIES[name](spark, sf0001))
    joins = [line for line in plan.splitlines() if "HashJoin" in line or "SortMergeJoin" in line]
    month_joins = [j for j in joins if "__month" in j]
    # shifts (and financial rows) meet visits on the (hospital, month) keys of
    # the partial aggregates, never on raw fact rows
    assert month_joins and all("LeftOuter" in j for j in month_joins)
    assert plan_facts(plan).scans.get("lineitem") == 1
