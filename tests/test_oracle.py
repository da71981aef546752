"""Every registered query against its DuckDB oracle at sf 0.01 (the driver's gate)."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from wardflow.checks.compare import compare, duckdb_connection

QUERIES = entry.queries()
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf001):
    c = duckdb_connection(sf001)
    yield c
    c.close()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, sf001, con, name):
    out = compare(name, QUERIES[name](spark, sf001), con, ORACLE[name])
    assert out.ok, out.detail


def test_every_query_has_a_callable_and_names_match():
    assert set(ORACLE) <= set(QUERIES)
    # the only query without SQL is the nested treemap (its flat form has one)
    from wardflow import catalog

    assert set(catalog.queries()) - set(ORACLE) == {"visits_treemap"}


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() == 25
    assert df.columns[:2] == ["hospital_id", "hospital_name"]


def test_treemap_nests_flat_rows(spark, sf001):
    from wardflow.plans import overview
    from wardflow.sources.star import DriverStar

    star = DriverStar(spark, sf001)
    tree = {r["name"]: [(c["name"], c["value"]) for c in r["children"]]
            for r in overview.visits_treemap(star).collect()}
    flat = overview.visits_by_department(star).collect()
    assert sum(len(v) for v in tree.values()) == len(flat)
    for kids in tree.values():
        values = [v for _, v in kids]
        assert values == sorted(values, reverse=True)
