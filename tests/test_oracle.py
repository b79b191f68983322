"""Every registered query runs; those with a SQL check agree with it exactly."""

from __future__ import annotations

import pytest
from compare import compare, connect

from headroom.plans import catalog

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, sf_dir, con, name):
    assert compare(QUERIES[name](spark, sf_dir), con, ORACLE[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir).cache()
    assert df.count() > 0
    for column in ("predicted", "score", "smape"):
        if column in df.columns and "state" not in df.columns:
            assert df.where(f"isnan({column}) OR {column} < 0 OR {column} IS NULL").isEmpty()
    if {"actual", "predicted"} <= set(df.columns):  # not one number for all, and of the size of the data
        sums = df.selectExpr("avg(actual) AS actual", "avg(predicted) AS predicted", "count(DISTINCT predicted) AS n").first()
        assert sums["n"] > 1 and sums["actual"] / 3 < sums["predicted"] < 3 * sums["actual"]
    if "values" in df.columns:
        assert df.where("exists(values, v -> v IS NULL OR isnan(v) OR abs(v) > 1e6)").isEmpty()
    df.unpersist()


def test_every_check_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)
