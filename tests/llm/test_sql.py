"""Corpus queries that SQL can express agree with it exactly."""

from __future__ import annotations

import pytest
from compare import compare, connect

from headroom.llm import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_agrees_with_sql(spark, sf_dir, name):
    assert compare(catalog.queries()[name](spark, sf_dir), connect(sf_dir), catalog.oracle_sql()[name]) == []
