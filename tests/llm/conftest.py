from __future__ import annotations

import pytest


@pytest.fixture
def rows(spark):
    """A table of documents from plain tuples; extra columns have names the operators use inside."""

    def make(*texts, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        data = [(i, t, "x", "y", 1) for i, t in zip(ids, texts)]
        return spark.createDataFrame(data, "doc_id long, text string, row string, doc string, fingerprint int")

    return make


@pytest.fixture
def small_batches(spark):
    """Many small Arrow batches, so that runs cross them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "5")
    yield
    spark.conf.set(name, before)
