"""The registered queries, by topic, each with its SQL check where SQL can say the same."""

from __future__ import annotations

from headroom.plans.catalog import (
    calendar,
    decisions,
    evaluation,
    features,
    forecasting,
    reports,
    selection,
    tables,
)

TOPICS = [tables, calendar, features, evaluation, decisions, selection, reports, forecasting]


def _merged(tables):
    names = [name for table in tables for name in table]
    twice = sorted({name for name in names if names.count(name) > 1})
    if twice:
        raise ValueError(f"registered twice: {twice}")
    return {name: entry for table in tables for name, entry in table.items()}


def queries():
    return _merged([topic.QUERIES for topic in TOPICS])


def oracle_sql():
    return _merged([topic.ORACLE for topic in TOPICS])
