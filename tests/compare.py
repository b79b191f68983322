"""Run a registered query and its SQL check and compare columns, types and values exactly."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

KINDS = {
    "bigint": {"BIGINT"},
    "int": {"INTEGER"},
    "double": {"DOUBLE"},
    "string": {"VARCHAR"},
    "timestamp_ntz": {"TIMESTAMP"},
    "date": {"DATE"},
    "boolean": {"BOOLEAN"},
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, Decimal):
        return f"decimal {value}"
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(df, con, sql: str) -> list[str]:
    """Differences as text; none when both agree."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    theirs = result.fetchall()
    ours = df.collect()
    found = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} / {sorted(names)}"]
    for name, kind in df.dtypes:
        if kinds[name] not in KINDS.get(kind, {kind}):
            found.append(f"type of {name}: {kind} / {kinds[name]}")
    if len(ours) != len(theirs):
        found.append(f"rows {len(ours)} / {len(theirs)}")
    if not ours:
        found.append("no rows")
    a, b = _rows(df.columns, ours), _rows(names, theirs)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        found.append(f"{len(wrong)} different rows of columns {sorted(names)}, first {wrong[0][0]} / {wrong[0][1]}")
    return found
