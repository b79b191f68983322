"""Small fixed tables as expressions: no join, no shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def by_name(key: Column, values: Mapping[str, float | int], what: str) -> Column:
    """Value per name; an unknown name is an error."""
    table = F.create_map(*[F.lit(part) for pair in values.items() for part in pair])
    unknown = F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(key, F.lit("null"))))
    return F.coalesce(F.try_element_at(table, key), unknown.cast("double"))


def record_by_name(key: Column, tables: Mapping[str, Mapping[str, float]], what: str) -> Column:
    """All values of a name as one struct, from tables with the same names; an unknown name is an error.

    One lookup and one check per row, however many values are used.
    """
    names = list(next(iter(tables.values())))
    entries = [
        part
        for name in names
        for part in (F.lit(name), F.struct(*[F.lit(float(values[name])).alias(field) for field, values in tables.items()]))
    ]
    unknown = F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(key, F.lit("null"))))
    fields = ", ".join(f"{field}: double" for field in tables)
    return F.coalesce(F.try_element_at(F.create_map(*entries), key), unknown.cast(f"struct<{fields}>"))


def by_index(index: Column, values: Sequence[float], first: int = 0) -> Column:
    """Value per whole number, ``first`` being the number of the first value."""
    return F.get(F.array(*[F.lit(v) for v in values]), index - first)


def by_band(value: Column, bands: Sequence[tuple[int, int, float]], default: float) -> Column:
    """Weight of the first half-open band ``[from, before)`` that holds ``value``."""
    chain = F
    for low, high, weight in bands:
        chain = chain.when((value >= low) & (value < high), F.lit(weight))
    return chain.otherwise(F.lit(default))
