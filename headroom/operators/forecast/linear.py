"""Linear one-step models for the recursive forecast."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headroom.operators import ordering
from headroom.session import settle

ROWS_PER_ROUND = 2_000  # results of a round are copied with each step


def linear_stepper(weights: Mapping[tuple[int, int], float], constant: float = 0.0):
    """Next value = constant + sum of ``weights[(lag, column)]`` times the column that many rows before."""
    weights, length = dict(weights), max(lag for lag, _ in weights)

    def step_of(model: pd.Series):
        def step(past: np.ndarray, own: np.ndarray):
            return [constant + sum(w * past[-lag, column] for (lag, column), w in weights.items())]

        return length, step

    return step_of


def forecast_linear(
    rows: DataFrame,
    weights: Mapping[tuple[int, int], float],
    constant: float = 0.0,
    *,
    series: Sequence[str],
    columns: Sequence[str],
    order: str = "ds",
    rows_per_round: int = ROWS_PER_ROUND,
) -> DataFrame:
    """The recursive forecast of the model ``linear_stepper`` describes, in built-in functions.

    What known columns contribute is added up beforehand for all rows; only the fed-back column runs through an
    aggregation over the rows of a round. A round holds at most ``rows_per_round`` rows of a series, and
    hands on its last values.
    """
    series, fed, length = list(series), columns[0], max(lag for lag, _ in weights)
    known = {(lag, c): w for (lag, c), w in weights.items() if c > 0}
    lags = {f"_x{i}": (columns[c], lag) for i, (lag, c) in enumerate(known)}
    lagged = ordering.with_lags(rows, lags, series=series) if lags else rows
    outside = F.lit(float(constant))
    for name, weight in zip(lags, known.values()):
        outside = outside + F.lit(float(weight)) * F.col(name)
    short = F.raise_error(F.concat(F.lit("a forecast from row "), F.col("start"), F.lit(f" needs {length} rows before it")))
    start = F.when(F.col("start") < length, short.cast("bigint")).otherwise(F.col("start"))
    flat = lagged.select(*series, order, F.col("rn").cast("bigint"), start.alias("start"), F.col(fed).cast("double").alias("_y"), outside.alias("_x"))
    flat = settle(flat.where(F.col("rn") > F.col("start") - length))
    rounds = -(-(flat.agg(F.max(F.col("rn") - F.col("start"))).first()[0] or 0) // rows_per_round)

    def by_place(*fields: str) -> Column:
        return F.sort_array(F.collect_list(F.struct("rn", *fields)))

    def step(so_far: Column, row: Column) -> Column:
        value = row["_x"]
        for (lag, c), weight in weights.items():
            if c == 0:
                value = value + F.lit(float(weight)) * F.element_at(so_far["h"], -lag)
        one = F.array(value)
        return F.struct(F.concat(F.slice(so_far["h"], 2, length - 1), one).alias("h"), F.concat(so_far["out"], one).alias("out"))

    past = flat.where("rn <= start").groupBy(*series).agg(F.transform(by_place("_y"), lambda r: r["_y"]).alias("h"))
    results = [flat.limit(0).select(*series, order, "rn", F.col("_y").alias(fed))]
    for number in range(rounds):
        begin = F.col("start") + number * rows_per_round
        part = flat.where((F.col("rn") > begin) & (F.col("rn") <= begin + rows_per_round))
        met = part.groupBy(*series).agg(by_place(order, "_x").alias("_rows")).join(past, series)
        empty = F.struct(F.col("h"), F.array().cast("array<double>").alias("out"))
        done = settle(met.select(*series, "_rows", F.aggregate("_rows", empty, step).alias("_done")))
        past = done.select(*series, F.col("_done.h").alias("h"))
        pairs = F.explode(F.arrays_zip(F.col("_rows").alias("r"), F.col("_done.out").alias("v")))
        results.append(done.select(*series, pairs.alias("p")).select(*series, f"p.r.{order}", "p.r.rn", F.col("p.v").alias(fed)))
    return reduce(DataFrame.unionByName, results)
