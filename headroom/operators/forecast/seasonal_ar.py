"""Seasonal autoregression with regressors, fitted by regressions in three stages.

After differencing, (1) the target is regressed on the regressors, (2) what is left is
regressed on a long run of its own lags to estimate the shocks, (3) and then on its own
lags and the shocks at the lags of the order (Hannan and Rissanen, 1982). Every stage is
a regression on sums of products, so no stage needs a series in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headroom import fixed_values as fixed
from headroom.operators import features, ordering
from headroom.operators.features import SeasonalOrder
from headroom.operators.forecast import gram
from headroom.operators.forecast.recursion import ROWS_PER_ROUND, forecast_together
from headroom.session import settle


def _least_squares(name: str):
    def fit(matrix: np.ndarray, row: pd.Series) -> dict[str, list[float]]:
        return {name: gram.ridge(matrix, 1e-8).tolist()}

    return fit


def _split_fit(own_lags: int):
    def fit(matrix: np.ndarray, row: pd.Series) -> dict[str, list[float]]:
        found = gram.ridge(matrix, 1e-8)
        return {"ar": found[:own_lags].tolist(), "ma": found[own_lags:].tolist()}

    return fit


def _regress(rows: DataFrame, design: Sequence[Column], target: Column, solver, names, series) -> DataFrame:
    """One row per series with coefficient arrays; empty designs give empty arrays."""
    if not design:
        return rows.select(*series).distinct().withColumns({n: F.array().cast("array<double>") for n in names})
    sums = gram.products(rows, design, target, series=series, spread="rn")
    return gram.solve(sums, solver, names, keep=series)


def _dot(columns: Sequence[Column], coefficients: str) -> Column:
    return gram.dot(columns, coefficients) if columns else F.lit(0.0)


def _lag_columns(column: str, lags: Sequence[int], w) -> dict[str, Column]:
    return {f"{column}_{k}": F.lag(column, k).over(w) for k in lags}


def fit_seasonal_ar(
    df: DataFrame,
    order: SeasonalOrder = SeasonalOrder(),
    *,
    series: Sequence[str],
    regressors: Sequence[str] = tuple(fixed.MODEL_FEATURES),
    target: str = "y",
    order_by: str = "ds",
    fold: str = "fold",
    step: int | None = None,
    rows: int = ordering.ROWS_PER_TASK,
) -> tuple[DataFrame, DataFrame]:
    """Models, one row per series (``regression``, ``ar``, ``ma``), and the rows to forecast from.

    Rows labelled ``train`` are known. The second table has, per row, the target, what the
    regressors leave of its differences and the shock where known, and the part of the
    difference the regressors explain.
    """
    series, regressors = list(series), list(regressors)
    wide = df.select(
        *series, order_by, fold, F.col(target).cast("double").alias("_y"), *[F.col(c).cast("double").alias(c) for c in regressors]
    )
    placed = ordering.with_position(wide, series=series, order=order_by, step=step, rows=rows)
    diffed = features.with_differences(placed, ["_y", *regressors], order, series=series, rows=rows)
    changes = [F.col(f"{c}_diff") for c in regressors]
    base = settle(
        diffed.select(
            *series, order_by, "rn", F.col(fold).alias("fold"), "_y", F.col("_y_diff").alias("_w"), *[c for c in changes]
        )
    )
    reach = max(order.difference)
    known = (F.col("fold") == "train") & (F.col("rn") > reach)
    first = settle(
        _regress(
            base.where(known).select(*series, "rn", "_w", *changes), changes, F.col("_w"), _least_squares("regression"), ["regression"], series
        )
    )
    explained = base.join(first, series).withColumn("_x", F.coalesce(_dot(changes, "regression"), F.lit(0.0)))
    left = explained.select(*series, order_by, "rn", "fold", "_y", "_x", F.when(known, F.col("_w") - F.col("_x")).alias("_u"))

    long = list(range(1, max([*order.ar_lags, *order.ma_lags, 1]) + 2))
    shifted = settle(
        ordering.in_chunks(left, lambda w: _lag_columns("_u", long, w), series=series, before=max(long), rows=rows)
    )
    own = [F.col(f"_u_{k}") for k in long]
    full = known & (F.col("rn") > reach + max(long))
    second = settle(
        _regress(
            shifted.where(full).select(*series, "rn", "_u", *own), own, F.col("_u"), _least_squares("_long"), ["_long"], series
        )
    )
    shocked = shifted.join(second, series).withColumn("_e", F.when(full, F.col("_u") - _dot(own, "_long")))
    ready = settle(shocked.select(*series, order_by, "rn", "fold", "_y", "_u", "_e", "_x"))

    # Third stage: own lags and shocks at the lags of the order.
    ar, ma = order.ar_lags, order.ma_lags
    lagged = ordering.in_chunks(
        ready,
        lambda w: {**_lag_columns("_u", ar, w), **_lag_columns("_e", ma, w)},
        series=series,
        before=max([*ar, *ma, 1]),
        rows=rows,
    )
    usable = known & (F.col("rn") > reach + max(long) + max([*ar, *ma, 0]))
    design = [F.col(f"_u_{k}") for k in ar] + [F.col(f"_e_{k}") for k in ma]
    third = _regress(
        lagged.where(usable).select(*series, "rn", "_u", *design), design, F.col("_u"), _split_fit(len(ar)), ["ar", "ma"], series
    )
    return settle(first.join(third, series)), ready


def _advancer(order: SeasonalOrder):
    """All series of a group one row further: products of the last values, differences and shocks with their coefficients."""
    past = {k: v for k, v in order.difference.items() if k}
    ar, ma = order.ar_lags, order.ma_lags
    length = max([*past, *ar, *ma, 1])

    def of(models: pd.DataFrame):
        own, shocks = (np.array([np.asarray(row, dtype=float) for row in models[c]]).reshape(len(models), -1) for c in ("ar", "ma"))

        def advance(history: np.ndarray, row: np.ndarray) -> np.ndarray:
            rest = np.zeros(len(row))
            for i, k in enumerate(ar):
                rest += own[:, i] * history[:, -k, 1]
            for i, k in enumerate(ma):
                rest += shocks[:, i] * history[:, -k, 2]
            value = rest + row[:, 3]
            for k, v in past.items():
                value = value - v * history[:, -k, 0]
            return np.stack([value, rest], axis=1)

        return length, advance

    return length, of


def forecast_seasonal_ar(
    models: DataFrame,
    ready: DataFrame,
    order: SeasonalOrder = SeasonalOrder(),
    *,
    series: Sequence[str],
    order_by: str = "ds",
    floor: bool = True,
    rows_per_round: int = ROWS_PER_ROUND,
) -> DataFrame:
    """Forecast of all rows after the training rows: future shocks are 0, regressors are known."""
    series = list(series)
    starts = settle(ready.groupBy(*series).agg(F.count_if(F.col("fold") == "train").alias("start")))
    rows = ready.join(starts, series).select(
        *series, order_by, "rn", "start", "_y", F.coalesce("_u", F.lit(0.0)).alias("_u"), F.coalesce("_e", F.lit(0.0)).alias("_e"), "_x"
    )
    length, advancer = _advancer(order)
    out = forecast_together(
        rows,
        models,
        advancer,
        series=series,
        columns=["_y", "_u", "_e", "_x"],
        length=length,
        feedback=2,
        order=order_by,
        rows_per_round=rows_per_round,
    )
    value = F.greatest("_y", F.lit(0.0)) if floor else F.col("_y")
    return out.select(*series, order_by, value.alias("predicted"))
