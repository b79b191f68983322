"""Model features, chronological folds, scaling and windows."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headroom import fixed_values as fixed
from headroom import schemas
from headroom.functions.clock import order_value
from headroom.operators import ordering
from headroom.session import settle


# --- cyclic and recipe features -------------------------------------------------


def _outside(source: str, period: int, first: int) -> Column:
    value = F.col(source).try_cast("double")
    return F.coalesce(F.isnan(value) | (value < first) | (value >= first + period), F.lit(True))


def cyclic_violations(df: DataFrame, samples: int = 5) -> DataFrame:
    """Values no cyclic encoding exists for: per column their number and up to ``samples`` of them.

    Distinct values are counted before the shuffle and the window keeps only the first few.
    """
    schemas.require_columns(df, [source for source, _, _, _ in fixed.CYCLES], "cyclic feature frame")
    found = F.array_compact(
        F.array(
            *[
                F.when(
                    _outside(source, period, first),
                    F.struct(F.lit(source).alias("column"), F.col(source).cast("string").alias("value")),
                )
                for source, _, period, first in fixed.CYCLES
            ]
        )
    )
    values = (
        df.where(F.size(found) > 0)
        .select(F.explode(found).alias("_f"))
        .groupBy("_f.column", "_f.value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    totals = values.groupBy("column").agg(F.sum("rows").alias("invalid_rows"))
    few = values.withColumn("_k", F.row_number().over(Window.partitionBy("column").orderBy("value"))).where(
        F.col("_k") <= samples
    )
    picked = few.groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("samples"))
    return totals.join(picked, "column", "left")


def check_cyclic(df: DataFrame) -> DataFrame:
    """Raise with samples of the invalid values, or return the table unchanged."""
    bad = cyclic_violations(df).orderBy("column").collect()  # at most one row per encoded column
    if bad:
        ranges = {source: f"[{first}, {first + period})" for source, _, period, first in fixed.CYCLES}
        raise schemas.TableError(
            "; ".join(
                f"{row['column']} contains invalid cyclic values for range {ranges[row['column']]}: {row['samples']}"
                for row in bad
            )
        )
    return df


def add_cyclic_features(df: DataFrame) -> DataFrame:
    """Sine and cosine of hour, weekday and month; a value outside its cycle stops the job.

    A row with several such values names the first one in the order of the columns, whichever is computed first.
    """
    schemas.require_columns(df, [source for source, _, _, _ in fixed.CYCLES], "cyclic feature frame")
    problem = F.coalesce(
        *[
            F.when(
                _outside(source, period, first),
                F.concat(
                    F.lit(f"{source} contains invalid cyclic values for range [{first}, {first + period}): "),
                    F.coalesce(F.col(source).cast("string"), F.lit("null")),
                ),
            )
            for source, _, period, first in fixed.CYCLES
        ]
    )
    columns = {}
    for source, prefix, period, first in fixed.CYCLES:
        angle = F.lit(2 * math.pi) * (F.col(source).try_cast("double") - F.lit(float(first))) / F.lit(float(period))
        checked = F.when(problem.isNotNull(), F.raise_error(problem).cast("double")).otherwise(angle)
        columns[f"{prefix}_sin"] = F.sin(checked)
        columns[f"{prefix}_cos"] = F.cos(checked)
    return df.withColumns(columns)


def model_features(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The eight model features in their order, after the columns named in ``keep``."""
    schemas.require_columns(df, fixed.STATIC_FEATURES, "model feature frame")
    return add_cyclic_features(df).select(*keep, *fixed.MODEL_FEATURES)


def recipe_features(df: DataFrame) -> DataFrame:
    """Peak-hour, weekend and storm-in-season regressors and the hour cycle; checks hour and weekday."""
    schemas.require_columns(df, ["hour", "day_of_week", *fixed.STATIC_FEATURES], "recipe frame")

    def checked(name: str, last: int) -> Column:
        value = F.col(name).cast("double")
        good = F.coalesce((value >= 0) & (value <= last) & ~F.isnan(value), F.lit(False))
        stop = F.raise_error(F.lit(f"Column '{name}' has a value outside 0 to {last}, or none"))
        return F.when(good, value).otherwise(stop.cast("double"))

    hour, day = checked("hour", 23), checked("day_of_week", 6)
    angle = F.lit(2 * math.pi) * hour / F.lit(24.0)
    return df.withColumns(
        {
            "is_peak_hour": hour.isin([float(h) for h in fixed.PEAK_HOURS]).cast("int"),
            "is_weekend": day.isin([float(d) for d in fixed.WEEKEND_DAYS]).cast("int"),
            "monsoon_typhoon": F.col("is_monsoon") * F.col("typhoon_index"),
            "hour_sin": F.sin(angle),
            "hour_cos": F.cos(angle),
        }
    )


# --- folds ----------------------------------------------------------------------


def _checked_ratio(ratio: float, name: str) -> None:
    if not 0 < ratio < 1:
        raise ValueError(f"{name} must be between 0 and 1")


def _share(rows: Column, ratio: float) -> Column:
    """``int(rows * (1 - ratio))`` in double arithmetic."""
    return F.floor(rows.cast("double") * F.lit(1 - ratio)).cast("bigint")


def with_fold(
    df: DataFrame,
    *,
    series: Sequence[str],
    holdout_ratio: float = 0.2,
    validation_ratio: float | None = None,
    train_tail: int = 0,
    holdout_head: int = 0,
    order: str = "ds",
    step: int | None = None,
    rows: int = ordering.ROWS_PER_TASK,
    name: str = "fold",
) -> DataFrame:
    """Label each row ``train`` or ``holdout`` by time, per series; with ``validation_ratio``
    the tail of the training rows becomes ``validation``. ``train_tail`` keeps only that
    many rows before the holdout and ``holdout_head`` that many of the holdout; 0 keeps all.

    Only the cut timestamps are computed, one row per series, and every row is compared
    with them: the table itself is not shuffled or sorted. A series too short for a
    non-empty fold is an error.
    """
    _checked_ratio(holdout_ratio, "holdout_ratio")
    if validation_ratio is not None:
        _checked_ratio(validation_ratio, "validation_ratio")
    size = F.col("n")
    train_rows = _share(size, holdout_ratio)
    ranks = {"_holdout_at": F.when(train_rows >= 1, train_rows + 1)}
    if validation_ratio is not None:
        fit_rows = _share(train_rows, validation_ratio)
        ranks["_validation_at"] = F.when((fit_rows >= 1) & (fit_rows < train_rows), fit_rows + 1)
    if train_tail > 0:
        ranks["_from"] = F.greatest(train_rows - F.lit(train_tail) + 1, F.lit(1))
    if holdout_head > 0:
        ranks["_to"] = F.least(train_rows + F.lit(holdout_head), size)
    cuts = ordering.cut_values(df, ranks, series=series, order=order, step=step, rows=rows)
    empty = F.raise_error(F.lit("a fold would be left without rows")).cast("bigint")
    cuts = settle(cuts.select(*series, *[F.coalesce(F.col(cut), empty).alias(cut) for cut in ranks]))
    value = order_value(df, order)
    label = F.when(value >= F.col("_holdout_at"), "holdout")
    if validation_ratio is not None:
        label = label.when(value >= F.col("_validation_at"), "validation")
    labelled = df.join(cuts, list(series)).withColumn(name, label.otherwise("train"))
    if train_tail > 0:
        labelled = labelled.where(value >= F.col("_from"))
    if holdout_head > 0:
        labelled = labelled.where(value <= F.col("_to"))
    return labelled.drop(*ranks)


# --- scaling --------------------------------------------------------------------


def scaling_params(df: DataFrame, columns: Sequence[str], *, series: Sequence[str], fold: str | None = "fold") -> DataFrame:
    """Mean and population deviation of each column per series, over training rows; deviation 0 counts as 1."""
    rows = df if fold is None else df.where(F.col(fold) == "train")
    spread = {c: F.stddev_pop(c) for c in columns}
    return settle(
        rows.groupBy(*series).agg(
            F.array(*[F.avg(c) for c in columns]).alias("means"),
            F.array(*[F.when(s == 0, F.lit(1.0)).otherwise(s) for s in spread.values()]).alias("stds"),
        )
    )


def scale(df: DataFrame, params: DataFrame, columns: Sequence[str], *, series: Sequence[str]) -> DataFrame:
    """Standardise columns with stored parameters (one row per series)."""
    joined = df.join(params, list(series))
    return joined.withColumns(
        {c: (F.col(c) - F.col("means")[i]) / F.col("stds")[i] for i, c in enumerate(columns)}
    ).drop("means", "stds")


def unscale(df: DataFrame, params: DataFrame, column: str, index: int = 0, *, series: Sequence[str]) -> DataFrame:
    """Invert ``scale`` for one column, the ``index``-th of the parameters."""
    joined = df.join(params, list(series))
    return joined.withColumn(column, F.col(column) * F.col("stds")[index] + F.col("means")[index]).drop("means", "stds")


# --- windows and lags -----------------------------------------------------------


def sequences(
    df: DataFrame,
    columns: Sequence[str],
    length: int,
    *,
    series: Sequence[str],
    order: str = "ds",
    step: int | None = None,
    rows: int = ordering.ROWS_PER_TASK,
) -> DataFrame:
    """Per row with ``length`` predecessors: ``window`` (their columns, oldest first) and ``target``.

    The target is the first of ``columns`` in the row itself. A series with no window at
    all is an error.
    """
    if length <= 0:
        raise ValueError("sequence length must be greater than 0")
    placed = ordering.with_position(df.select(*series, order, *columns), series=series, order=order, step=step, rows=rows)
    enough = F.when(
        F.col("n") <= length, F.raise_error(F.lit("a series needs more rows than a sequence")).cast("bigint")
    ).otherwise(F.col("rn"))
    values = F.array(*[F.col(c).cast("double") for c in columns])
    built = ordering.in_chunks(
        placed.withColumn("rn", enough),
        lambda w: {"window": F.collect_list(values).over(w.rowsBetween(-length, -1))},
        series=series,
        before=length,
        rows=rows,
    )
    return built.where(F.col("rn") > length).select(
        *series, order, "rn", "window", F.col(columns[0]).cast("double").alias("target")
    )


def parse_order(text: str, parts: int = 3) -> tuple[int, ...]:
    """Read ``"1,1,1"``."""
    order = tuple(int(part.strip()) for part in text.split(","))
    if len(order) != parts or any(part < 0 for part in order):
        raise ValueError(f"order must be {parts} non-negative integers: {text}")
    return order


@dataclass(frozen=True)
class SeasonalOrder:
    """Orders of a seasonal autoregression with differences."""

    p: int = 1
    d: int = 1
    q: int = 1
    seasonal_p: int = 1
    seasonal_d: int = 0
    seasonal_q: int = 1
    period: int = 24

    @classmethod
    def parse(cls, order: str = "1,1,1", seasonal_order: str = "1,0,1,24") -> "SeasonalOrder":
        return cls(*parse_order(order), *parse_order(seasonal_order, 4))

    @staticmethod
    def _products(plain: int, seasonal: int, period: int) -> list[int]:
        """Lags of the product of a plain and a seasonal polynomial."""
        lags = {i + j * period for i in range(plain + 1) for j in range(seasonal + 1)}
        return sorted(lags - {0})

    @property
    def ar_lags(self) -> list[int]:
        return self._products(self.p, self.seasonal_p, self.period)

    @property
    def ma_lags(self) -> list[int]:
        return self._products(self.q, self.seasonal_q, self.period)

    @property
    def difference(self) -> dict[int, float]:
        """Coefficients by lag of the differencing polynomial, 1 at lag 0."""
        poly = {0: 1.0}
        for lag in [1] * self.d + [self.period] * self.seasonal_d:
            shifted = {k + lag: -v for k, v in poly.items()}
            poly = {k: poly.get(k, 0.0) + shifted.get(k, 0.0) for k in sorted({*poly, *shifted})}
        return {k: v for k, v in poly.items() if v}


def with_differences(
    df: DataFrame,
    columns: Sequence[str],
    order: SeasonalOrder,
    *,
    series: Sequence[str],
    suffix: str = "_diff",
    rows: int = ordering.ROWS_PER_TASK,
) -> DataFrame:
    """Add the differenced columns; needs ``rn``. The first rows, without a full past, are null."""
    poly = order.difference
    reach = max(poly)

    def differences(w):
        return {
            c + suffix: sum((F.lit(v) * F.lag(c, k).over(w) for k, v in poly.items() if k), F.col(c) * F.lit(poly[0]))
            for c in columns
        }

    return ordering.in_chunks(df, differences, series=series, before=reach, rows=rows)


def seasonal_lags(
    df: DataFrame,
    order: SeasonalOrder,
    *,
    series: Sequence[str],
    target: str = "y",
    order_by: str = "ds",
    step: int | None = None,
    rows: int = ordering.ROWS_PER_TASK,
) -> DataFrame:
    """The differenced target and its autoregressive lags; rows without a full past are dropped."""
    placed = ordering.with_position(df, series=series, order=order_by, step=step, rows=rows)
    poly, lags = order.difference, order.ar_lags
    reach = max(poly) + max(lags, default=0)

    def columns(w):
        def at(back: int) -> Column:
            return sum(
                (F.lit(v) * F.lag(target, k + back).over(w) for k, v in poly.items() if k + back),
                F.col(target) if not back else F.lit(0.0),
            )

        return {"w": at(0), **{f"w_lag{k}": at(k) for k in lags}}

    return ordering.in_chunks(placed, columns, series=series, before=reach, rows=rows).where(F.col("rn") > reach)


# --- target transforms ----------------------------------------------------------


@dataclass(frozen=True)
class TargetTransform:
    """A column transform and its inverse."""

    forward: Callable[[Column], Column]
    inverse: Callable[[Column], Column]


TRANSFORMS = {
    "identity": TargetTransform(lambda c: c, lambda c: c),
    "log1p": TargetTransform(F.log1p, F.expm1),
    "sqrt": TargetTransform(F.sqrt, lambda c: c * c),
}


def finite(value: Column, what: str) -> Column:
    """The value, or an error when it is null, NaN or infinite."""
    good = F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))
    return F.when(good, value).otherwise(F.raise_error(F.lit(f"{what} contains NaN or infinite values")).cast("double"))


def transform_target(df: DataFrame, transform: TargetTransform, column: str = "y", name: str | None = None) -> DataFrame:
    return df.withColumn(name or column, finite(transform.forward(F.col(column)), "Transformed target"))


def inverse_target(df: DataFrame, transform: TargetTransform, column: str = "predicted") -> DataFrame:
    """Invert predictions and floor them at 0."""
    value = finite(transform.inverse(F.col(column)), "Forecast")
    return df.withColumn(column, F.greatest(value, F.lit(0.0)))
