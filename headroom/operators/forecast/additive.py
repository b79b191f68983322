"""Additive and multiplicative seasonal forecaster: trend with changepoints, Fourier seasons, regressors.

The fit is penalised regression per series on sums of products. The prior scales become
ridge penalties, the noise level comes from the unpenalised fit. Changepoints have a Gaussian prior or, where
``changepoints`` is "sparse", a double-exponential one, solved by coordinate descent on the same sums. A multiplicative season
is fitted by turns: the season given the trend, then the trend given the season.

All trials of a search share one pass over the rows: waves and regressors are computed once per row, and
only the hinges, which depend on the range of changepoints, differ between trials. Series that fit a task are fitted there
with all their trials, some series at a time as one stack of matrices; of longer ones, tasks hand on partial sums per trial.
Forecasts are products of the same stacks, so a row's waves are computed once for all trials.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headroom import fixed_values as fixed
from headroom.functions.clock import DAY, order_value
from headroom.operators.forecast import gram
from headroom.session import settle

CHANGEPOINTS = 25
TREND = 2 + CHANGEPOINTS  # constant, slope and hinges
ROWS_PER_DEAL = 20_000  # of several series that a task takes at a time
MODELS_PER_DEAL = 2_000
ROWS_PER_STACK = 8_192  # of them, that are looked at together

# Period in days and number of harmonics of each season.
SEASONS = {"yearly": (365.25, 10), "weekly": (7.0, 3), "daily": (1.0, 4)}
MONTHLY = ("monthly", (30.5, 5))


@dataclass(frozen=True)
class AdditiveParams:
    seasonality_mode: str = "additive"
    changepoint_prior_scale: float = 0.05
    seasonality_prior_scale: float = 10.0
    holidays_prior_scale: float = 10.0
    changepoint_range: float = 0.8
    changepoints: str = "ridge"

    def __post_init__(self):
        if self.changepoints not in ("ridge", "sparse"):
            raise ValueError(f"unknown prior of changepoints: {self.changepoints}")
        if self.seasonality_mode not in ("additive", "multiplicative"):
            raise ValueError(f"unknown seasonality mode: {self.seasonality_mode}")
        if not 0 < self.changepoint_range <= 1:
            raise ValueError("changepoint_range must be in (0, 1]")
        for name in ("changepoint_prior_scale", "seasonality_prior_scale", "holidays_prior_scale"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be greater than 0")


# The recipe that won the search, and the one it started from.
RECIPE = AdditiveParams("additive", 0.1, 10.0, 1.0, 0.8)
FIRST_RECIPE = AdditiveParams("multiplicative", 0.03, 8.0, 1.0, 0.9)


@dataclass(frozen=True)
class Design:
    """Which seasons and regressors a model has."""

    regressors: Sequence[str] = tuple(fixed.STATIC_FEATURES)
    monthly: bool = False

    @property
    def seasons(self) -> dict[str, tuple[float, int]]:
        return {**SEASONS, **dict([MONTHLY])} if self.monthly else dict(SEASONS)

    @property
    def waves(self) -> int:
        return sum(2 * order for _, order in self.seasons.values())


RECIPE_DESIGN = Design(tuple(fixed.RECIPE_REGRESSORS), monthly=True)


def fourier(days: Column, seasons: Mapping[str, tuple[float, int]]) -> dict[str, Column]:
    """Sine and cosine waves of each season at a time given in days."""
    out = {}
    for name, (period, order) in seasons.items():
        for j in range(1, order + 1):
            angle = days * F.lit(2 * math.pi * j / period)
            out[f"{name}_sin_{j}"] = F.sin(angle)
            out[f"{name}_cos_{j}"] = F.cos(angle)
    return out


def trend_columns(t: Column, changepoint_range: Column) -> dict[str, Column]:
    """Constant, slope, and a hinge per changepoint; ``t`` runs from 0 to 1 over the training rows."""
    hinges = {
        f"hinge_{j}": F.greatest(t - changepoint_range * F.lit(j / CHANGEPOINTS), F.lit(0.0))
        for j in range(1, CHANGEPOINTS + 1)
    }
    return {"constant": F.lit(1.0), "slope": t, **hinges}


def days_since_epoch(df: DataFrame, order: str) -> Column:
    return order_value(df, order).cast("double") / F.lit(float(DAY))


def columns(design: Design) -> tuple[list[Column], list[Column]]:
    t = (F.col("_days") - F.col("first_day")) / F.col("span_days")
    trend = list(trend_columns(t, F.col("_range")).values())
    season = [*fourier(F.col("_days"), design.seasons).values(), *[F.col(c).cast("double") for c in design.regressors]]
    return trend, season


def pulls(params: AdditiveParams, design: Design) -> list[float]:
    """Ridge penalties of all columns per unit of noise."""
    return _penalties(params, design, 1.0).tolist()


def _penalties(params: AdditiveParams, design: Design, variance: float | np.ndarray) -> np.ndarray:
    trend = [5.0, 5.0] + [math.sqrt(2) * params.changepoint_prior_scale] * CHANGEPOINTS
    season = [params.seasonality_prior_scale] * design.waves + [params.holidays_prior_scale] * len(design.regressors)
    return np.asarray(variance)[..., None] / np.square(trend + season)


def _sparse(matrix: np.ndarray, penalty: np.ndarray, hinges: slice, params: AdditiveParams, variance: np.ndarray) -> np.ndarray:
    if matrix.ndim > 2:
        return np.stack([_sparse(*own[:2], hinges, params, own[2]) for own in zip(matrix, penalty, variance)])
    penalty = penalty.copy()
    penalty[hinges] = 0.0
    absolute = np.zeros(len(penalty))
    absolute[hinges] = variance / params.changepoint_prior_scale
    return gram.sparse(matrix, penalty, absolute)


def solve_part(matrix: np.ndarray, rows: float | np.ndarray, params: AdditiveParams, design: Design, part: str) -> np.ndarray:
    """Coefficients of ``all`` columns, or of the ``season`` or the ``trend`` given the other. Matrices may be stacked."""
    ridge = gram.ridges(matrix)
    variance = gram.residual_variance(matrix, ridge(1e-8), rows)
    penalty = _penalties(params, design, variance)
    if part == "season":
        return ridge(penalty[..., TREND:])
    penalty = penalty[..., : matrix.shape[-1] - 1]
    return ridge(penalty) if params.changepoints == "ridge" else _sparse(matrix, penalty, slice(2, TREND), params, variance)


def _season(days: np.ndarray, others: np.ndarray, design: Design) -> np.ndarray:
    """Waves and regressors of each row; the waves of a day are computed once."""
    known, at = np.unique(days, return_inverse=True)
    angles = [known * (2 * math.pi * j / period) for period, order in design.seasons.values() for j in range(1, order + 1)]
    waves = np.column_stack([wave(angle) for angle in angles for wave in (np.sin, np.cos)])
    return np.hstack([waves[at], others])


def _knots(params: AdditiveParams) -> np.ndarray:
    return params.changepoint_range * np.arange(1, CHANGEPOINTS + 1) / CHANGEPOINTS


def _dotted(columns: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
    """Columns of each member of a stack times its coefficients."""
    return np.matmul(columns, coefficients[..., None])[..., 0]


def _products(columns: np.ndarray) -> np.ndarray:
    return np.matmul(columns.swapaxes(1, 2), columns)


class Stack:
    """Rows of several series as columns of regressions: shared waves and regressors, and a trend per range.

    Arrays are (series, rows, columns). A series with fewer rows than others is ``filled`` up with zeros, which add nothing to a sum.
    """

    def __init__(self, days: np.ndarray, season: np.ndarray, y: np.ndarray, filled: np.ndarray, first: np.ndarray, span: np.ndarray, scale: np.ndarray, design: Design):
        self.design, self.filled = design, filled
        self.t = np.where(filled, (days - first[:, None]) / span[:, None], 0.0)
        self.y = y / scale[:, None]
        self.others = np.concatenate([season, self.y[..., None]], axis=-1)
        self._bent: dict[tuple[int, ...], np.ndarray] = {}
        self._shared = None

    def trend(self, params: AdditiveParams) -> np.ndarray:
        """The columns of the trend, and the target."""
        out = np.empty((*self.t.shape, TREND + 1))
        out[..., 0], out[..., 1], out[..., -1] = self.filled, self.t, self.y
        hinges = out[..., 2:-1]
        np.maximum(np.subtract(self.t[..., None], _knots(params), out=hinges), 0.0, out=hinges)
        return out

    def _times(self, columns: np.ndarray, factor: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Columns times a factor per row, beside another target; in one place that is used again and again."""
        if columns.shape not in self._bent:
            self._bent[columns.shape] = np.empty_like(columns)
        out = np.multiply(columns, factor[..., None], out=self._bent[columns.shape])
        out[..., -1] = target
        return out

    def products(self, trend: np.ndarray, part: str, held: np.ndarray | None = None) -> np.ndarray:
        """Summed products of a part's columns and its target per series, given the coefficients ``held`` of the other part."""
        if part == "season":
            level = _dotted(trend[..., :-1], held)
            return _products(self._times(self.others, level, self.y - level))
        if part == "trend":
            return _products(self._times(trend, 1 + _dotted(self.others[..., :-1], held), self.y))
        if part == "level":
            return _products(trend)
        if self._shared is None:
            self._shared = _products(self.others)
        own = trend[..., :-1]
        cross = np.matmul(own.swapaxes(1, 2), self.others)
        out = np.empty((len(trend), *[TREND + self.others.shape[-1]] * 2))
        out[:, :TREND, :TREND], out[:, :TREND, TREND:], out[:, TREND:, :TREND], out[:, TREND:, TREND:] = _products(own), cross, cross.swapaxes(1, 2), self._shared
        return out

    def fit(self, params: AdditiveParams, passes: int) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients of trend and season, a row per series."""
        trend, rows = self.trend(params), self.filled.sum(axis=1)
        if params.seasonality_mode == "additive":
            found = solve_part(self.products(trend, "all"), rows, params, self.design, "all")
            return found[:, :TREND], found[:, TREND:]
        level, season = solve_part(self.products(trend, "level"), rows, params, self.design, "all"), np.zeros((len(trend), self.others.shape[-1] - 1))
        for _ in range(passes):
            season = solve_part(self.products(trend, "season", level), rows, params, self.design, "season")
            level = solve_part(self.products(trend, "trend", season), rows, params, self.design, "trend")
        return level, season


def _model(key: dict, trial: int, facts: dict, trend: np.ndarray, season: np.ndarray) -> dict:
    if not (np.isfinite(trend).all() and np.isfinite(season).all()):
        return _failure(key, trial, facts, "the fit has no finite solution")
    return key | {"trial": trial} | facts | {"trend": trend.tolist(), "season": season.tolist(), "state": "COMPLETE", "error": None}


def _failure(key: dict, trial: int, facts: dict, problem: object) -> dict:
    return key | {"trial": trial} | facts | {"trend": None, "season": None, "state": "FAIL", "error": str(problem)}


_FACTS = ["first_day", "span_days", "scale", "rows"]
_MODEL = "trial int, first_day double, span_days double, scale double, rows double, trend array<double>, season array<double>, state string, error string"


def _chunks(frames, keys: list[str], design: Design):
    """``key, first row, stack of one`` of each group of rows that arrive sorted by ``keys``; one group is held at a time."""
    held: list[pd.DataFrame] = []

    def made():
        part = pd.concat(held, ignore_index=True)
        days = part["_days"].to_numpy(float)
        season = _season(days, part[list(design.regressors)].to_numpy(float), design)
        edges = [part[name].to_numpy(float)[:1] for name in ("first_day", "span_days", "scale")]
        stack = Stack(days[None], season[None], part["_y"].to_numpy(float)[None], np.ones((1, len(part)), bool), *edges, design)
        return {name: part[name].iloc[0] for name in keys}, part.iloc[0], stack

    for frame in frames:
        frame = frame.reset_index(drop=True)
        own = frame[keys]
        same = (own == own.shift()) | (own.isna() & own.shift().isna())
        starts = [0, *np.flatnonzero(~same.all(axis=1).to_numpy())[1:], len(frame)] if len(frame) else [0]
        for begin, end in zip(starts, starts[1:]):
            piece = frame.iloc[begin:end]
            if held:
                a, b = held[-1][keys].iloc[-1], piece[keys].iloc[0]
                if not ((a == b) | (a.isna() & b.isna())).all():
                    yield made()
                    held = []
            held.append(piece)
    if held:
        yield made()


def _codes(columns: Sequence[pa.ChunkedArray]) -> np.ndarray:
    """A whole number per row, the same where all columns are."""
    code = np.zeros(len(columns[0]), np.int64)
    for column in columns:
        column = pc.add(column, 0.0) if pa.types.is_floating(column.type) else column  # -0.0 is 0.0
        own = column.combine_chunks().dictionary_encode(null_encoding="encode")
        code = np.unique(code * max(1, len(own.dictionary)) + own.indices.to_numpy(), return_inverse=True)[1]
    return code


def _numbers(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    """Columns of doubles side by side, null as NaN."""
    return np.column_stack([table.column(name).to_numpy() for name in names])


def _stacked(lengths: np.ndarray) -> list[np.ndarray]:
    """Which series are looked at together: those of like length, as many as fill a stack."""
    out, some = [], []
    for i in np.argsort(lengths, kind="stable"):
        if some and (len(some) + 1) * lengths[i] > ROWS_PER_STACK:
            out.append(np.array(some))
            some = []
        some.append(i)
    return [*out, np.array(some)] if some else out


def _least(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.fmin.reduceat(values, starts)


def _lists(values: np.ndarray, good: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as lists, null where they are not good."""
    edges = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(values.ravel()), mask=pa.array(~good))


def _fitter(trials: dict[int, AdditiveParams], design: Design, series: list[str], passes: int):
    """All trials of all series of a table of rows: a model row each."""

    def fit(table: pa.Table) -> pa.Table:
        code = _codes([table.column(c) for c in series])
        order = np.argsort(code, kind="stable")
        starts = np.flatnonzero(np.diff(code[order], prepend=-1))
        lengths = np.diff(starts, append=len(order))
        values = _numbers(table, ["_days", "_y", *design.regressors])[order]
        days, y = values[:, 0], values[:, 1]
        first, last, size = _least(days, starts), -_least(-days, starts), -_least(-np.abs(y), starts)
        span, scale = (np.where(x == 0, 1.0, x) for x in (last - first, size))
        season = _season(days, values[:, 2:], design)

        def stacked(some: np.ndarray) -> Stack:
            inside = np.arange(lengths[some].max())
            filled = inside < lengths[some][:, None]
            at = np.where(filled, starts[some][:, None] + inside, 0)
            shared = season[at]
            shared[~filled] = 0.0
            return Stack(days[at], shared, np.where(filled, y[at], 0.0), filled, first[some], span[some], scale[some], design)

        found, waiting = [], [(some, trials) for some in _stacked(lengths)]
        while waiting:
            some, asked = waiting.pop()
            stack, failed = stacked(some), {}
            for trial, params in asked.items():
                try:
                    found.append((some, trial, *stack.fit(params, passes), None))
                except Exception as problem:  # a failed trial is a result, not the end of the search
                    if len(some) == 1:
                        found.append((some, trial, np.full((1, TREND), np.nan), np.full((1, season.shape[1]), np.nan), str(problem)))
                    else:
                        failed[trial] = params
            if failed:  # only one of them may be to blame
                waiting += [(some[i : i + 1], failed) for i in range(len(some))]
        at = np.concatenate([some for some, *_ in found])
        trend, swing = (np.concatenate([entry[i] for entry in found]) for i in (2, 3))
        good = np.isfinite(trend).all(axis=1) & np.isfinite(swing).all(axis=1)
        problems = np.concatenate([np.full(len(some), problem or "the fit has no finite solution", object) for some, *_, problem in found])
        facts = [pa.array(x[at].astype(float)) for x in (first, span, scale, lengths)]
        numbers = pa.array(np.repeat([trial for _, trial, *_ in found], [len(some) for some, *_ in found]), pa.int32())
        states = pa.array(np.where(good, "COMPLETE", "FAIL").astype(object), pa.string())
        keys = table.select(series).take(pa.array(order[starts[at]]))
        lists = [_lists(x, good) for x in (trend, swing)]
        return pa.table([*keys.columns, numbers, *facts, *lists, states, pa.array(problems, pa.string(), mask=good)], names=[*series, *T_NAMES])

    return fit


def _summer(trials: dict[int, AdditiveParams], design: Design, keys: list[str], part: str):
    """Partial sums of a part of each long series, a row per trial, in one pass over the rows."""

    def sums(frames):
        for key, first, stack in _chunks(frames, keys, design):
            out = []
            held = {int(m["trial"]): np.asarray(m["held"], dtype=float) for m in first["_held"]} if part in ("season", "trend") else {}
            for trial, params in trials.items():
                if part in ("season", "trend") and trial not in held:
                    continue
                matrix = stack.products(stack.trend(params), part, held[trial][None] if trial in held else None)[0]
                out.append({name: key[name] for name in keys[:-1]} | {"trial": trial, "products": matrix[np.triu_indices(len(matrix))]})
            yield pd.DataFrame(out, columns=[*keys[:-1], "trial", "products"])

    return sums


def _fit_long(placed: DataFrame, trials: dict[int, AdditiveParams], design: Design, series: list[str], passes: int) -> DataFrame:
    """Models of series that are spread over tasks: every pass sums the products of all trials at once."""
    keys = [*series, "_part"]
    key_fields = [placed.schema[c] for c in series]
    facts = settle(placed.select(*series, *_FACTS).distinct())

    def summed(own: dict[int, AdditiveParams], part: str, held: DataFrame | None = None) -> DataFrame:
        rows = placed.withColumn("_held", F.lit(None).cast("array<struct<trial:int,held:array<double>>>")) if held is None else placed.join(held, series)
        rows = rows.repartition(*keys).sortWithinPartitions(*keys)
        schema = T.StructType([*key_fields, *T.StructType.fromDDL("trial int, products array<double>").fields])
        parts = rows.mapInPandas(_summer(own, design, keys, part), schema)
        at = parts.select(*series, "trial", F.posexplode("products").alias("_at", "_value"))
        at = at.groupBy(*series, "trial", "_at").agg(F.sum("_value").alias("_value"))
        whole = at.groupBy(*series, "trial").agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_value"))), lambda e: e["_value"]).alias("products"))
        return whole.join(facts, series)

    def solved(sums: DataFrame, part: str, before: DataFrame | None) -> DataFrame:
        table = sums if before is None else sums.join(before.select(*series, "trial", F.col("trend").alias("trend_"), F.col("season").alias("season_")), [*series, "trial"])

        def solve(frames):
            for frame in frames:
                out = []
                for row in frame.to_dict("records"):
                    key, own, params = {c: row[c] for c in series}, {c: row[c] for c in _FACTS}, trials[row["trial"]]
                    try:
                        found = solve_part(gram.square(row["products"]), row["rows"], params, design, "all" if part == "level" else part)
                        if part == "all":
                            trend, season = found[:TREND], found[TREND:]
                        elif part == "season":
                            trend, season = np.asarray(row["trend_"], dtype=float), found
                        else:
                            trend, season = found, np.zeros(design.waves + len(design.regressors)) if part == "level" else np.asarray(row["season_"], dtype=float)
                        out.append(_model(key, row["trial"], own, trend, season))
                    except Exception as problem:
                        out.append(_failure(key, row["trial"], own, problem))
                yield pd.DataFrame(out, columns=[*series, *T_NAMES])

        return settle(table.mapInPandas(solve, T.StructType([*key_fields, *T.StructType.fromDDL(_MODEL).fields])))

    straight = {t: p for t, p in trials.items() if p.seasonality_mode == "additive"}
    curved = {t: p for t, p in trials.items() if p.seasonality_mode == "multiplicative"}
    results = []
    if straight:
        results.append(solved(summed(straight, "all"), "all", None))
    if curved:
        current = solved(summed(curved, "level"), "level", None)
        for part, other in [("season", "trend"), ("trend", "season")] * passes:
            results.append(current.where("state = 'FAIL'"))
            current = current.where("state = 'COMPLETE'")
            held = current.groupBy(*series).agg(F.collect_list(F.struct("trial", F.col(other).alias("held"))).alias("_held"))
            current = solved(summed(curved, part, held), part, current)
        results.append(current)
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


T_NAMES = ["trial", *_FACTS, "trend", "season", "state", "error"]


def _keyed(df: DataFrame, series: Sequence[str]) -> DataFrame:
    """Rows whose series is known, as an inner join by it would leave them."""
    return df.where(reduce(and_, [F.col(c).isNotNull() for c in series]))


def _deal(series: Sequence[str], rows: float, models: float, *more: Column) -> Column:
    """Which rows and models a task takes at a time: whole series, by hash, so that a deal has a bounded number of either on average."""
    return F.pmod(F.xxhash64(*series, *more), F.lit(math.ceil(rows / ROWS_PER_DEAL) + math.ceil(models / MODELS_PER_DEAL) or 1)).alias("_deal")


def fit_additive(
    train: DataFrame,
    trials: Mapping[int, AdditiveParams] | AdditiveParams = AdditiveParams(),
    design: Design = Design(),
    *,
    series: Sequence[str],
    order: str = "ds",
    target: str = "y",
    passes: int = 2,
    rows_per_task: int = gram.ROWS_PER_PART,
) -> DataFrame:
    """One model row per series and trial: time span, scale, and the coefficient arrays ``trend`` and ``season``.

    A trial that cannot be fitted to a series gives a row with ``state`` FAIL and its ``error``. The result is written.
    """
    trials, series = {0: trials} if isinstance(trials, AdditiveParams) else dict(trials), list(series)
    others = [F.col(c).cast("double").alias(c) for c in design.regressors]
    narrow = train.select(*series, order, F.col(target).cast("double").alias("_y"), *others)
    narrow = narrow.withColumn("_days", days_since_epoch(narrow, order))
    spans = narrow.groupBy(*series).agg(
        F.min("_days").alias("first_day"),
        (F.max("_days") - F.min("_days")).alias("span_days"),
        F.max(F.abs("_y")).alias("scale"),
        F.count(F.lit(1)).cast("double").alias("rows"),
    )
    spans = settle(
        spans.withColumns(
            {c: F.when(F.col(c) == 0, F.lit(1.0)).otherwise(F.col(c)) for c in ("span_days", "scale")}
        )
    )
    schema = T.StructType([train.schema[c] for c in series] + T.StructType.fromDDL(_MODEL).fields)
    rows, count, most = spans.agg(F.sum("rows"), F.count(F.lit(1)), F.max("rows")).first()
    known, split = _keyed(narrow, series).drop(order), (most or 0) > rows_per_task
    short = known.join(spans.where(F.col("rows") <= rows_per_task).select(*series), series, "left_semi") if split else known
    # grouped, not repartitioned: after a join on the same keys a repartition is left out, and the join may give up their order
    dealt = short.groupBy(_deal(series, rows or 0, count * len(trials)))
    models = settle(dealt.applyInArrow(_fitter(trials, design, series, passes), schema))
    if not split:
        return models
    part = F.pmod(F.xxhash64(order), F.ceil(F.col("rows") / rows_per_task)).alias("_part")
    long = narrow.join(spans.where(F.col("rows") > rows_per_task), series)
    long = settle(long.select("*", part).drop(order))
    return models.unionByName(_fit_long(long, trials, design, series, passes))


def _scorer(trials: dict[int, AdditiveParams], design: Design, series: list[str], names: list[str]):
    """Rows with ``_found``, the trial and value of each model of their series; null where a column of the design is."""

    def score(rows: pa.Table, models: pa.Table) -> pa.Table:
        code = _codes([pa.chunked_array([*rows.column(c).chunks, *models.column(c).chunks], rows.column(c).type) for c in series])
        own, of = code[: rows.num_rows], code[rows.num_rows :]
        at = np.flatnonzero(np.isin(own, of))
        at = at[np.argsort(own[at], kind="stable")]
        by = np.argsort(of, kind="stable")
        rows, models = rows.take(pa.array(at)), models.take(pa.array(by))
        own, of = own[at], of[by]
        columns = ["_days", *(f"_x{i}" for i in range(len(design.regressors)))]
        values = _numbers(rows, columns)
        blank = np.any([rows.column(c).is_null().to_numpy() for c in columns], axis=0)
        season = _season(values[:, 0], values[:, 1:], design)
        first, span, scale = (models.column(c).to_numpy() for c in ("first_day", "span_days", "scale"))
        trend, swing = (pc.list_flatten(models.column(c)).to_numpy().reshape(-1, width) for c, width in (("trend", TREND), ("season", season.shape[1])))
        numbers = models.column("trial").to_numpy()
        knots = np.array([_knots(trials[t]) for t in numbers]).reshape(-1, 1, CHANGEPOINTS)
        curved = np.array([trials[t].seasonality_mode == "multiplicative" for t in numbers], bool)
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        found, counts = [], np.zeros(len(own), np.int32)
        for begin, end in zip(starts, [*starts[1:], len(own)]):
            which = slice(*(int(np.searchsorted(of, own[begin], side)) for side in ("left", "right")))
            for a in range(begin, end, ROWS_PER_STACK // 4):
                b = min(a + ROWS_PER_STACK // 4, end)
                t = (values[a:b, 0] - first[which, None]) / span[which, None]
                hinges = np.maximum(t[..., None] - knots[which], 0.0)
                level = trend[which, :1] + trend[which, 1:2] * t + _dotted(hinges, trend[which, 2:])
                wave = _dotted(season[a:b], swing[which])
                found.append((scale[which, None] * np.where(curved[which, None], level * (1 + wave), level + wave)).T.ravel())
                counts[a:b] = which.stop - which.start
        edges = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        flat = np.concatenate([np.zeros(0), *found])
        places = np.arange(len(flat)) - np.repeat(edges[:-1] - np.searchsorted(of, own, "left"), counts)
        both = pa.StructArray.from_arrays([pa.array(numbers[places], pa.int32()), pa.array(flat, mask=np.repeat(blank, counts))], ["trial", "value"])
        return pa.table([*rows.select(names).columns, pa.ListArray.from_arrays(pa.array(edges), both)], names=[*names, "_found"])

    return score


def predict_additive(
    models: DataFrame,
    future: DataFrame,
    trials: Mapping[int, AdditiveParams] | AdditiveParams = AdditiveParams(),
    design: Design = Design(),
    *,
    series: Sequence[str],
    order: str = "ds",
    floor: bool = True,
    rows_per_task: int = gram.ROWS_PER_PART,
) -> DataFrame:
    """Rows of ``future`` per trial with ``predicted``, floored at 0.

    A row meets the models of its series, one per trial, in a task that takes some series at a time; a long series is
    cut into parts, each with its models. Nothing is copied per trial before that, and neither side goes through the driver.
    """
    trials, series = {0: trials} if isinstance(trials, AdditiveParams) else dict(trials), list(series)
    fitted = models.where("state = 'COMPLETE'").where(F.col("trial").isin(list(trials)))
    fitted = _keyed(fitted, series).select(*series, *T_NAMES[:-2])
    sizes = settle(future.groupBy(*series).agg(F.count(F.lit(1)).alias("_rows")))
    count, total, most = sizes.agg(F.count(F.lit(1)), F.sum("_rows"), F.max("_rows")).first()
    others = {f"_x{i}": F.col(c).cast("double") for i, c in enumerate(design.regressors)}
    rows = _keyed(future, series).withColumns({"_days": days_since_epoch(future, order), **others})
    part = F.lit(0)
    if (most or 0) > rows_per_task:
        parts = sizes.where(F.col("_rows") > rows_per_task).select(*series, F.ceil(F.col("_rows") / rows_per_task).alias("_parts"))
        rows, fitted = (df.join(parts, series, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1))) for df in (rows, fitted))
        rows = rows.withColumn("_part", F.pmod(F.xxhash64(order), F.col("_parts")))
        fitted = fitted.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        part = F.col("_part").cast("bigint")
    deal = _deal(series, total or 0, count * len(trials), part.cast("bigint"))
    names = future.columns
    schema = T.StructType([*future.schema.fields, *T.StructType.fromDDL("_found array<struct<trial:int,value:double>>").fields])
    met = rows.groupBy(deal).cogroup(fitted.groupBy(deal)).applyInArrow(_scorer(trials, design, series, names), schema)
    value = F.greatest("value", F.lit(0.0)) if floor else F.col("value")
    return met.select(*names, F.inline("_found")).withColumn("predicted", value).select(*names, "trial", "predicted")


def parameter_table(models: DataFrame, *, series: Sequence[str]) -> DataFrame:
    """Fitted models as rows: parameter name, shape and values."""
    parts = [F.struct(F.lit(name).alias("param"), F.array(F.size(name)).alias("shape"), F.col(name).alias("values")) for name in ("trend", "season")]
    facts = [F.struct(F.lit(name).alias("param"), F.array(F.lit(1)).alias("shape"), F.array(name).alias("values")) for name in _FACTS]
    return models.where("state = 'COMPLETE'").select(*series, "trial", F.inline(F.array(*parts, *facts)))
