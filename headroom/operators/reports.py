"""Time-series reports over prediction and decision tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headroom import fixed_values as fixed
from headroom import schemas
from headroom.functions.clock import DAY, HOUR, day_floor, ntz, order_value, plus_micros
from headroom.operators import ordering
from headroom.session import settle

# Rolling sums are whole numbers, so ties are ties on every partitioning: each series is scaled by
# a power of two that takes its largest value just below 2^62. That keeps all bits of values down to
# a five-hundredth of the largest, and of smaller ones more than a sum of doubles would.
EXACT, TOP_BIT = "decimal(38,0)", 62


def _scaled(df: DataFrame, value: str, series: Sequence[str]) -> DataFrame:
    """Add ``_value``; null and NaN values stay null."""
    number = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    largest = settle(df.groupBy(*series).agg(F.max(F.abs(number)).alias("_largest")))
    power = F.least(F.lit(1000), F.lit(TOP_BIT) - F.ceil(F.log2(F.nullif("_largest", F.lit(0.0)))))
    scale = F.coalesce(F.pow(F.lit(2.0), power.cast("double")), F.lit(1.0))
    scaled = F.rint(number * F.col("_scale")).cast("bigint").cast(EXACT)
    return df.join(largest.select(*series, scale.alias("_scale")), list(series)).withColumn("_value", scaled).drop("_scale")


def _median_step(placed: DataFrame, series: Sequence[str], rows: int) -> DataFrame:
    """Exact median of the time between neighbour rows, in microseconds, per series.

    Equal steps are counted first, so the usual series, with few different steps, shrinks to a few rows.
    """
    steps = ordering.with_lags(placed, {"_earlier": ("_at", 1)}, series=series, rows=rows)
    counted = (
        steps.where(F.col("_earlier").isNotNull())
        .groupBy(*series, (F.col("_at") - F.col("_earlier")).alias("_step"))
        .agg(F.count(F.lit(1)).alias("_times"))
    )
    middle = ordering.cut_values(
        settle(counted),
        {"_low": F.expr("(n + 1) div 2"), "_high": F.expr("n div 2 + 1")},
        series=series,
        order="_step",
        weight="_times",
        rows=rows,
    )
    return middle.select(*series, ((F.col("_low") + F.col("_high")) / 2).alias("_median"))


def peak_window_start(
    df: DataFrame,
    days: int,
    *,
    series: Sequence[str],
    value: str = "actual",
    order: str = "ds",
    step: int | None = None,
    rows: int = ordering.ROWS_PER_TASK,
) -> DataFrame:
    """Per series, the start of the ``days``-long window with the highest mean of ``value``.

    The window is counted in rows: rows per day from the median step, times ``days``, at
    most the whole series; the earliest of equal windows wins. Sums come from running
    totals, and each row meets the total one window earlier by an equi-join on position,
    so neither the window length nor the series length is bound to one task. The running
    totals are written once, since three passes read them. ``step`` marks gap-free grids,
    whose median step is known. Columns: the series, ``start`` and ``window_rows``.
    """
    if days <= 0:
        raise ValueError("days must be greater than 0")
    schemas.require_columns(df, [*series, order, value], "prediction frame")
    narrow = _scaled(df.select(*series, order, value), value, list(series)).select(*series, order, "_value")
    placed = ordering.with_position(narrow, series=series, order=order, step=step, rows=rows).withColumn(
        "_at", order_value(narrow, order)
    )
    placed = settle(ordering.running_total(placed, F.col("_value"), "_total", series=series, rows=rows))
    if step is None:
        steps = settle(_median_step(placed.select(*series, "rn", "_at"), series, rows))
        sized = placed.join(steps, list(series), "left")
    else:
        sized = placed.withColumn("_median", F.lit(float(step)))
    stop = F.raise_error(F.lit("neighbouring rows of a series need different timestamps")).cast("bigint")
    per_day = F.greatest(F.lit(1), F.bround(F.lit(float(DAY)) / F.col("_median"), 0)).cast("bigint")
    size = (
        F.when(F.col("n") < 2, F.lit(1).cast("bigint"))
        .when(F.coalesce(F.col("_median") <= 0, F.lit(True)), stop)
        .otherwise(F.least(F.col("n"), per_day * days))
    )
    sized = sized.withColumn("_size", size)
    ends = sized.where(F.col("rn") >= F.col("_size")).select(
        *series, "_size", "_total", (F.col("rn") - F.col("_size")).alias("_before")
    )
    starts = placed.select(
        *series, (F.col("rn") - 1).alias("_before"), F.col(order).alias("_start"), (F.col("_total") - F.col("_value")).alias("_base")
    )
    windows = ends.join(starts, [*series, "_before"])
    best = F.max_by(F.struct("_start", "_size"), F.struct(F.col("_total") - F.col("_base"), -F.col("_before")))
    return (
        windows.groupBy(*series)
        .agg(best.alias("_best"))
        .select(*series, F.col("_best._start").alias("start"), F.col("_best._size").alias("window_rows"))
    )


def window_slice(df: DataFrame, starts: DataFrame, days: int, *, keys: Sequence[str], order: str = "ds") -> DataFrame:
    """Rows in ``[start, start + days)`` of their key; ``starts`` has one row per key."""
    joined = df.join(settle(starts.select(*keys, "start")), list(keys))
    inside = (F.col(order) >= F.col("start")) & (
        F.col(order) < F.col("start") + F.make_dt_interval(F.lit(days))
    )
    return joined.where(inside).drop("start")


def select_window(
    df: DataFrame,
    days: int,
    *,
    series: Sequence[str],
    start: str | None = None,
    order: str = "ds",
    step: int | None = None,
) -> DataFrame:
    """The peak window of each series, or the window from ``start``; no rows at all is an error."""
    if start is not None:
        first = F.lit(start).cast("timestamp_ntz")
        inside = (F.col(order) >= first) & (F.col(order) < first + F.make_dt_interval(F.lit(days)))
        window = df.where(inside)
    else:
        starts = peak_window_start(df, days, series=series, order=order, step=step)
        window = window_slice(df, starts, days, keys=series, order=order)
    if window.isEmpty():
        raise schemas.TableError(f"the window of {days} days from {start or 'the peak'} has no rows")
    return window


def common_window(
    df: DataFrame,
    days: int,
    *,
    default_model: str,
    series: Sequence[str] = (),
    order: str = "ds",
    step: int | None = None,
    rows: int = ordering.ROWS_PER_TASK,
) -> DataFrame:
    """Rows of all models inside the peak window of ``default_model``, per series."""
    chosen = df.where(F.col("model") == default_model)
    starts = peak_window_start(chosen, days, series=[*series, "model"], order=order, step=step, rows=rows).drop("model")
    if series:
        return window_slice(df, starts, days, keys=list(series), order=order)
    first = starts.select("start").scalar()
    return df.where((F.col(order) >= first) & (F.col(order) < first + F.make_dt_interval(F.lit(days))))


def mismatch_spans(
    df: DataFrame, *, series: Sequence[str], order: str = "ds", step: int | None = None
) -> DataFrame:
    """Intervals in which predicted and actual pods differ: ``start``, ``end`` and ``kind``.

    A row lasts until the next one, the last row as long as the first, a lone row an hour.
    """
    series = list(series)
    narrow = df.select(*series, order, "actual_pods", "predicted_pods")
    placed = ordering.with_position(narrow, series=series, order=order, step=step)
    ahead = ordering.with_lags(placed, {"_next": (order, -1)}, series=series)
    differing = ahead.where(F.col("predicted_pods") != F.col("actual_pods"))
    if step is None:
        edge = ordering.cut_values(narrow, {"_d1": F.lit(1), "_d2": F.lit(2)}, series=series, order=order)
        width = F.coalesce(F.col("_d2") - F.col("_d1"), F.lit(HOUR))
        differing = differing.join(settle(edge.select(*series, width.alias("_width"))), series)
    else:
        differing = differing.withColumn("_width", F.lit(step).cast("bigint"))
    end = F.coalesce(F.col("_next"), plus_micros(F.col(order), F.col("_width")))
    kind = F.when(F.col("predicted_pods") < F.col("actual_pods"), "under").otherwise("over")
    return differing.select(
        *series, F.col(order).alias("start"), ntz(end).alias("end"), "actual_pods", "predicted_pods", kind.alias("kind")
    )


def _day_spine(daily: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every day between the first and last day of each key."""
    span = daily.groupBy(*keys).agg(F.min("ds").alias("_first"), F.max("ds").alias("_last"))
    days = F.explode(F.sequence(F.to_date("_first"), F.to_date("_last"))).alias("ds")
    return span.select(*keys, days).withColumn("ds", ntz(F.col("ds"))).where(F.col("ds").isNotNull())


def daily_overview(df: DataFrame, models: Sequence[str] = tuple(fixed.MODEL_NAMES), order: str = "ds") -> DataFrame:
    """Daily means over all models, one row per day: actual rate and pods of the first model,
    then ``<model>`` and ``<model>_pods`` of each; days without rows are kept with nulls.

    One aggregation with a condition per model, on partial sums; nothing is pivoted or
    joined wide. The daily rows are written before the empty days are put between them.
    """
    first = F.col("model") == models[0]
    columns = {"actual": F.avg(F.when(first, F.col("actual"))), "actual_pods": F.avg(F.when(first, F.col("actual_pods")))}
    for model in models:
        own = F.col("model") == model
        columns[model] = F.avg(F.when(own, F.col("predicted")))
        columns[f"{model}_pods"] = F.avg(F.when(own, F.col("predicted_pods")))
    daily = (
        df.where(F.col("model").isin(list(models)))
        .groupBy(day_floor(F.col(order)).alias("ds"))
        .agg(*[c.alias(name) for name, c in columns.items()])
    )
    daily = settle(daily)
    return _day_spine(daily, []).join(daily, "ds", "left")


def service_daily(df: DataFrame, values: Sequence[str] = ("actual", "predicted"), order: str = "ds") -> DataFrame:
    """Daily means per service; days without rows inside a service's span are kept with nulls."""
    daily = df.groupBy("service", day_floor(F.col(order)).alias("ds")).agg(*[F.avg(v).alias(v) for v in values])
    daily = settle(daily)
    return _day_spine(daily, ["service"]).join(daily, ["service", "ds"], "left")


def in_report_order(df: DataFrame, services: Sequence[str] = tuple(fixed.REPORT_ORDER)) -> DataFrame:
    """Rows of the listed services with their ``position`` in the list."""
    place = F.array_position(F.array(*[F.lit(s) for s in services]), F.col("service"))
    return df.withColumn("position", place.cast("int")).where(F.col("position") > 0)


def adjusted_stack(
    df: DataFrame, days: int = 30, services: Sequence[str] = tuple(fixed.REPORT_ORDER), order: str = "ds"
) -> DataFrame:
    """Daily mean pods of the first ``days`` of decisions, stacked in report order.

    Services without rows on a day count 0. ``requested_stack``/``adjusted_stack`` are the
    sums of the service and those before it; a day has one row per listed service.
    """
    first = df.agg(F.min(order)).scalar()
    early = df.where(F.col(order) < first + F.make_dt_interval(F.lit(days)))
    values = ["predicted_pods", "onprem_adjusted_pods"]
    daily = service_daily(early, values, order)
    every = daily.select("ds").distinct().select(
        "ds", F.posexplode(F.array(*[F.lit(s) for s in services])).alias("_at", "service")
    )
    stack = Window.partitionBy("ds").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    filled = every.join(daily, ["service", "ds"], "left").fillna(0.0, values)
    return filled.select(
        "ds",
        "service",
        (F.col("_at") + 1).cast("int").alias("position"),
        *values,
        F.sum("predicted_pods").over(stack).alias("requested_stack"),
        F.sum("onprem_adjusted_pods").over(stack).alias("adjusted_stack"),
    )


def metric_frame(metrics: DataFrame, pairs: Sequence[tuple[str, str, str]] = tuple(fixed.TUNED_PAIRS)) -> DataFrame:
    """The metric rows of the paired models (family, label, model)."""
    table = metrics.sparkSession.createDataFrame(list(pairs), "family string, label string, model string")
    return metrics.join(table, "model").select("family", "label", "model", *schemas.METRIC_COLUMNS)


def tuning_comparison(
    metrics: DataFrame, metric: str, pairs: Sequence[tuple[str, str, str]] = tuple(fixed.TUNED_PAIRS)
) -> DataFrame:
    """One metric before and after tuning: a row per family, a column per label."""
    labels = list(dict.fromkeys(label for _, label, _ in pairs))
    return metric_frame(metrics, pairs).groupBy("family").pivot("label", labels).agg(F.first(metric))
