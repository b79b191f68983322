"""Time grids and calendar, weather and event columns for any timestamped table."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headroom import fixed_values as fixed
from headroom import schemas
from headroom.functions import calendar as C
from headroom.functions.clock import DAY, SECOND, micros, ntz, order_value, plus_micros
from headroom.session import settle


def time_grid(spark: SparkSession, start: datetime, end: datetime, step_micros: int) -> DataFrame:
    """Timestamps from ``start`` to ``end`` inclusive, made in parallel; an empty range is an error."""
    if step_micros <= 0:
        raise schemas.TableError("step must be positive")
    span = end - start
    length = (span.days * 86_400 + span.seconds) * SECOND + span.microseconds
    if length < 0:
        raise schemas.TableError("the last moment lies before the first")
    origin = F.lit(start).cast("timestamp_ntz")
    return spark.range(length // step_micros + 1).select(plus_micros(origin, F.col("id") * step_micros).alias("ds"))


def grid_between(bounds: DataFrame, step_micros: int) -> DataFrame:
    """Timestamps between columns ``first`` and ``last`` of a one-row table.

    Days are listed first and spread over tasks, then each day lists its own moments;
    the step has to divide a day.
    """
    if step_micros <= 0 or DAY % step_micros:
        raise schemas.TableError("step must divide a day")
    days = bounds.select(
        "first", "last", F.explode(F.sequence(F.to_date("first"), F.to_date("last"))).alias("_day")
    ).repartition("_day")
    moments = days.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(DAY // step_micros - 1))))
    at = plus_micros(ntz(F.col("_day")), F.col("_k").cast("bigint") * F.lit(step_micros))
    return moments.withColumn("ds", at).where(F.col("ds").between(F.col("first"), F.col("last"))).select("ds")


def with_calendar(df: DataFrame, ds: str = "ds") -> DataFrame:
    at = F.col(ds)
    return df.withColumns(
        {"hour": C.hour(at), "day_of_week": C.day_of_week(at), "month": C.month(at)}
    )


def with_season_index(
    df: DataFrame,
    activity: Mapping[str, Sequence[float]] = fixed.CATEGORY_ACTIVITY,
    shares: Mapping[str, float] = fixed.CATEGORY_SHARE,
    ds: str = "ds",
) -> DataFrame:
    """Activity of each category in the month and their share-weighted sum."""
    at = F.col(ds)
    columns = {f"crop_{name}_activity": C.category_activity(at, name, activity) for name in activity}
    return df.withColumns({**columns, "crop_activity_score": C.season_index(at, activity, shares)})


def storm_days(landfalls: DataFrame, profile=fixed.STORM_PROFILE, date: str = "date") -> DataFrame:
    """One row per day near a landfall with the highest index of all storms near it."""
    offsets = F.array(*[F.struct(F.lit(d).alias("offset"), F.lit(v).alias("index")) for d, v in profile])
    near = landfalls.select(F.col(date).cast("date").alias("_date"), F.explode(offsets).alias("_storm"))
    return near.groupBy(F.date_add("_date", F.col("_storm.offset")).alias("_day")).agg(
        F.max("_storm.index").alias("typhoon_index")
    )


def with_storm_index(df: DataFrame, landfalls: DataFrame, ds: str = "ds") -> DataFrame:
    """Add ``typhoon_index``, 0 away from landfalls.

    There is at most one storm day per calendar day, so the join side is bounded by the
    calendar; the choice of join is left to the optimizer, which knows its size.
    """
    kept = df.drop("typhoon_index")
    joined = kept.join(storm_days(landfalls), F.to_date(ds) == F.col("_day"), "left")
    return joined.withColumn("typhoon_index", F.coalesce("typhoon_index", F.lit(0.0))).drop("_day")


def event_calendar(years: DataFrame, scenarios=fixed.YEARLY_EVENTS, year: str = "year") -> DataFrame:
    """One event row per scenario and year: first and last moment and the multiplier or its range."""
    at = F.col(year).cast("int")
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("scenario"),
                C.yearly_moment(at, first, 0).alias("start"),
                C.yearly_moment(at, last, 23).alias("end"),
                F.lit(multiplier).cast("double").alias("multiplier"),
                F.lit(low).cast("double").alias("multiplier_lo"),
                F.lit(high).cast("double").alias("multiplier_hi"),
            )
            for name, first, last, multiplier, low, high in scenarios
        ]
    )
    return years.select(at.alias("year"), F.explode(entries).alias("_e")).select(
        "_e.scenario", "year", "_e.start", "_e.end", "_e.multiplier", "_e.multiplier_lo", "_e.multiplier_hi"
    )


def years_of(df: DataFrame, ds: str = "ds") -> DataFrame:
    """Every year between the first and the last row of a table."""
    bounds = df.agg(F.min(ds).alias("first"), F.max(ds).alias("last"))
    return bounds.select(F.explode(F.sequence(F.year("first"), F.year("last"))).alias("year"))


def with_event_services(events: DataFrame, services: Sequence[str] = tuple(fixed.SERVICES)) -> DataFrame:
    return events.withColumn("services", F.array(*[F.lit(name) for name in services]))


def _event_edges(events: DataFrame, ranges: bool) -> DataFrame:
    """``_day, at, multiplier, lo, hi, n``: how many more events of each factor cover the day from ``at`` on, in microseconds."""
    constant = F.col("multiplier").isNotNull()
    effective = constant | (F.lit(ranges) & F.col("multiplier_lo").isNotNull() & F.col("multiplier_hi").isNotNull())
    begin, end = (micros(F.col(c).cast("timestamp_ntz")) for c in ("start", "end"))
    spans = events.where(effective).select(
        begin.alias("begin"),
        (end + 1).alias("end"),
        "multiplier",
        *[F.when(~constant, F.col(f"multiplier_{c}")).alias(c) for c in ("lo", "hi")],
    )
    day, last = (F.floor(F.col(c) / F.lit(DAY)) for c in ("begin", "_end"))
    spans = spans.where("begin < end").withColumn("_end", F.col("end") - 1).withColumn("_day", F.explode(F.sequence(day, last)))
    opened = F.struct(F.greatest("begin", F.col("_day") * DAY).alias("at"), F.lit(1).cast("long").alias("n"))
    closed = F.struct(F.col("end").alias("at"), F.lit(-1).cast("long").alias("n"))  # the day's end needs none
    edges = F.when(F.col("end") < (F.col("_day") + 1) * DAY, F.array(opened, closed)).otherwise(F.array(opened))
    rows = spans.select("_day", "multiplier", "lo", "hi", F.inline(edges))
    return rows.groupBy("_day", "at", "multiplier", "lo", "hi").agg(F.sum("n").alias("n")).where("n != 0")


_FEW_FACTORS = 16
SEGMENTS_IN_BUCKET = 8
_SEGMENT = "_day bigint, _width bigint, _bucket bigint, _from bigint, _until bigint, _constant double, _ranges array<struct<lo: double, hi: double, n: bigint>>"


def _product(counts: dict[float, int], logarithm: int) -> float:
    """Product of the factors: plainly where few differ, from the exact sum of their logarithms where many do."""
    if len(counts) <= _FEW_FACTORS:
        return float(np.prod([np.float64(m) ** n for m, n in sorted(counts.items())]))
    if 0.0 in counts:
        return 0.0
    sign = -1 if sum(n for m, n in counts.items() if m < 0) % 2 else 1
    return float(sign * np.exp(logarithm / 2**60))


def _sweep(edges: pd.DataFrame) -> pd.DataFrame:
    """Disjoint segments of a day between the moments at which events begin and end, with the product over each."""
    day, out = int(edges["_day"].iloc[0]), []
    counts, ranges, logarithm = {}, {}, 0
    moments = edges.sort_values("at").groupby("at", sort=True)
    starts = list(moments.groups)
    width = DAY // min(86_400, 1 + len(starts) // SEGMENTS_IN_BUCKET) + 1
    for (at, own), until in zip(moments, [*starts[1:], (day + 1) * DAY]):
        for multiplier, lo, hi, n in zip(own["multiplier"], own["lo"], own["hi"], own["n"]):
            constant = not pd.isna(multiplier)
            held, key = (counts, multiplier) if constant else (ranges, (lo, hi))
            held[key] = held.get(key, 0) + int(n)
            if not held[key]:
                del held[key]
            if constant and multiplier:
                logarithm += round(math.log(abs(multiplier)) * 2**60) * int(n)
        if counts or ranges:
            factors = [{"lo": lo, "hi": hi, "n": n} for (lo, hi), n in sorted(ranges.items())]
            product = _product(counts, logarithm)
            for bucket in range((at - day * DAY) // width, (until - 1 - day * DAY) // width + 1):
                out.append((day, width, bucket, at, until, product, factors))
    return pd.DataFrame(out, columns=["_day", "_width", "_bucket", "_from", "_until", "_constant", "_ranges"])


def with_event_boost(
    df: DataFrame, events: DataFrame, *, draw: Column | None = None, ds: str = "ds", name: str = "event_boost"
) -> DataFrame:
    """Product of the multipliers of all events that cover the row, 1 where none does.

    A sweep over the moments at which events begin and end cuts each day into disjoint segments with their
    product; equal factors are counted before, so no list of events is held. A row finds its segment by day and
    bucket: a day has as many buckets of equal width as it has some few segments each.
    An event with a range instead of a multiplier takes ``low + (high - low) * draw``
    when a column of numbers in [0, 1) is given, and no effect otherwise.
    """
    segments = settle(_event_edges(events, draw is not None).groupBy("_day").applyInPandas(_sweep, _SEGMENT))
    widths = segments.select("_day", "_width").distinct()

    luck = F.lit(None).cast("double") if draw is None else draw.cast("double")
    at = micros(F.col(ds).cast("timestamp_ntz"))
    rows = df.withColumns({"_draw": luck, "_at": at}).withColumn("_day", F.floor(F.col("_at") / F.lit(DAY)))
    rows = rows.join(widths, "_day", "left").withColumn("_bucket", F.expr(f"(_at - _day * {DAY}L) div _width"))
    same = (F.col("r._day") == F.col("s._day")) & (F.col("r._bucket") == F.col("s._bucket"))
    covers = (F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_until"))
    found = rows.alias("r").join(segments.drop("_width").alias("s"), same & covers, "left")

    def ranged(product: Column, r: Column) -> Column:
        factor = F.coalesce(r["lo"] + (r["hi"] - r["lo"]) * F.col("_draw"), F.lit(1.0))
        return product * F.when(r["n"] == 1, factor).otherwise(F.pow(factor, r["n"]))

    boost = F.coalesce(F.aggregate("_ranges", F.col("_constant"), ranged), F.lit(1.0))
    return found.select(*[F.col(f"r.`{c}`") for c in df.columns if c != name], boost.alias(name))


def expected_demand(
    df: DataFrame,
    base: float,
    clip_max: float,
    *,
    name: str = "y",
    monsoon_factor: str | None = None,
    noise: str | None = None,
    ds: str = "ds",
) -> DataFrame:
    """Demand from season, weekday, hour, storm, monsoon and events, clipped to ``[0, clip_max]``.

    Needs ``typhoon_index`` and ``event_boost``; ``monsoon_factor`` names a column that
    applies where ``is_monsoon`` is 1, ``noise`` a column that is added.
    """
    at = F.col(ds)
    monsoon = (
        F.when(F.col("is_monsoon") == 1, F.col(monsoon_factor)).otherwise(1.0) if monsoon_factor else F.lit(1.0)
    )
    value = (
        F.lit(base)
        * C.season_index(at)
        * C.weekday_weight(at)
        * C.hour_weight(at)
        * C.storm_effect(F.col("typhoon_index"))
        * monsoon
        * F.col("event_boost")
        + (F.col(noise) if noise else F.lit(0.0))
    )
    return df.withColumn(name, F.least(F.greatest(value, F.lit(0.0)), F.lit(clip_max)))


def with_weather_and_events(
    df: DataFrame, landfalls: DataFrame, events: DataFrame, *, draw: Column | None = None, ds: str = "ds"
) -> DataFrame:
    flagged = df.withColumn("is_monsoon", C.monsoon_flag(F.col(ds)))
    return with_event_boost(with_storm_index(flagged, landfalls, ds), events, draw=draw, ds=ds)


def model_input(df: DataFrame) -> DataFrame:
    """The single-series traffic table: demand, utilisation, calendar; ``y`` repeats the request rate.

    Needs the columns of ``with_weather_and_events``; other columns of ``df`` come along first.
    """
    own = [c for c in df.columns if c not in ("ds", "is_monsoon", "typhoon_index", "event_boost")]
    rated = expected_demand(df, fixed.REQUEST_RATE_BASE, fixed.REQUEST_RATE_MAX, name="request_rate")
    rated = expected_demand(rated, fixed.CPU_BASE, fixed.CPU_MAX, name="cpu_utilization")
    return with_calendar(rated).select(
        *own,
        "ds",
        "is_monsoon",
        "typhoon_index",
        "request_rate",
        "cpu_utilization",
        "hour",
        "day_of_week",
        "month",
        F.col("request_rate").alias("y"),
    )


def service_grid(df: DataFrame, services: Sequence[str] = tuple(fixed.SERVICES)) -> DataFrame:
    """Every row once per service."""
    return df.select("*", F.explode(F.array(*[F.lit(name) for name in services])).alias("service"))


def expected_service_demand(df: DataFrame, *, noise: str | None = None, ds: str = "ds") -> DataFrame:
    """Add ``request_rate`` per service; needs ``service``, ``is_monsoon``, ``typhoon_index``, ``event_boost``."""
    at, service = F.col(ds), F.col("service")
    own = F.col("_own")
    seasonal = F.lit(1.0) + own["strength"] * C.season_index(at)
    value = (
        own["base"]
        * seasonal
        * C.weekday_weight(at)
        * C.service_hour_weight(service, at)
        * F.col("event_boost")
        * F.when(F.col("is_monsoon") == 1, fixed.MONSOON_DEMAND).otherwise(1.0)
        * F.when(F.col("typhoon_index") >= fixed.STORM_FROM, fixed.STORM_DEMAND).otherwise(1.0)
        * C.service_boost(service, at)
        + (F.col(noise) if noise else F.lit(0.0))
    )
    constants = C.service_values(service, base=fixed.SERVICE_BASE, strength=fixed.SERVICE_SEASON_STRENGTH)
    return df.withColumn("_own", constants).withColumn("request_rate", F.greatest(value, F.lit(0.0))).drop("_own")


def _between(value: Column, low: float, high: float | None = None) -> Column:
    floored = F.greatest(value, F.lit(float(low)))
    return floored if high is None else F.least(floored, F.lit(float(high)))


def derive_load_metrics(df: DataFrame, *, queue_noise: str | None = None) -> DataFrame:
    """Queue, CPU, latency, error rate and database use from ``service`` and ``request_rate``.

    Each step uses the bounded result of the one before.
    """
    rate, own, queued = F.col("request_rate"), F.col("_own"), F.col("queue_depth")
    constants = C.service_values(
        F.col("service"),
        queue=fixed.QUEUE_FACTOR,
        cpu=fixed.CPU_FACTOR,
        latency=fixed.LATENCY_FACTOR,
        connections=fixed.DB_FACTOR,
    )
    noise = F.col(queue_noise) if queue_noise else F.lit(0.0)
    cpu = F.lit(fixed.CPU_IDLE) + rate * own["cpu"] + queued * fixed.CPU_PER_QUEUED
    latency = F.lit(fixed.LATENCY_IDLE) + rate * own["latency"] + queued * fixed.LATENCY_PER_QUEUED
    errors = F.lit(fixed.ERROR_BASE) + F.pow(F.col("cpu_utilization") / 100, F.lit(3.0)) * fixed.ERROR_SLOPE
    return (
        df.withColumn("_own", constants)
        .withColumn("queue_depth", _between(rate * own["queue"] + noise, 0))
        .withColumns({"cpu_utilization": _between(cpu, 0, fixed.CPU_MOST), "p95_latency": _between(latency, fixed.LATENCY_LEAST)})
        .withColumns(
            {
                "error_rate": _between(errors, 0, fixed.ERROR_MOST),
                "db_connection_usage": _between(rate * own["connections"], 0, fixed.CONNECTIONS_MOST),
            }
        )
        .drop("_own")
    )


SERVICE_TABLE_COLUMNS = [
    "ds",
    "service",
    "is_monsoon",
    "typhoon_index",
    "crop_activity_score",
    "request_rate",
    "cpu_utilization",
    "p95_latency",
    "queue_depth",
    "error_rate",
    "db_connection_usage",
    "business_event",
    "hour",
    "day_of_week",
    "month",
    "y",
]


def service_table(
    df: DataFrame,
    landfalls: DataFrame,
    events: DataFrame,
    services: Sequence[str] = tuple(fixed.SERVICES),
    *,
    draw: Column | None = None,
    noise: str | None = None,
    queue_noise: str | None = None,
) -> DataFrame:
    """The full service table over the timestamps of ``df``, one row per timestamp and service."""
    own = [c for c in df.columns if c not in SERVICE_TABLE_COLUMNS]
    enriched = with_weather_and_events(df, landfalls, events, draw=draw)
    # labels and season are those of the timestamp: found once for all its services
    labels = F.struct(*[label.alias(name) for name, label in C.business_events(F.col("ds")).items()])
    enriched = enriched.withColumns({"_labels": labels, "crop_activity_score": C.season_index(F.col("ds"))})
    demand = expected_service_demand(service_grid(enriched, services), noise=noise)
    loaded = with_calendar(derive_load_metrics(demand, queue_noise=queue_noise))
    label = F
    for name in services:
        label = label.when(F.col("service") == name, F.col("_labels")[name])
    return loaded.withColumns({"business_event": label, "y": F.col("request_rate")}).select(*own, *SERVICE_TABLE_COLUMNS)


def ds_span(df: DataFrame, ds: str = "ds") -> DataFrame:
    """First and last timestamp of a table in microseconds, for checks."""
    value = order_value(df, ds)
    return df.agg(F.min(value).alias("first"), F.max(value).alias("last"))
