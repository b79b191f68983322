"""Calendar, season, weather and event queries."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headroom import fixed_values as fixed
from headroom.functions import calendar as C
from headroom.functions.clock import HOUR, hour_floor
from headroom.operators import enrichment as E
from headroom.plans.catalog import sql as S
from headroom.plans.catalog.common import (
    ORDER_HOURS_SQL,
    doubles,
    event_times,
    order_days,
    order_hours,
    rounded,
)
from headroom.plans.traffic import service_of, table

# Landfall dates of the checks; two of them a day apart, so their days overlap.
LANDFALLS = [date(1995, 8, 20), date(1996, 9, 3), date(1996, 9, 4), date(1997, 8, 31), date(1998, 9, 1), date(2000, 8, 10)]


def landfalls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(day,) for day in LANDFALLS], "date date")


def _with_event(spark: SparkSession, sf_dir: str, **columns) -> DataFrame:
    return event_times(spark, sf_dir).withColumns(columns)


def time_grid(spark, sf_dir):
    span = table(spark, sf_dir, "events").agg(hour_floor(F.min("ts")).alias("first"), hour_floor(F.max("ts")).alias("last"))
    return E.grid_between(span, HOUR // 4)


def season_index(spark, sf_dir):
    df = E.with_season_index(order_days(spark, sf_dir))
    return rounded(df, ["crop_activity_score"])


def storm_index(spark, sf_dir):
    return E.with_storm_index(order_days(spark, sf_dir), landfalls(spark))


def event_calendar(spark, sf_dir):
    return E.event_calendar(E.years_of(order_days(spark, sf_dir)))


def event_services(spark, sf_dir):
    events = E.with_event_services(event_calendar(spark, sf_dir))
    return events.select("scenario", "year", F.explode("services").alias("service"))


def event_boost(spark, sf_dir):
    """The yearly events, with an overlapping extra event per year."""
    df = order_hours(spark, sf_dir)
    scenarios = [*fixed.YEARLY_EVENTS, ("late_spring", (3, 18), (3, 25), 1.5, None, None)]
    events = E.event_calendar(E.years_of(df), scenarios)
    half = F.lit(0.25)
    return rounded(E.with_event_boost(df, events, draw=half), ["event_boost"])


def _enriched(spark, sf_dir, draw=0.25):
    df = order_hours(spark, sf_dir)
    return E.with_weather_and_events(df, landfalls(spark), E.event_calendar(E.years_of(df)), draw=F.lit(draw))


def expected_demand(spark, sf_dir):
    df = E.expected_demand(_enriched(spark, sf_dir), fixed.REQUEST_RATE_BASE, fixed.REQUEST_RATE_MAX)
    return rounded(df.select("o_orderkey", "ds", "y"), ["y"])


def model_input(spark, sf_dir):
    df = E.model_input(_enriched(spark, sf_dir))
    return rounded(df, ["request_rate", "cpu_utilization", "y"])


def service_hour_weight(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").alias("ds"), service_of(F.col("event_type")).alias("service")
    )
    return events.withColumn("weight", C.service_hour_weight(F.col("service"), F.col("ds")))


def business_event(spark, sf_dir):
    df = E.service_grid(order_hours(spark, sf_dir))
    return df.withColumn("business_event", C.business_event(F.col("service"), F.col("ds")))


def service_demand(spark, sf_dir):
    df = E.expected_service_demand(E.service_grid(_enriched(spark, sf_dir)))
    return rounded(df.select("o_orderkey", "ds", "service", "request_rate"), ["request_rate"])


def load_metrics(spark, sf_dir):
    demand = E.expected_service_demand(E.service_grid(_enriched(spark, sf_dir)))
    df = E.derive_load_metrics(demand).select(
        "o_orderkey", "service", "queue_depth", "cpu_utilization", "p95_latency", "error_rate", "db_connection_usage"
    )
    return rounded(df, doubles(df))


def service_table(spark, sf_dir):
    df = order_hours(spark, sf_dir)
    events = E.event_calendar(E.years_of(df))
    out = E.service_table(df, landfalls(spark), events, draw=F.lit(0.25))
    return rounded(out, doubles(out))


def service_grid(spark, sf_dir):
    return E.service_grid(time_grid(spark, sf_dir).where(F.minute("ds") == 0))


QUERIES = {
    "time_grid": time_grid,
    "calendar": lambda spark, sf: E.with_calendar(event_times(spark, sf)),
    "season_index": season_index,
    "weekday_weight": lambda spark, sf: order_days(spark, sf).withColumn("weight", C.weekday_weight(F.col("ds"))),
    "hour_weight": lambda spark, sf: _with_event(spark, sf, weight=C.hour_weight(F.col("ds"))),
    "monsoon_flag": lambda spark, sf: order_hours(spark, sf).withColumn("is_monsoon", C.monsoon_flag(F.col("ds"))),
    "storm_index": storm_index,
    "event_calendar": event_calendar,
    "event_services": event_services,
    "event_boost": event_boost,
    "storm_effect": lambda spark, sf: storm_index(spark, sf).withColumn("effect", C.storm_effect(F.col("typhoon_index"))),
    "expected_demand": expected_demand,
    "model_input": model_input,
    "service_hour_weight": service_hour_weight,
    "repayment_boost": lambda spark, sf: order_days(spark, sf).withColumn("boost", C.repayment_boost(F.col("ds"))),
    "month_end_boost": lambda spark, sf: order_days(spark, sf).withColumn("boost", C.month_end_boost(F.col("ds"))),
    "season_boosts": lambda spark, sf: order_days(spark, sf).withColumns(
        {"purchase": C.purchase_season_boost(F.col("ds")), "signup": C.signup_season_boost(F.col("ds"))}
    ),
    "business_event": business_event,
    "service_demand": service_demand,
    "load_metrics": load_metrics,
    "service_grid": service_grid,
    "service_table": service_table,
}

# --- SQL checks -----------------------------------------------------------------


def _index(values: list[float], key: str, first: int) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i + first} THEN {S.number(v)}" for i, v in enumerate(values)) + " END"


def _bands(hour: str, bands, default: float) -> str:
    whens = " ".join(f"WHEN {hour} >= {lo} AND {hour} < {hi} THEN {S.number(w)}" for lo, hi, w in bands)
    return f"CASE {whens} ELSE {S.number(default)} END"


_SCORE = " + ".join(
    f"{_index(values, 'month(ds)', 1)} * {S.number(fixed.CATEGORY_SHARE[name])}"
    for name, values in fixed.CATEGORY_ACTIVITY.items()
)
_WEEKDAY = _index(fixed.WEEKDAY_WEIGHT, "isodow(ds) - 1", 0)
_HOUR = _bands("hour(ds)", fixed.HOUR_BANDS, fixed.HOUR_DEFAULT)
_SERVICE_HOUR = "CASE service " + " ".join(
    f"WHEN '{s}' THEN {_bands('hour(ds)', bands, default)}" for s, (bands, default) in fixed.SERVICE_HOUR_BANDS.items()
) + " END"
_MONSOON = (
    "CASE WHEN ds >= make_timestamp(year(ds), 6, 25, 0, 0, 0) AND ds <= make_timestamp(year(ds), 7, 25, 23, 0, 0) "
    "THEN 1 ELSE 0 END"
)
_REPAYMENT = "CASE WHEN day(ds) >= 25 THEN CAST(1.35 AS DOUBLE) WHEN day(ds) <= 3 THEN CAST(1.15 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END"
_MONTH_END = (
    "CASE WHEN day(ds) >= 26 AND month(ds) IN (3, 6, 9, 12) THEN CAST(1.6 AS DOUBLE) "
    "WHEN day(ds) >= 26 THEN CAST(1.3 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END"
)
_PURCHASE = "CASE WHEN month(ds) IN (3, 4, 5, 9, 10, 11) THEN CAST(1.25 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END"
_SIGNUP = "CASE WHEN month(ds) IN (3, 4, 5, 9, 10) THEN CAST(1.12 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END"
_STORM_EFFECT = (
    "CASE WHEN typhoon_index >= 0.8 THEN CAST(0.4 AS DOUBLE) WHEN typhoon_index >= 0.3 THEN CAST(1.3 AS DOUBLE) "
    "ELSE CAST(1 AS DOUBLE) END"
)
_BUSINESS = """CASE service
  WHEN 'auth' THEN CASE WHEN month(ds) IN (3, 4, 5, 9, 10, 11) THEN 'signup_or_login_peak' ELSE 'normal' END
  WHEN 'payment' THEN CASE WHEN month(ds) = 3 AND day(ds) BETWEEN 10 AND 20 THEN 'spring_purchase_payment_spike'
       WHEN month(ds) = 9 AND day(ds) BETWEEN 2 AND 4 THEN 'post_typhoon_payment_recovery'
       WHEN day(ds) >= 25 THEN 'repayment_day' ELSE 'normal' END
  WHEN 'batch' THEN CASE WHEN hour(ds) BETWEEN 1 AND 4 THEN 'nightly_batch'
       WHEN day(ds) >= 26 THEN 'month_end_batch' ELSE 'normal' END
  WHEN 'admin' THEN CASE WHEN hour(ds) BETWEEN 9 AND 17 THEN 'business_hours' ELSE 'normal' END
  WHEN 'limit_scoring' THEN CASE WHEN month(ds) = 3 AND day(ds) BETWEEN 10 AND 20 THEN 'spring_credit_limit_spike'
       WHEN month(ds) IN (3, 4, 5, 9, 10, 11) THEN 'credit_limit_application_peak' ELSE 'normal' END
  END"""

_STORM_DAYS = (
    "storm_days AS (SELECT day, max(idx) AS idx FROM (VALUES "
    + ", ".join(
        f"(DATE '{landfall + timedelta(days=offset)}', {S.number(value)})"
        for landfall in LANDFALLS
        for offset, value in fixed.STORM_PROFILE
    )
    + ") AS t(day, idx) GROUP BY day)"
)


def _events_cte(source: str, extra: str = "") -> str:
    return f"""
years AS (SELECT unnest(generate_series(lo, hi)) AS year FROM (SELECT min(year({source}.ds)) AS lo, max(year({source}.ds)) AS hi FROM {source})),
scenarios AS (SELECT * FROM (VALUES
  ('spring_purchase_spike', 3, 10, 3, 20, CAST(1.4 AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)),
  ('post_typhoon_recovery_spike', 9, 2, 9, 4, 1.5, NULL, NULL),
  ('monsoon_volatility', 7, 5, 7, 15, NULL, 0.5, 1.5){extra})
  AS t(scenario, m1, d1, m2, d2, multiplier, multiplier_lo, multiplier_hi)),
calendar_events AS (
  SELECT scenario, CAST(year AS INTEGER) AS year, make_timestamp(year, m1, d1, 0, 0, 0) AS "start",
         make_timestamp(year, m2, d2, 23, 0, 0) AS "end", multiplier, multiplier_lo, multiplier_hi
  FROM years CROSS JOIN scenarios)"""


_ORDER_DAYS = "order_days AS (SELECT o_orderkey, o_orderdate AS ds FROM orders)"

_BOOST = """product(coalesce(e.multiplier, e.multiplier_lo + (e.multiplier_hi - e.multiplier_lo) * CAST(0.25 AS DOUBLE)))"""

_ENRICHED = f"""{ORDER_HOURS_SQL}, {_STORM_DAYS}, {_events_cte('order_hours')},
boosted AS (
  SELECT o.o_orderkey, coalesce({_BOOST}, 1) AS event_boost
  FROM order_hours o LEFT JOIN calendar_events e ON o.ds BETWEEN e."start" AND e."end" GROUP BY 1),
enriched AS (
  SELECT o.o_orderkey, o.ds, {_MONSOON} AS is_monsoon, coalesce(s.idx, CAST(0 AS DOUBLE)) AS typhoon_index, event_boost,
         {_SCORE} AS score
  FROM order_hours o JOIN boosted USING (o_orderkey) LEFT JOIN storm_days s ON s.day = CAST(o.ds AS DATE))"""


def _demand(base: float, top: float) -> str:
    product = f"{S.number(base)} * score * {_WEEKDAY} * {_HOUR} * {_STORM_EFFECT} * event_boost"
    return f"least(greatest({product}, 0), {S.number(top)})"


_SERVICE_DEMAND = f"""{_ENRICHED},
demand AS (
  SELECT *, greatest({S.mapping('service', fixed.SERVICE_BASE)}
    * (1 + {S.mapping('service', fixed.SERVICE_SEASON_STRENGTH)} * score) * {_WEEKDAY} * {_SERVICE_HOUR} * event_boost
    * CASE WHEN is_monsoon = 1 THEN CAST(1.08 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END
    * CASE WHEN typhoon_index >= 0.8 THEN CAST(0.85 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END
    * CASE service WHEN 'payment' THEN {_REPAYMENT} WHEN 'batch' THEN {_MONTH_END}
        WHEN 'limit_scoring' THEN {_PURCHASE} WHEN 'auth' THEN {_SIGNUP} ELSE CAST(1 AS DOUBLE) END, 0) AS request_rate
  FROM enriched CROSS JOIN {S.SERVICES})"""

_LOADED = f"""{_SERVICE_DEMAND},
queued AS (SELECT *, greatest(request_rate * {S.mapping('service', fixed.QUEUE_FACTOR)}, 0) AS queue_depth FROM demand),
loaded AS (
  SELECT *, least(greatest(12 + request_rate * {S.mapping('service', fixed.CPU_FACTOR)} + queue_depth * CAST(0.03 AS DOUBLE), 0), 100) AS cpu_utilization,
    greatest(60 + request_rate * {S.mapping('service', fixed.LATENCY_FACTOR)} + queue_depth * CAST(0.35 AS DOUBLE), 20) AS p95_latency,
    least(greatest(request_rate * {S.mapping('service', fixed.DB_FACTOR)}, 0), 100) AS db_connection_usage
  FROM queued),
measured AS (
  SELECT *, least(greatest(CAST(0.001 AS DOUBLE) + pow(cpu_utilization / 100, 3) * CAST(0.025 AS DOUBLE), 0), CAST(0.1 AS DOUBLE)) AS error_rate
  FROM loaded)"""

_LOAD_COLUMNS = ", ".join(
    f"{S.rounded(c)} AS {c}"
    for c in ("queue_depth", "cpu_utilization", "p95_latency", "error_rate", "db_connection_usage")
)
_CALENDAR = "CAST(hour(ds) AS INTEGER) AS hour, CAST(isodow(ds) - 1 AS INTEGER) AS day_of_week, CAST(month(ds) AS INTEGER) AS month"

_GRID = """quarters AS (
  SELECT unnest(generate_series(lo, hi, INTERVAL 15 MINUTE)) AS ds
  FROM (SELECT date_trunc('hour', min(ts)) AS lo, date_trunc('hour', max(ts)) AS hi FROM events))"""

ORACLE = {
    "time_grid": f"WITH {_GRID} SELECT ds FROM quarters",
    "calendar": f"SELECT event_id, ts AS ds, {_CALENDAR} FROM (SELECT event_id, ts, ts AS ds FROM events)",
    "season_index": f"WITH {_ORDER_DAYS} SELECT o_orderkey, ds, "
    + ", ".join(f"{_index(v, 'month(ds)', 1)} AS crop_{n}_activity" for n, v in fixed.CATEGORY_ACTIVITY.items())
    + f", {S.rounded(_SCORE)} AS crop_activity_score FROM order_days",
    "weekday_weight": f"WITH {_ORDER_DAYS} SELECT o_orderkey, ds, {_WEEKDAY} AS weight FROM order_days",
    "hour_weight": f"SELECT event_id, ds, {_HOUR} AS weight FROM (SELECT event_id, ts AS ds FROM events)",
    "monsoon_flag": f"WITH {ORDER_HOURS_SQL} SELECT o_orderkey, ds, {_MONSOON} AS is_monsoon FROM order_hours",
    "storm_index": f"""WITH {_ORDER_DAYS}, {_STORM_DAYS}
        SELECT o_orderkey, ds, coalesce(idx, CAST(0 AS DOUBLE)) AS typhoon_index
        FROM order_days LEFT JOIN storm_days ON day = CAST(ds AS DATE)""",
    "event_calendar": f"WITH {_ORDER_DAYS}, {_events_cte('order_days')} SELECT * FROM calendar_events",
    "event_services": f"""WITH {_ORDER_DAYS}, {_events_cte('order_days')}
        SELECT scenario, year, service FROM calendar_events CROSS JOIN {S.SERVICES}""",
    "event_boost": f"""WITH {ORDER_HOURS_SQL}, {_events_cte('order_hours', ", ('late_spring', 3, 18, 3, 25, 1.5, NULL, NULL)")}
        SELECT o_orderkey, ds, {S.rounded(f'coalesce({_BOOST}, 1)')} AS event_boost
        FROM order_hours o LEFT JOIN calendar_events e ON o.ds BETWEEN e."start" AND e."end" GROUP BY 1, 2""",
    "storm_effect": f"""WITH {_ORDER_DAYS}, {_STORM_DAYS},
        stormy AS (SELECT o_orderkey, ds, coalesce(idx, CAST(0 AS DOUBLE)) AS typhoon_index
                   FROM order_days LEFT JOIN storm_days ON day = CAST(ds AS DATE))
        SELECT *, {_STORM_EFFECT} AS effect FROM stormy""",
    "expected_demand": f"WITH {_ENRICHED} SELECT o_orderkey, ds, {S.rounded(_demand(100.0, 500.0))} AS y FROM enriched",
    "model_input": f"""WITH {_ENRICHED} SELECT o_orderkey, ds, is_monsoon, typhoon_index,
        {S.rounded(_demand(100.0, 500.0))} AS request_rate, {S.rounded(_demand(50.0, 100.0))} AS cpu_utilization,
        {_CALENDAR}, {S.rounded(_demand(100.0, 500.0))} AS y FROM enriched""",
    "service_hour_weight": f"""SELECT event_id, ds, service, {_SERVICE_HOUR} AS weight
        FROM (SELECT event_id, ts AS ds, {S._SERVICE_OF} AS service FROM events)""",
    "repayment_boost": f"WITH {_ORDER_DAYS} SELECT o_orderkey, ds, {_REPAYMENT} AS boost FROM order_days",
    "month_end_boost": f"WITH {_ORDER_DAYS} SELECT o_orderkey, ds, {_MONTH_END} AS boost FROM order_days",
    "season_boosts": f"WITH {_ORDER_DAYS} SELECT o_orderkey, ds, {_PURCHASE} AS purchase, {_SIGNUP} AS signup FROM order_days",
    "business_event": f"""WITH {ORDER_HOURS_SQL} SELECT o_orderkey, ds, service, {_BUSINESS} AS business_event
        FROM order_hours CROSS JOIN {S.SERVICES}""",
    "service_demand": f"WITH {_SERVICE_DEMAND} SELECT o_orderkey, ds, service, {S.rounded('request_rate')} AS request_rate FROM demand",
    "load_metrics": f"WITH {_LOADED} SELECT o_orderkey, service, {_LOAD_COLUMNS} FROM measured",
    "service_grid": f"WITH {_GRID} SELECT ds, service FROM quarters CROSS JOIN {S.SERVICES} WHERE minute(ds) = 0",
    "service_table": f"""WITH {_LOADED} SELECT o_orderkey, ds, service, is_monsoon, typhoon_index,
        {S.rounded('score')} AS crop_activity_score, {S.rounded('request_rate')} AS request_rate, {_LOAD_COLUMNS},
        {_BUSINESS} AS business_event, {_CALENDAR}, {S.rounded('request_rate')} AS y FROM measured""",
}
