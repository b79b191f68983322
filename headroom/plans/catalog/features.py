"""Feature, fold and window queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from headroom import fixed_values as fixed
from headroom.functions.clock import HOUR
from headroom.operators import enrichment as E
from headroom.operators import features as X
from headroom.plans.catalog import sql as S
from headroom.plans.catalog.calendar import _CALENDAR, _ENRICHED, _MONSOON, _enriched
from headroom.plans.catalog.common import ORDER_HOURS_SQL, event_times, order_hours, rounded
from headroom.plans.traffic import service_traffic, supplier_series, table

SUPPLIER = ["supplier"]


def _calendar_events(spark, sf_dir):
    flat = {"is_monsoon": F.lit(0), "typhoon_index": F.lit(0.0)}
    return E.with_calendar(event_times(spark, sf_dir)).withColumns(flat)


def cyclic(spark, sf_dir):
    df = X.add_cyclic_features(E.with_calendar(event_times(spark, sf_dir)))
    return rounded(df.select("event_id", *fixed.CYCLIC_FEATURES), fixed.CYCLIC_FEATURES)


def cyclic_violations(spark, sf_dir):
    """Order keys folded a little too wide, so that some values fall outside their cycle."""
    key = F.col("o_orderkey")
    df = table(spark, sf_dir, "orders").select(
        (key % 26).alias("hour"), (key % 8).alias("day_of_week"), (key % 13).alias("month")
    )
    return X.cyclic_violations(df).withColumn("samples", F.array_join("samples", ","))


def feature_frame(spark, sf_dir):
    df = E.with_calendar(_enriched(spark, sf_dir))
    return rounded(X.model_features(df, keep=["o_orderkey"]), fixed.CYCLIC_FEATURES)


def recipe_features(spark, sf_dir):
    df = X.recipe_features(E.with_calendar(_enriched(spark, sf_dir)))
    kept = ["o_orderkey", *fixed.RECIPE_REGRESSORS, "hour_sin", "hour_cos"]
    return rounded(df.select(*kept), ["monsoon_typhoon", "hour_sin", "hour_cos"])


def split(spark, sf_dir):
    return X.with_fold(supplier_series(spark, sf_dir), series=SUPPLIER)


def split_grid(spark, sf_dir):
    return X.with_fold(service_traffic(spark, sf_dir), series=["service"], step=HOUR)


def split_nested(spark, sf_dir):
    return X.with_fold(supplier_series(spark, sf_dir), series=SUPPLIER, validation_ratio=0.2)


def limit_rows(spark, sf_dir):
    return X.with_fold(supplier_series(spark, sf_dir), series=SUPPLIER, train_tail=30, holdout_head=10)


def scale(spark, sf_dir):
    folded = split(spark, sf_dir).withColumn("weekday", F.weekday("ds").cast("double"))
    params = X.scaling_params(folded, ["y", "weekday"], series=SUPPLIER)
    return rounded(X.scale(folded, params, ["y", "weekday"], series=SUPPLIER), ["y", "weekday"], 6)


def unscale(spark, sf_dir):
    """Scaling and its inverse give the values back."""
    folded = split(spark, sf_dir)
    params = X.scaling_params(folded, ["y"], series=SUPPLIER)
    back = X.unscale(X.scale(folded, params, ["y"], series=SUPPLIER), params, "y", series=SUPPLIER)
    return rounded(back, ["y"], 6)


def sequences(spark, sf_dir):
    df = E.with_calendar(service_traffic(spark, sf_dir))
    built = X.sequences(df, ["y", "hour"], 24, series=["service"], step=HOUR)
    total = F.aggregate("window", F.lit(0.0), lambda acc, row: acc + row[0])
    return rounded(
        built.select(
            "service",
            "ds",
            F.size("window").alias("length"),
            F.col("window")[0][0].alias("oldest"),
            F.col("window")[23][0].alias("newest"),
            F.col("window")[0][1].alias("oldest_hour"),
            total.alias("total"),
            "target",
        ),
        ["total"],
        6,
    )


def sequences_irregular(spark, sf_dir):
    built = X.sequences(supplier_series(spark, sf_dir), ["y"], 7, series=SUPPLIER)
    total = F.aggregate("window", F.lit(0.0), lambda acc, row: acc + row[0])
    return built.select("supplier", "ds", total.alias("total"), "target")


def sarima_lags(spark, sf_dir):
    df = X.seasonal_lags(service_traffic(spark, sf_dir), X.SeasonalOrder(), series=["service"], step=HOUR)
    return df.select("service", "ds", "w", "w_lag1", "w_lag24", "w_lag25")


def target_transform(spark, sf_dir):
    df = X.transform_target(supplier_series(spark, sf_dir), X.TRANSFORMS["log1p"], "y", "transformed")
    back = X.inverse_target(df.withColumn("back", F.col("transformed")), X.TRANSFORMS["log1p"], "back")
    return rounded(back, ["transformed", "back"], 6)


QUERIES = {
    "cyclic": cyclic,
    "cyclic_violations": cyclic_violations,
    "feature_frame": feature_frame,
    "recipe_features": recipe_features,
    "split": split,
    "split_grid": split_grid,
    "split_nested": split_nested,
    "limit_rows": limit_rows,
    "scale": scale,
    "unscale": unscale,
    "sequences": sequences,
    "sequences_irregular": sequences_irregular,
    "sarima_lags": sarima_lags,
    "target_transform": target_transform,
}

# --- SQL checks -----------------------------------------------------------------


def _cycle(column: str, period: int, first: int) -> str:
    return f"{S.number(2 * math.pi)} * (CAST({column} AS DOUBLE) - {first}) / CAST({period} AS DOUBLE)"


_CYCLIC = ", ".join(
    f"{S.rounded(f'{fn}({_cycle(column, period, first)})')} AS {prefix}_{fn}"
    for column, prefix, period, first in fixed.CYCLES
    for fn in ("sin", "cos")
)

_FOLDED = f"""{S.SUPPLIER_DAYS},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY supplier ORDER BY ds) AS rn, count(*) OVER (PARTITION BY supplier) AS n
  FROM supplier_days),
cut AS (SELECT *, floor(CAST(n AS DOUBLE) * {S.number(1 - 0.2)}) AS train_rows FROM ranked),
folded AS (SELECT supplier, ds, y, CASE WHEN rn <= train_rows THEN 'train' ELSE 'holdout' END AS fold FROM cut)"""

_VIOLATIONS = " UNION ALL ".join(
    f"SELECT '{column}' AS \"column\", CAST(v AS VARCHAR) AS value, count(*) AS rows FROM "
    f"(SELECT o_orderkey % {fold} AS v FROM orders) WHERE v < {first} OR v >= {first + period} GROUP BY v"
    for column, fold, period, first in (("hour", 26, 24, 0), ("day_of_week", 8, 7, 0), ("month", 13, 12, 1))
)

ORACLE = {
    "cyclic": f"SELECT event_id, {_CYCLIC} FROM (SELECT event_id, {_CALENDAR} FROM (SELECT event_id, ts AS ds FROM events))",
    "cyclic_violations": f"""SELECT "column", CAST(sum(rows) AS BIGINT) AS invalid_rows,
        array_to_string(list_sort(list(value)), ',') AS samples FROM ({_VIOLATIONS}) GROUP BY 1""",
    "feature_frame": f"""WITH {_ENRICHED} SELECT o_orderkey, is_monsoon, typhoon_index, {_CYCLIC}
        FROM (SELECT *, {_CALENDAR} FROM enriched)""",
    "recipe_features": f"""WITH {_ENRICHED} SELECT o_orderkey, is_monsoon, typhoon_index,
        CASE WHEN hour IN (8, 9, 10, 18, 19, 20) THEN 1 ELSE 0 END AS is_peak_hour,
        CASE WHEN day_of_week IN (5, 6) THEN 1 ELSE 0 END AS is_weekend,
        {S.rounded('is_monsoon * typhoon_index')} AS monsoon_typhoon,
        {S.rounded(f"sin({_cycle('hour', 24, 0)})")} AS hour_sin, {S.rounded(f"cos({_cycle('hour', 24, 0)})")} AS hour_cos
        FROM (SELECT *, {_CALENDAR} FROM enriched)""",
    "split": f"WITH {_FOLDED} SELECT supplier, ds, y, fold FROM folded",
    "split_grid": f"""WITH {S.TRAFFIC} SELECT ds, service, y,
        CASE WHEN row_number() OVER (PARTITION BY service ORDER BY ds)
          <= floor(CAST(count(*) OVER (PARTITION BY service) AS DOUBLE) * {S.number(1 - 0.2)}) THEN 'train' ELSE 'holdout' END AS fold
        FROM traffic""",
    "split_nested": f"""WITH {_FOLDED} SELECT supplier, ds, y, CASE WHEN rn > train_rows THEN 'holdout'
        WHEN rn > floor(CAST(train_rows AS DOUBLE) * {S.number(1 - 0.2)}) THEN 'validation' ELSE 'train' END AS fold FROM cut""",
    "limit_rows": f"""WITH {_FOLDED}, placed AS (
          SELECT *, row_number() OVER (PARTITION BY supplier, fold ORDER BY ds) AS up,
            row_number() OVER (PARTITION BY supplier, fold ORDER BY ds DESC) AS down FROM folded)
        SELECT supplier, ds, y, fold FROM placed WHERE (fold = 'train' AND down <= 30) OR (fold = 'holdout' AND up <= 10)""",
    "scale": f"""WITH {_FOLDED}, wide AS (SELECT *, CAST(isodow(ds) - 1 AS DOUBLE) AS weekday FROM folded),
        params AS (SELECT supplier, avg(y) AS my, stddev_pop(y) AS sy, avg(weekday) AS mw, stddev_pop(weekday) AS sw
                   FROM wide WHERE fold = 'train' GROUP BY 1)
        SELECT supplier, ds, {S.rounded('(y - my) / CASE WHEN sy = 0 THEN 1 ELSE sy END', 6)} AS y, fold,
          {S.rounded('(weekday - mw) / CASE WHEN sw = 0 THEN 1 ELSE sw END', 6)} AS weekday
        FROM wide JOIN params USING (supplier)""",
    "unscale": f"WITH {_FOLDED} SELECT supplier, ds, {S.rounded('y', 6)} AS y, fold FROM folded",
    "sequences": f"""WITH {S.TRAFFIC}, placed AS (
          SELECT service, ds, y AS target, list(y) OVER w AS ys, list(CAST(hour(ds) AS DOUBLE)) OVER w AS hs,
            row_number() OVER (PARTITION BY service ORDER BY ds) AS rn
          FROM traffic WINDOW w AS (PARTITION BY service ORDER BY ds ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
        SELECT service, ds, CAST(len(ys) AS INTEGER) AS length, ys[1] AS oldest, ys[24] AS newest, hs[1] AS oldest_hour,
          {S.rounded('list_sum(ys)', 6)} AS total, target FROM placed WHERE rn > 24""",
    "sequences_irregular": f"""WITH {S.SUPPLIER_DAYS} SELECT supplier, ds, total, target FROM (
          SELECT supplier, ds, y AS target, sum(y) OVER w AS total, row_number() OVER (PARTITION BY supplier ORDER BY ds) AS rn
          FROM supplier_days WINDOW w AS (PARTITION BY supplier ORDER BY ds ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
        WHERE rn > 7""",
    "sarima_lags": f"""WITH {S.TRAFFIC}, diffed AS (
          SELECT service, ds, y - lag(y) OVER (PARTITION BY service ORDER BY ds) AS w FROM traffic)
        SELECT * FROM (SELECT service, ds, w, lag(w) OVER k AS w_lag1, lag(w, 24) OVER k AS w_lag24, lag(w, 25) OVER k AS w_lag25
          FROM diffed WINDOW k AS (PARTITION BY service ORDER BY ds)) WHERE w_lag25 IS NOT NULL""",
    "target_transform": f"""WITH {S.SUPPLIER_DAYS} SELECT supplier, ds, y, {S.rounded('ln(1 + y)', 6)} AS transformed,
        {S.rounded('y', 6)} AS back FROM supplier_days""",
}
