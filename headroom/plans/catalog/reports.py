"""Report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from headroom.functions.clock import HOUR
from headroom.operators import decisions as D
from headroom.operators import reports as P
from headroom.operators import sizing as Z
from headroom.plans.catalog import sql as S
from headroom.plans.catalog.common import doubles, rounded
from headroom.plans.catalog.decisions import allocation, sized_predictions
from headroom.plans.traffic import model_predictions, service_predictions, supplier_series

MODELS = ["day", "week", "blend", "padded"]
DAYS = 3


def _supplier_actuals(spark, sf_dir):
    return supplier_series(spark, sf_dir).withColumnRenamed("y", "actual")


def peak_window(spark, sf_dir):
    return P.peak_window_start(service_predictions(spark, sf_dir), DAYS, series=["service"], step=HOUR)


def peak_window_irregular(spark, sf_dir):
    return P.peak_window_start(_supplier_actuals(spark, sf_dir), 30, series=["supplier"])


def window_slice(spark, sf_dir):
    return P.select_window(service_predictions(spark, sf_dir), DAYS, series=["service"], step=HOUR)


def common_window(spark, sf_dir):
    return P.common_window(model_predictions(spark, sf_dir), DAYS, default_model="day", series=["service"], step=HOUR)


def mismatch_spans(spark, sf_dir):
    return P.mismatch_spans(sized_predictions(spark, sf_dir), series=["service"], step=HOUR)


def daily_overview(spark, sf_dir):
    df = model_predictions(spark, sf_dir).withColumns(
        {"actual_pods": Z.required_pods(F.col("actual")), "predicted_pods": Z.required_pods(F.col("predicted"))}
    )
    out = P.daily_overview(df, MODELS)
    return rounded(out, doubles(out), 6)


def service_daily(spark, sf_dir):
    out = P.service_daily(service_predictions(spark, sf_dir))
    return rounded(out, ["actual", "predicted"], 6)


def adjusted_stack(spark, sf_dir):
    out = P.adjusted_stack(D.share_pod_budget(sized_predictions(spark, sf_dir), 14), days=7)
    return rounded(out, doubles(out), 6)


QUERIES = {
    "peak_window": peak_window,
    "peak_window_irregular": peak_window_irregular,
    "window_slice": window_slice,
    "common_window": common_window,
    "mismatch_spans": mismatch_spans,
    "daily_overview": daily_overview,
    "service_daily": service_daily,
    "adjusted_stack": adjusted_stack,
}

# --- SQL checks -----------------------------------------------------------------


def peak(source: str, key: str, days: int) -> str:
    """Best window per key: running sums of decimals, the window length from the median step."""
    return f"""placed AS (
  SELECT {key}, ds, CAST(actual AS DECIMAL(28, 9)) AS v, row_number() OVER o AS rn, count(*) OVER (PARTITION BY {key}) AS n,
    epoch_us(ds) - epoch_us(lag(ds) OVER o) AS step
  FROM {source} WINDOW o AS (PARTITION BY {key} ORDER BY ds)),
steps AS (SELECT {key}, quantile_cont(CAST(step AS DOUBLE), 0.5) AS median FROM placed GROUP BY 1),
summed AS (
  SELECT p.*, sum(v) OVER (PARTITION BY p.{key} ORDER BY rn) AS total,
    CASE WHEN n < 2 THEN 1 ELSE least(n, greatest(1, CAST(round_even(86400000000::DOUBLE / median, 0) AS BIGINT)) * {days}) END AS w
  FROM placed p JOIN steps s ON s.{key} = p.{key}),
windows AS (
  SELECT e.{key}, b.ds AS start, e.w AS window_rows, e.total - b.total + b.v AS amount, b.rn
  FROM summed e JOIN summed b ON b.{key} = e.{key} AND b.rn = e.rn - e.w + 1),
peaks AS (
  SELECT {key}, start, CAST(window_rows AS BIGINT) AS window_rows FROM (
    SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY amount DESC, rn) AS k FROM windows) WHERE k = 1)"""


def _stack(column: str) -> str:
    return f"sum({column}) OVER (PARTITION BY day ORDER BY position)"


ORACLE = {
    "peak_window": f"WITH {S.PREDICTIONS}, {peak('predictions', 'service', DAYS)} SELECT * FROM peaks",
    "peak_window_irregular": f"""WITH {S.SUPPLIER_DAYS}, actuals AS (SELECT supplier, ds, y AS actual FROM supplier_days),
        {peak('actuals', 'supplier', 30)} SELECT * FROM peaks""",
    "window_slice": f"""WITH {S.PREDICTIONS}, {peak('predictions', 'service', DAYS)}
        SELECT p.* FROM predictions p JOIN peaks k ON k.service = p.service AND p.ds >= start AND p.ds < start + INTERVAL {DAYS} DAY""",
    "common_window": f"""WITH {S.MODELS}, chosen AS (SELECT * FROM models WHERE model = 'day'), {peak('chosen', 'service', DAYS)}
        SELECT p.ds, p.service, p.actual, p.model, p.predicted
        FROM models p JOIN peaks k ON k.service = p.service AND p.ds >= start AND p.ds < start + INTERVAL {DAYS} DAY""",
    "mismatch_spans": f"""WITH {S.SIZED}, ahead AS (
          SELECT *, lead(ds) OVER w AS next, first_value(ds) OVER w AS d1, nth_value(ds, 2) OVER
            (PARTITION BY service ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS d2
          FROM sized WINDOW w AS (PARTITION BY service ORDER BY ds))
        SELECT service, ds AS start, coalesce(next, ds + coalesce(d2 - d1, INTERVAL 1 HOUR)) AS "end", actual_pods, predicted_pods,
          CASE WHEN predicted_pods < actual_pods THEN 'under' ELSE 'over' END AS kind
        FROM ahead WHERE predicted_pods <> actual_pods""",
    "daily_overview": f"""WITH {S.MODELS}, spine AS (
          SELECT unnest(generate_series(date_trunc('day', min(ds))::TIMESTAMP, date_trunc('day', max(ds))::TIMESTAMP, INTERVAL 1 DAY)) AS day FROM models)
        SELECT s.day AS ds, {S.rounded("avg(CASE WHEN model = 'day' THEN actual END)", 6)} AS actual,
          {S.rounded("avg(CASE WHEN model = 'day' THEN actual_pods END)", 6)} AS actual_pods, """
    + ", ".join(
        f"{S.rounded(f'''avg(CASE WHEN model = '{m}' THEN predicted END)''', 6)} AS {m}, "
        f"{S.rounded(f'''avg(CASE WHEN model = '{m}' THEN predicted_pods END)''', 6)} AS {m}_pods"
        for m in MODELS
    )
    + " FROM spine s LEFT JOIN model_pods p ON date_trunc('day', p.ds) = s.day GROUP BY 1",
    "service_daily": f"""WITH {S.PREDICTIONS}, spine AS (
          SELECT service, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS day FROM (
            SELECT service, date_trunc('day', min(ds)) AS lo, date_trunc('day', max(ds)) AS hi FROM predictions GROUP BY 1))
        SELECT s.service, s.day AS ds, {S.rounded('avg(actual)', 6)} AS actual, {S.rounded('avg(predicted)', 6)} AS predicted
        FROM spine s LEFT JOIN predictions p ON p.service = s.service AND date_trunc('day', p.ds) = s.day GROUP BY 1, 2""",
    "adjusted_stack": f"""WITH {allocation(14)}, early AS (
          SELECT * FROM decisions WHERE ds < (SELECT min(ds) FROM decisions) + INTERVAL 7 DAY),
        daily AS (SELECT service, date_trunc('day', ds) AS day, avg(predicted_pods) AS predicted_pods,
                    avg(onprem_adjusted_pods) AS onprem_adjusted_pods FROM early GROUP BY 1, 2),
        every AS (SELECT day, service, position FROM (SELECT DISTINCT day FROM daily)
                  CROSS JOIN (VALUES ('payment', 1), ('auth', 2), ('limit_scoring', 3), ('batch', 4), ('admin', 5)) AS t(service, position)),
        filled AS (SELECT e.*, coalesce(predicted_pods, 0) AS predicted_pods, coalesce(onprem_adjusted_pods, 0) AS onprem_adjusted_pods
                   FROM every e LEFT JOIN daily d ON d.day = e.day AND d.service = e.service)
        SELECT day AS ds, service, position, {S.rounded('predicted_pods', 6)} AS predicted_pods,
          {S.rounded('onprem_adjusted_pods', 6)} AS onprem_adjusted_pods,
          {S.rounded(_stack('predicted_pods'), 6)} AS requested_stack, {S.rounded(_stack('onprem_adjusted_pods'), 6)} AS adjusted_stack
        FROM filled""",
}
