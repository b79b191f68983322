"""Shared pieces of the SQL checks."""

from __future__ import annotations

from headroom import fixed_values as fixed
from headroom.plans.traffic import EVENT_SERVICE


def number(value: float) -> str:
    return f"CAST({value!r} AS DOUBLE)"


def rounded(expression: str, digits: int = 9) -> str:
    """Rounded after the same small shift as in the queries."""
    return f"round(({expression}) + CAST({3.7 * 10 ** -(digits + 2)!r} AS DOUBLE), {digits})"


def mapping(key: str, values: dict[str, float]) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {number(v)}" for k, v in values.items())
    return f"CASE {key} {whens} END"


SERVICES = "(SELECT unnest([" + ", ".join(f"'{s}'" for s in EVENT_SERVICE.values()) + "]) AS service)"

_SERVICE_OF = "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{s}'" for e, s in EVENT_SERVICE.items()) + " END"

TRAFFIC = f"""
events_hourly AS (
  SELECT date_trunc('hour', ts) AS ds, {_SERVICE_OF} AS service,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) AS cents, CAST(count(*) AS DOUBLE) AS seen
  FROM events GROUP BY 1, 2),
hours AS (
  SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ds
  FROM (SELECT date_trunc('hour', min(ts)) AS lo, date_trunc('hour', max(ts)) AS hi FROM events)),
traffic AS (
  SELECT h.ds, s.service, coalesce(cents / CAST(100 AS DOUBLE) / seen, CAST(0 AS DOUBLE)) AS y
  FROM hours h CROSS JOIN {SERVICES} s LEFT JOIN events_hourly e ON e.ds = h.ds AND e.service = s.service)"""

POLICIES = (
    "policies AS (SELECT *, capacity * (CAST(1 AS DOUBLE) - margin) AS effective FROM (VALUES "
    + ", ".join(
        f"('{s}', {number(c)}, {number(m)}, {lo}, {hi}, {p}, '{pool}', {node})"
        for s, (c, m, lo, hi, p, pool, node) in fixed.SERVICE_POLICIES.items()
    )
    + ") AS t(service, capacity, margin, min_pods, max_pods, priority, node_pool, node_pod_capacity))"
)

# Yesterday's value as the forecast, and its pods under the service policies.
PREDICTIONS = f"""{TRAFFIC},
predictions AS (
  SELECT * FROM (
    SELECT ds, service, y AS actual, lag(y, 24) OVER (PARTITION BY service ORDER BY ds) AS predicted FROM traffic)
  WHERE predicted IS NOT NULL)"""


def pods(rate: str, effective: str = "effective", low: str = "min_pods", high: str = "max_pods") -> str:
    load = f"greatest({rate}, CAST(0 AS DOUBLE)) / {effective}"
    return f"CAST(greatest(ceil(least({load}, CAST({high} AS DOUBLE))), {low}) AS INTEGER)"


DEFAULT_EFFECTIVE = "(CAST(21.1 AS DOUBLE) * (CAST(1 AS DOUBLE) - CAST(0.2 AS DOUBLE)))"


def default_pods(rate: str) -> str:
    return pods(rate, DEFAULT_EFFECTIVE, "1", "8")


SIZED = f"""{PREDICTIONS}, {POLICIES},
sized AS (
  SELECT ds, p.service, actual, predicted, {pods('actual')} AS actual_pods, {pods('predicted')} AS predicted_pods,
         priority, min_pods, node_pool, node_pod_capacity
  FROM predictions p JOIN policies USING (service))"""

# Four simple forecasts per service.
MODELS = f"""{TRAFFIC},
lagged AS (
  SELECT ds, service, y, lag(y, 24) OVER w AS day, lag(y, 168) OVER w AS week
  FROM traffic WINDOW w AS (PARTITION BY service ORDER BY ds)),
models AS (
  SELECT ds, service, y AS actual, 'day' AS model, day AS predicted FROM lagged WHERE week IS NOT NULL
  UNION ALL SELECT ds, service, y, 'week', week FROM lagged WHERE week IS NOT NULL
  UNION ALL SELECT ds, service, y, 'blend', (day + week) / 2 FROM lagged WHERE week IS NOT NULL
  UNION ALL SELECT ds, service, y, 'padded', day * CAST(1.25 AS DOUBLE) FROM lagged WHERE week IS NOT NULL),
model_pods AS (
  SELECT *, {default_pods('actual')} AS actual_pods, {default_pods('predicted')} AS predicted_pods FROM models)"""

SUPPLIER_DAYS = """
supplier_days AS (
  SELECT l_suppkey AS supplier, l_shipdate AS ds, sum(l_quantity) AS y FROM lineitem GROUP BY 1, 2)"""


def smape(actual: str = "actual", predicted: str = "predicted") -> str:
    middle = f"(abs({actual}) + abs({predicted})) / 2"
    return f"avg(CASE WHEN {middle} <> 0 THEN abs({actual} - {predicted}) / ({middle}) ELSE CAST(0 AS DOUBLE) END)"


def rate(condition: str) -> str:
    return f"avg(CASE WHEN {condition} THEN 1 ELSE 0 END)"


CORE = f"""{rounded(smape(), 6)} AS smape,
       {rounded(rate('predicted_pods = actual_pods'), 6)} AS pod_accuracy,
       {rounded(rate('predicted_pods < actual_pods'), 6)} AS under_provisioning_rate,
       {rounded(rate('predicted_pods > actual_pods'), 6)} AS over_provisioning_rate"""
