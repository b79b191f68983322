"""Sizing and metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from headroom.functions import metrics as M
from headroom.functions.clock import HOUR
from headroom.operators import evaluation as V
from headroom.operators import ordering
from headroom.operators import sizing as Z
from headroom.plans.catalog import sql as S
from headroom.plans.catalog.common import doubles, rounded
from headroom.plans.traffic import (
    model_predictions,
    service_predictions,
    service_traffic,
    supplier_series,
    table,
)
from headroom.session import settle


def line_predictions(spark, sf_dir):
    """Every order line: the ordered quantity, and a guess that is off by discount and tax."""
    guess = F.col("l_quantity") * (F.lit(1.0) - 4 * F.col("l_discount")) * (F.lit(1.0) + F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("supplier"), F.col("l_quantity").alias("actual"), guess.alias("predicted")
    )


def line_pods(spark, sf_dir):
    return line_predictions(spark, sf_dir).withColumns(
        {"actual_pods": Z.required_pods(F.col("actual")), "predicted_pods": Z.required_pods(F.col("predicted"))}
    )


def _line_metric(name: str, value):
    def query(spark, sf_dir):
        return rounded(line_pods(spark, sf_dir).groupBy("supplier").agg(value().alias(name)), [name], 6)

    return query


def _pods():
    return F.col("actual_pods"), F.col("predicted_pods")


def supplier_naive(spark, sf_dir):
    """Supplier days with the value of the row before as the forecast."""
    days = supplier_series(spark, sf_dir)
    placed = ordering.with_position(days, series=["supplier"])
    lagged = ordering.with_lags(placed, {"predicted": ("y", 1)}, series=["supplier"])
    return lagged.where(F.col("rn") > 1).select("supplier", "ds", F.col("y").alias("actual"), "predicted")


def pod_change(spark, sf_dir):
    days = supplier_series(spark, sf_dir).withColumn("predicted_pods", Z.required_pods(F.col("y")))
    return rounded(V.pod_change(days, series=["supplier"]), ["pod_change_rate"], 6)


def supplier_score_card(spark, sf_dir):
    df = V.score_card(settle(supplier_naive(spark, sf_dir)), series=["supplier"])
    return rounded(df, doubles(df), 6)


def model_score_card(spark, sf_dir):
    return V.score_card(model_predictions(spark, sf_dir), series=["model", "service"], step=HOUR)


def _of_score_card(name: str, value):
    def query(spark, sf_dir):
        df = model_score_card(spark, sf_dir).select("model", "service", value().alias(name))
        return rounded(df, [name], 6)

    return query


def evaluate(spark, sf_dir):
    df = V.evaluate(line_predictions(spark, sf_dir), by=["supplier"])
    return rounded(df, doubles(df), 6)


def evaluate_all(spark, sf_dir):
    df = V.evaluate(line_predictions(spark, sf_dir))
    return rounded(df, doubles(df), 6)


def service_pods(spark, sf_dir):
    return Z.required_service_pods(service_traffic(spark, sf_dir), "y")


def service_metrics(spark, sf_dir):
    df = V.service_metrics(service_predictions(spark, sf_dir), step=HOUR)
    return rounded(df, doubles(df), 6)


def weighted_under(spark, sf_dir):
    sized = Z.add_service_pod_columns(service_predictions(spark, sf_dir))
    return rounded(V.priority_weighted_under_provisioning(sized), ["priority_weighted_under_provisioning_rate"], 6)


def paired(spark, sf_dir):
    both = service_predictions(spark, sf_dir)
    return V.paired(both.drop("predicted"), both.drop("actual"), ["ds", "service"])


QUERIES = {
    "required_pods": lambda spark, sf: table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", Z.required_pods(F.col("l_quantity") * 3).alias("pods")
    ),
    "service_pods": service_pods,
    "service_pod_columns": lambda spark, sf: Z.add_service_pod_columns(service_predictions(spark, sf)),
    "paired": paired,
    "smape": _line_metric("smape", lambda: M.smape(F.col("actual"), F.col("predicted"))),
    "pod_accuracy": _line_metric("pod_accuracy", lambda: M.pod_accuracy(*_pods())),
    "under_rate": _line_metric("under_provisioning_rate", lambda: M.under_provisioning_rate(*_pods())),
    "over_rate": _line_metric("over_provisioning_rate", lambda: M.over_provisioning_rate(*_pods())),
    "severe_under": _line_metric("severe_under_provisioning_rate", lambda: M.severe_under_provisioning_rate(*_pods())),
    "evaluate": evaluate,
    "evaluate_all": evaluate_all,
    "pod_change": pod_change,
    "score_card": supplier_score_card,
    "penalty": _of_score_card("penalty_score", lambda: F.col("penalty_score")),
    "fitness": _of_score_card("combined_score", lambda: F.col("combined_score")),
    "objective": _of_score_card("objective_score", lambda: M.objective_score()),
    "service_metrics": service_metrics,
    "weighted_under": weighted_under,
}

# --- SQL checks -----------------------------------------------------------------

_LINES = f"""lines AS (
  SELECT l_suppkey AS supplier, l_quantity AS actual,
         l_quantity * (CAST(1 AS DOUBLE) - 4 * l_discount) * (CAST(1 AS DOUBLE) + l_tax) AS predicted FROM lineitem),
line_pods AS (SELECT *, {S.default_pods('actual')} AS actual_pods, {S.default_pods('predicted')} AS predicted_pods FROM lines)"""


def _line_sql(name: str, value: str) -> str:
    return f"WITH {_LINES} SELECT supplier, {S.rounded(value, 6)} AS {name} FROM line_pods GROUP BY 1"


_SEVERE = S.rate("actual_pods - predicted_pods > 1")
_CHANGE = "coalesce(avg(CASE WHEN before IS NOT NULL THEN CASE WHEN predicted_pods <> before THEN 1 ELSE 0 END END), 0)"


def _card(source: str, key: str) -> str:
    """Unrounded metrics per key of a table with ds, actual and predicted."""
    return f"""floored AS (SELECT {key}, ds, actual, greatest(predicted, CAST(0 AS DOUBLE)) AS predicted FROM {source}),
counted AS (SELECT *, {S.default_pods('actual')} AS actual_pods, {S.default_pods('predicted')} AS predicted_pods FROM floored),
followed AS (SELECT *, lag(predicted_pods) OVER (PARTITION BY {key} ORDER BY ds) AS before FROM counted),
metrics AS (
  SELECT {key}, {S.smape()} AS smape, {S.rate('predicted_pods = actual_pods')} AS pod_accuracy,
    {S.rate('predicted_pods < actual_pods')} AS under_provisioning_rate,
    {S.rate('predicted_pods > actual_pods')} AS over_provisioning_rate,
    {_SEVERE} AS severe_under_provisioning_rate, {_CHANGE} AS pod_change_rate FROM followed GROUP BY {key}),
card AS (
  SELECT *, under_provisioning_rate + 0.1::DOUBLE * smape + 0.2::DOUBLE * over_provisioning_rate
    + 0.1::DOUBLE * severe_under_provisioning_rate + 0.05::DOUBLE * pod_change_rate AS penalty_score,
    under_provisioning_rate + 0.1::DOUBLE * smape + 0.2::DOUBLE * over_provisioning_rate AS objective_score FROM metrics)"""


_NAIVE = f"""{S.SUPPLIER_DAYS}, naive AS (SELECT * FROM (
  SELECT supplier, ds, y AS actual, lag(y) OVER (PARTITION BY supplier ORDER BY ds) AS predicted FROM supplier_days)
  WHERE predicted IS NOT NULL)"""

_CARD_COLUMNS = [
    "smape",
    "pod_accuracy",
    "under_provisioning_rate",
    "over_provisioning_rate",
    "severe_under_provisioning_rate",
    "pod_change_rate",
    "penalty_score",
]
_MODEL_CARD = f"{S.MODELS}, {_card('models', 'model, service')}"

ORACLE = {
    "required_pods": f"SELECT l_orderkey, l_linenumber, {S.default_pods('l_quantity * 3')} AS pods FROM lineitem",
    "service_pods": f"WITH {S.TRAFFIC}, {S.POLICIES} SELECT ds, service, y, {S.pods('y')} AS pods FROM traffic JOIN policies USING (service)",
    "service_pod_columns": f"WITH {S.SIZED} SELECT ds, service, actual, predicted, actual_pods, predicted_pods FROM sized",
    "paired": f"WITH {S.PREDICTIONS} SELECT ds, service, actual, predicted FROM predictions",
    "smape": _line_sql("smape", S.smape()),
    "pod_accuracy": _line_sql("pod_accuracy", S.rate("predicted_pods = actual_pods")),
    "under_rate": _line_sql("under_provisioning_rate", S.rate("predicted_pods < actual_pods")),
    "over_rate": _line_sql("over_provisioning_rate", S.rate("predicted_pods > actual_pods")),
    "severe_under": _line_sql("severe_under_provisioning_rate", _SEVERE),
    "evaluate": f"WITH {_LINES} SELECT supplier, {S.CORE} FROM line_pods GROUP BY 1",
    "evaluate_all": f"WITH {_LINES} SELECT {S.CORE} FROM line_pods",
    "pod_change": f"""WITH {S.SUPPLIER_DAYS}, sized AS (SELECT supplier, ds, {S.default_pods('y')} AS predicted_pods FROM supplier_days),
        followed AS (SELECT *, lag(predicted_pods) OVER (PARTITION BY supplier ORDER BY ds) AS before FROM sized)
        SELECT supplier, {S.rounded(_CHANGE, 6)} AS pod_change_rate FROM followed GROUP BY 1""",
    "score_card": f"WITH {_NAIVE}, {_card('naive', 'supplier')} SELECT supplier, "
    + ", ".join(f"{S.rounded(c, 6)} AS {c}" for c in _CARD_COLUMNS)
    + f", {S.rounded('1 / (1 + penalty_score)', 6)} AS combined_score FROM card",
    "penalty": f"WITH {_MODEL_CARD} SELECT model, service, {S.rounded('penalty_score', 6)} AS penalty_score FROM card",
    "fitness": f"WITH {_MODEL_CARD} SELECT model, service, {S.rounded('1 / (1 + penalty_score)', 6)} AS combined_score FROM card",
    "objective": f"WITH {_MODEL_CARD} SELECT model, service, {S.rounded('objective_score', 6)} AS objective_score FROM card",
    "service_metrics": f"""WITH {S.SIZED},
        followed AS (SELECT *, lag(predicted_pods) OVER (PARTITION BY service ORDER BY ds) AS before FROM sized)
        SELECT service, {S.CORE}, {S.rounded(_SEVERE, 6)} AS severe_under_provisioning_rate,
          {S.rounded(_CHANGE, 6)} AS pod_change_rate, max(priority) AS priority FROM followed GROUP BY 1""",
    "weighted_under": f"""WITH {S.SIZED} SELECT {S.rounded(
        'sum(CASE WHEN predicted_pods < actual_pods THEN 1::DOUBLE / priority ELSE 0 END) / sum(1::DOUBLE / priority)', 6)}
        AS priority_weighted_under_provisioning_rate FROM sized""",
}
