"""Scores of predictions, per model, per service or per any other key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headroom import schemas
from headroom.functions import metrics as M
from headroom.operators import ordering
from headroom.operators.sizing import (
    DEFAULT_POLICY,
    DEFAULT_SERVICE_POLICIES,
    Policies,
    PodPolicy,
    add_service_pod_columns,
    required_pods,
    with_policy,
)


def paired(actual: DataFrame, predicted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join actual to predicted one to one; a row without its partner is an error."""
    left = actual.select(*keys, "actual").withColumn("_a", F.lit(True))
    right = predicted.select(*keys, "predicted").withColumn("_p", F.lit(True))
    both = left.join(right, list(keys), "full")
    whole = F.col("_a").isNotNull() & F.col("_p").isNotNull()
    stop = F.raise_error(F.lit("actual and predicted must have the same rows"))
    return both.select(
        *keys, F.when(whole, F.col("actual")).otherwise(stop.cast("double")).alias("actual"), "predicted"
    )


def _checked(value: Column, rows: Column) -> Column:
    """The metric, or an error when it would be one of no rows."""
    return F.when(rows > 0, value).otherwise(F.raise_error(F.lit("no rows to measure")).cast("double"))


def _aggregate(df: DataFrame, by: Sequence[str], columns: dict[str, Column]) -> DataFrame:
    if by:
        return df.groupBy(*by).agg(*[c.alias(name) for name, c in columns.items()])
    counted = df.agg(F.count(F.lit(1)).alias("_rows"), *[c.alias(name) for name, c in columns.items()])
    return counted.select(*[_checked(F.col(name), F.col("_rows")).alias(name) for name in columns])


def _core(actual: str = "actual", predicted: str = "predicted") -> dict[str, Column]:
    pods = F.col("actual_pods"), F.col("predicted_pods")
    return {
        "smape": M.smape(F.col(actual), F.col(predicted)),
        "pod_accuracy": M.pod_accuracy(*pods),
        "under_provisioning_rate": M.under_provisioning_rate(*pods),
        "over_provisioning_rate": M.over_provisioning_rate(*pods),
    }


def _sized(df: DataFrame, policy: PodPolicy) -> DataFrame:
    return df.withColumns(
        {
            "actual_pods": required_pods(F.col("actual"), policy),
            "predicted_pods": required_pods(F.col("predicted"), policy),
        }
    )


def evaluate(df: DataFrame, *, by: Sequence[str] = (), policy: PodPolicy = DEFAULT_POLICY) -> DataFrame:
    """The four core metrics of rate predictions under one policy, in one aggregation."""
    schemas.require_columns(df, ["actual", "predicted", *by], "prediction frame")
    return _aggregate(_sized(df, policy), by, _core())


def with_previous_pods(
    df: DataFrame, *, series: Sequence[str], order: str = "ds", step: int | None = None, pods: str = "predicted_pods"
) -> DataFrame:
    """Add ``previous_pods``: the pod count one row earlier in the series."""
    placed = ordering.with_position(df, series=series, order=order, step=step)
    return ordering.with_lags(placed, {"previous_pods": (pods, 1)}, series=series).drop("rn", "n")


def pod_change(
    df: DataFrame, *, series: Sequence[str], order: str = "ds", step: int | None = None, pods: str = "predicted_pods"
) -> DataFrame:
    """Pod change rate per series."""
    narrow = df.select(*series, order, pods)
    lagged = with_previous_pods(narrow, series=series, order=order, step=step, pods=pods)
    return lagged.groupBy(*series).agg(M.pod_change_rate(F.col(pods), F.col("previous_pods")).alias("pod_change_rate"))


def score_card(
    df: DataFrame,
    *,
    series: Sequence[str],
    order: str = "ds",
    policy: PodPolicy = DEFAULT_POLICY,
    weights: M.ScoreWeights = M.ScoreWeights(),
    step: int | None = None,
) -> DataFrame:
    """All metrics, the penalty and the fitness per series, of predictions floored at 0."""
    schemas.require_columns(df, [*series, order, "actual", "predicted"], "prediction frame")
    floored = df.select(*series, order, "actual", F.greatest("predicted", F.lit(0.0)).alias("predicted"))
    lagged = with_previous_pods(_sized(floored, policy), series=series, order=order, step=step)
    pods = F.col("actual_pods"), F.col("predicted_pods")
    scored = _aggregate(
        lagged,
        series,
        {
            **_core(),
            "severe_under_provisioning_rate": M.severe_under_provisioning_rate(*pods),
            "pod_change_rate": M.pod_change_rate(F.col("predicted_pods"), F.col("previous_pods")),
        },
    )
    return scored.withColumn("penalty_score", M.penalty_score(weights)).withColumn(
        "combined_score", M.fitness(F.col("penalty_score"))
    )


def service_metrics(
    df: DataFrame,
    policies: Policies = DEFAULT_SERVICE_POLICIES,
    *,
    by: Sequence[str] = (),
    order: str = "ds",
    step: int | None = None,
) -> DataFrame:
    """Metrics per service under its own policy, with change rate and priority."""
    series = [*by, "service"]
    sized = add_service_pod_columns(df.select(*series, order, "actual", "predicted"), policies)
    lagged = with_policy(with_previous_pods(sized, series=series, order=order, step=step), policies)
    pods = F.col("actual_pods"), F.col("predicted_pods")
    return _aggregate(
        lagged,
        series,
        {
            **_core(),
            "severe_under_provisioning_rate": M.severe_under_provisioning_rate(*pods),
            "pod_change_rate": M.pod_change_rate(F.col("predicted_pods"), F.col("previous_pods")),
            "priority": F.max("priority"),
        },
    )


def priority_weighted_under_provisioning(
    df: DataFrame, policies: Policies = DEFAULT_SERVICE_POLICIES, *, by: Sequence[str] = ()
) -> DataFrame:
    """Under-provisioned share of rows, each weighted by one over its service's priority.

    Rows are counted per service first, so the weights enter a sum of few terms.
    """
    sized = with_policy(df.select(*by, "service", "actual_pods", "predicted_pods"), policies)
    counted = sized.groupBy(*by, "service", "priority").agg(
        F.count_if(F.col("predicted_pods") < F.col("actual_pods")).alias("_under"), F.count(F.lit(1)).alias("_rows")
    )
    weight = F.lit(1.0) / F.col("priority")
    return counted.groupBy(*by).agg(
        F.coalesce(F.try_divide(F.sum(F.col("_under") * weight), F.sum(F.col("_rows") * weight)), F.lit(0.0)).alias(
            "priority_weighted_under_provisioning_rate"
        )
    )
