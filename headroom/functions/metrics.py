"""Forecast and capacity metrics: row terms, aggregates and scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ScoreWeights:
    """Weights of the penalty score beside the under-provisioning rate, which counts fully."""

    smape: float = 0.1
    over_provisioning_rate: float = 0.2
    severe_under_provisioning_rate: float = 0.1
    pod_change_rate: float = 0.05


def _rate(condition: Column) -> Column:
    return F.avg(condition.cast("int"))


def smape(actual: Column, predicted: Column) -> Column:
    """Symmetric absolute percentage error as a ratio; rows where both are 0 count as 0."""
    middle = (F.abs(actual) + F.abs(predicted)) / 2
    return F.avg(F.when(middle != 0, F.abs(actual - predicted) / middle).otherwise(F.lit(0.0)))


def pod_accuracy(actual_pods: Column, predicted_pods: Column) -> Column:
    return _rate(actual_pods == predicted_pods)


def under_provisioning_rate(actual_pods: Column, predicted_pods: Column) -> Column:
    return _rate(predicted_pods < actual_pods)


def over_provisioning_rate(actual_pods: Column, predicted_pods: Column) -> Column:
    return _rate(predicted_pods > actual_pods)


def severe_under_provisioning_rate(actual_pods: Column, predicted_pods: Column) -> Column:
    return _rate((actual_pods - predicted_pods) > 1)


def pod_change_rate(predicted_pods: Column, previous_pods: Column) -> Column:
    """Share of rows with a predecessor whose pod count differs from it; 0 for a single row."""
    return F.coalesce(F.avg(F.when(previous_pods.isNotNull(), (predicted_pods != previous_pods).cast("int"))), F.lit(0.0))


def penalty_score(weights: ScoreWeights = ScoreWeights()) -> Column:
    """Lower-is-better penalty from the metric columns of a row."""
    return (
        F.col("under_provisioning_rate")
        + F.lit(weights.smape) * F.col("smape")
        + F.lit(weights.over_provisioning_rate) * F.col("over_provisioning_rate")
        + F.lit(weights.severe_under_provisioning_rate) * F.col("severe_under_provisioning_rate")
        + F.lit(weights.pod_change_rate) * F.col("pod_change_rate")
    )


def fitness(penalty: Column) -> Column:
    """Higher-is-better fitness; a negative penalty is an error."""
    bad = F.raise_error(F.lit("a score below 0")).cast("double")
    return F.when(penalty < 0, bad).otherwise(F.lit(1.0) / (F.lit(1.0) + penalty))


def objective_score(smape_weight: float = 0.1, over_provisioning_weight: float = 0.2) -> Column:
    """Tuning objective: under-provisioning first, then weighted error and over-provisioning."""
    if smape_weight < 0 or over_provisioning_weight < 0:
        raise ValueError("objective weights must be non-negative")
    return (
        F.col("under_provisioning_rate")
        + F.lit(smape_weight) * F.col("smape")
        + F.lit(over_provisioning_weight) * F.col("over_provisioning_rate")
    )


def objective_formula(smape_weight: float = 0.1, over_provisioning_weight: float = 0.2) -> str:
    return f"under_provisioning_rate + {smape_weight} * smape + {over_provisioning_weight} * over_provisioning_rate"
