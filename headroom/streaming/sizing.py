"""Hourly load and pods from a stream of events, with the batch operators behind it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headroom import fixed_values as fixed
from headroom.functions.clock import ntz
from headroom.operators import decisions, sizing
from headroom.plans.traffic import service_of


def hourly_service_load(events: DataFrame, late_by: str = "2 hours") -> DataFrame:
    """Mean value per closed hour and service; events later than ``late_by`` are left out.

    The state is two numbers per open hour and service, whatever the stream carries.
    """
    services = events.select(F.col("ts").cast("timestamp").alias("ts"), service_of(F.col("event_type")).alias("service"), "value")
    hourly = (
        services.withWatermark("ts", late_by)
        .groupBy(F.window("ts", "1 hour").alias("_hour"), "service")
        .agg(F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("_cents"), F.count(F.lit(1)).alias("_events"))
    )
    mean = F.col("_cents") / F.lit(100.0) / F.col("_events")
    return hourly.select(ntz(F.col("_hour.start")).alias("ds"), "service", mean.alias("y"))


def service_pod_stream(
    events: DataFrame, policies: sizing.Policies = sizing.DEFAULT_SERVICE_POLICIES, late_by: str = "2 hours"
) -> DataFrame:
    """Pods each service needs in each closed hour."""
    return sizing.required_service_pods(hourly_service_load(events, late_by), "y", "predicted_pods", policies)


def decide_batch(
    write: Callable[[DataFrame, int], None],
    pod_budget: int = fixed.POD_BUDGET,
    policies: sizing.Policies = sizing.DEFAULT_SERVICE_POLICIES,
) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: share the budget between the services of each hour that closed.

    An hour closes for all services in the same batch, so each hour is decided once.
    """

    def decide(batch: DataFrame, number: int) -> None:
        write(decisions.share_pod_budget(batch, pod_budget, policies), number)

    return decide
