"""Table schemas and the column checks shared by all readers and operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

TIMESTAMP = "ds"
TARGET = "y"
SERVICE = "service"

# Column names of the exchanged tables.
TRAFFIC_FEATURES = ["is_monsoon", "typhoon_index", "hour", "day_of_week", "month"]
PREDICTION_REQUIRED = ["ds", "actual", "predicted", "actual_pods", "predicted_pods"]
METRIC_COLUMNS = ["smape", "pod_accuracy", "under_provisioning_rate", "over_provisioning_rate"]


# Schemas are DDL strings: readers take them as they are and they need no running session.
TRAFFIC = (
    "ds timestamp_ntz, is_monsoon int, typhoon_index double, request_rate double, cpu_utilization double, "
    "hour int, day_of_week int, month int, y double"
)
SERVICE_TRAFFIC = (
    "ds timestamp_ntz, service string, is_monsoon int, typhoon_index double, crop_activity_score double, "
    "request_rate double, cpu_utilization double, p95_latency double, queue_depth double, error_rate double, "
    "db_connection_usage double, business_event string, hour int, day_of_week int, month int, y double"
)
PREDICTIONS = (
    "ds timestamp_ntz, actual double, predicted double, actual_pods int, predicted_pods int, model string"
)
SERVICE_PREDICTIONS = (
    "ds timestamp_ntz, actual double, predicted double, service string, model string, "
    "actual_pods int, predicted_pods int"
)
POLICY = (
    "capacity_per_pod double, safety_margin double, min_pods int, max_pods int, priority int, "
    "node_pool string, node_pod_capacity int"
)
SERVICE_POLICY = f"service string, {POLICY}"
PARAMETERS = ("param string, shape array<int>, values array<double>")


class TableError(ValueError):
    """A table does not have the columns, rows or values an operator needs."""


def require_columns(df: DataFrame, required: Iterable[str], what: str) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise TableError(f"{what} is missing required columns: {missing}")
    return df
