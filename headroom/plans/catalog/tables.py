"""Source and sink queries: written to a folder of their own and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from headroom.operators import enrichment as E
from headroom.operators import sizing as Z
from headroom.plans.catalog import calendar
from headroom.plans.catalog import sql as S
from headroom.plans.catalog.common import order_hours
from headroom.plans.traffic import model_predictions, service_traffic
from headroom.session import scratch_path
from headroom.sources import results, tables

MODELS = ["blend", "day"]


def load_traffic(spark, sf_dir):
    """Model input through CSV: text and back gives the same numbers."""
    df = calendar.model_input(spark, sf_dir)
    events = E.event_calendar(E.years_of(order_hours(spark, sf_dir)))
    paths = tables.save_traffic_tables(df, events, scratch_path(spark, "traffic"), "csv")
    return tables.load_traffic(spark, paths["traffic"], "csv").withColumn("o_orderkey", F.col("o_orderkey").cast("bigint"))


def load_service_traffic(spark, sf_dir):
    """Service table through parquet, partitioned by service."""
    df = calendar.service_table(spark, sf_dir)
    events = E.with_event_services(E.event_calendar(E.years_of(order_hours(spark, sf_dir))))
    paths = tables.save_service_tables(df, events, scratch_path(spark, "services"))
    return tables.load_service_traffic(spark, paths["service_traffic"])


def load_predictions(spark, sf_dir):
    """Predictions of several models in one table partitioned by model, two of them read."""
    sized = model_predictions(spark, sf_dir).withColumns(
        {"actual_pods": Z.required_pods(F.col("actual")), "predicted_pods": Z.required_pods(F.col("predicted"))}
    )
    path = tables.write_table(sized, scratch_path(spark, "predictions"), by=["model"])
    return tables.load_model_predictions(spark, path, MODELS)


def load_results(spark, sf_dir):
    """Service traffic as a CSV result table."""
    path = tables.write_table(service_traffic(spark, sf_dir), scratch_path(spark, "results"), "csv")
    return tables.load_results(spark, path, "ds timestamp_ntz, service string, y double", "csv")


def load_model_metrics(spark, sf_dir):
    """Metric records of two models, written as JSON and read in the order asked for."""
    path = scratch_path(spark, "metrics")
    predictions = model_predictions(spark, sf_dir)
    for name in MODELS:
        results.save_model_outputs(name, predictions.where(F.col("model") == name), path)
    read = results.load_model_metrics(spark, path, MODELS)
    return read.select("model", "ordinal", *[F.round(F.col(m) + F.lit(3.7e-8), 6).alias(m) for m in results.METRIC_COLUMNS])


QUERIES = {
    "load_traffic": load_traffic,
    "load_service_traffic": load_service_traffic,
    "load_predictions": load_predictions,
    "load_results": load_results,
    "load_model_metrics": load_model_metrics,
}

ORACLE = {
    "load_traffic": calendar.ORACLE["model_input"],
    "load_service_traffic": calendar.ORACLE["service_table"],
    "load_predictions": f"""WITH {S.MODELS}
        SELECT ds, service, actual, predicted, actual_pods, predicted_pods, model FROM model_pods WHERE model IN ('blend', 'day')""",
    "load_results": f"WITH {S.TRAFFIC} SELECT ds, service, y FROM traffic",
    "load_model_metrics": f"""WITH {S.MODELS}, measured AS (SELECT model, {S.CORE} FROM model_pods GROUP BY 1)
        SELECT model, CASE model WHEN 'blend' THEN 0 ELSE 1 END AS ordinal, smape, pod_accuracy, under_provisioning_rate,
          over_provisioning_rate FROM measured WHERE model IN ('blend', 'day')""",
}
