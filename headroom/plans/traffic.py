"""Load history from the raw tables: the series the operators work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headroom.functions.clock import HOUR, hour_floor
from headroom.operators import enrichment, ordering
from headroom.session import settle

EVENT_SERVICE = {
    "purchase": "payment",
    "signup": "auth",
    "view": "limit_scoring",
    "click": "batch",
    "error": "admin",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def service_of(event_type: Column) -> Column:
    """The service that handles an event; a type without one is an error, not a row less."""
    pairs = [F.lit(part) for pair in EVENT_SERVICE.items() for part in pair]
    unknown = F.raise_error(F.concat(F.lit("no service handles events of type "), F.coalesce(event_type, F.lit("null"))))
    return F.coalesce(F.try_element_at(F.create_map(*pairs), event_type), unknown)


def service_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly mean event value per service on the full grid of hours, 0 where nothing happened.

    Values are summed as whole cents: the sum does not depend on the order of the rows,
    and partial sums per hour and type leave little to shuffle whatever the events weigh. The
    sums, a few rows per hour, are written once; whatever reads them, events are scanned once.
    """
    events = table(spark, sf_dir, "events")
    hourly = settle(
        events.groupBy(hour_floor(F.col("ts")).alias("ds"), "event_type")
        .agg(
            F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("_cents"),
            F.count(F.lit(1)).alias("_events"),
        )
        .select("ds", service_of(F.col("event_type")).alias("service"), "_cents", "_events")
    )
    span = hourly.agg(F.min("ds").alias("first"), F.max("ds").alias("last"))
    grid = enrichment.service_grid(enrichment.grid_between(span, HOUR), list(EVENT_SERVICE.values()))
    mean = F.col("_cents") / F.lit(100.0) / F.col("_events")
    return grid.join(hourly, ["ds", "service"], "left").select("ds", "service", F.coalesce(mean, F.lit(0.0)).alias("y"))


def enriched_service_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service traffic with calendar and (here always quiet) weather columns."""
    flat = {"is_monsoon": F.lit(0), "typhoon_index": F.lit(0.0)}
    return enrichment.with_calendar(service_traffic(spark, sf_dir)).withColumns(flat)


def with_seasonal_naive(df: DataFrame, lag: int = 24, *, step: int | None = HOUR, order: str = "ds") -> DataFrame:
    """Predict the value ``lag`` rows earlier in the same service; rows without one are dropped."""
    placed = ordering.with_position(df, series=["service"], order=order, step=step)
    lagged = ordering.with_lags(placed, {"predicted": ("y", lag)}, series=["service"])
    return lagged.where(F.col("rn") > lag).drop("rn", "n").withColumnRenamed("y", "actual")


def service_predictions(spark: SparkSession, sf_dir: str, lag: int = 24) -> DataFrame:
    return with_seasonal_naive(service_traffic(spark, sf_dir), lag).select("ds", "service", "actual", "predicted")


def model_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several simple forecasts of every service, as rows of one prediction table.

    Yesterday's value, last week's, their mean, and yesterday's with head room.
    """
    placed = ordering.with_position(service_traffic(spark, sf_dir), series=["service"], step=HOUR)
    lagged = ordering.with_lags(placed, {"_day": ("y", 24), "_week": ("y", 168)}, series=["service"])
    forecasts = {
        "day": F.col("_day"),
        "week": F.col("_week"),
        "blend": (F.col("_day") + F.col("_week")) / 2,
        "padded": F.col("_day") * 1.25,
    }
    entries = F.array(*[F.struct(F.lit(name).alias("model"), value.alias("predicted")) for name, value in forecasts.items()])
    return (
        lagged.where(F.col("rn") > 168)
        .select("ds", "service", F.col("y").alias("actual"), F.explode(entries).alias("_m"))
        .select("ds", "service", "actual", "_m.predicted", "_m.model")
    )


def supplier_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipped quantity per supplier and day: many irregular series, quantities are whole numbers."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("supplier"), F.col("l_shipdate").alias("ds"))
        .agg(F.sum("l_quantity").alias("y"))
    )


def supplier_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``supplier_days`` written once, for operators that read their input several times."""
    return settle(supplier_days(spark, sf_dir))
