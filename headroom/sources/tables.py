"""Reading and writing traffic, event and prediction tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headroom import schemas
from headroom.schemas import TableError, require_columns


def _kinds(ddl: str) -> dict[str, str]:
    return dict(part.strip().rsplit(" ", 1) for part in ddl.split(","))


def read_table(spark: SparkSession, path: str, ddl: str, required: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """Read parquet or CSV, check the required columns, and cast the known ones.

    CSV columns are cast, not inferred: no extra pass over the data. Row order is not
    promised; operators order by timestamp where they need to.
    """
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    try:
        df = reader.load(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in str(missing):
            raise FileNotFoundError(f"{path} does not exist") from missing
        raise
    require_columns(df, required, path)
    kinds = _kinds(ddl)
    return df.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in df.columns])


def load_traffic(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, schemas.TRAFFIC, ["ds", "y", *schemas.TRAFFIC_FEATURES], fmt)


def load_service_traffic(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    required = ["ds", "service", "y", *schemas.TRAFFIC_FEATURES]
    return read_table(spark, path, schemas.SERVICE_TRAFFIC, required, fmt)


def _not_empty(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise TableError(f"{what} is empty.")
    return df


def load_predictions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    ddl = schemas.SERVICE_PREDICTIONS
    return _not_empty(read_table(spark, path, ddl, schemas.PREDICTION_REQUIRED, fmt), "Prediction file")


def load_model_predictions(spark: SparkSession, path: str, models: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """Predictions of several models from one table partitioned by ``model``; all have to be there."""
    df = load_predictions(spark, path, fmt)
    require_columns(df, ["model"], path)
    chosen = df.where(F.col("model").isin(list(models)))
    found = {row["model"] for row in chosen.select("model").distinct().collect()}  # at most the asked names
    missing = [name for name in models if name not in found]
    if missing:
        raise FileNotFoundError(f"Prediction rows not found for models: {missing}")
    return chosen


def load_results(spark: SparkSession, path: str, ddl: str = "ds timestamp_ntz", fmt: str = "parquet") -> DataFrame:
    """A result table as written; the columns named in ``ddl`` are cast."""
    return read_table(spark, path, ddl, [], fmt)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", by: Sequence[str] = ()) -> str:
    """Write a table, replacing it; with ``by`` only the partitions that are written."""
    writer = df.write.format(fmt).mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    if by:
        writer = writer.partitionBy(*by).option("partitionOverwriteMode", "dynamic")
    writer.save(path)
    return path


def save_traffic_tables(traffic: DataFrame, events: DataFrame, path: str, fmt: str = "parquet") -> dict[str, str]:
    """Request rate, CPU, event and model-input tables under ``path``."""
    weather = ["ds", "is_monsoon", "typhoon_index"]
    parts = {
        "request_rate": traffic.select(*weather, F.col("request_rate").alias("y")),
        "cpu_utilization": traffic.select(*weather, F.col("cpu_utilization").alias("y")),
        "events": _flat(events, fmt),
        "traffic": traffic,
    }
    return {name: write_table(df, f"{path}/{name}", fmt) for name, df in parts.items()}


def save_service_tables(traffic: DataFrame, events: DataFrame, path: str, fmt: str = "parquet") -> dict[str, str]:
    """Service traffic, partitioned by service, and its events."""
    return {
        "service_traffic": write_table(traffic, f"{path}/service_traffic", fmt, by=["service"]),
        "service_events": write_table(_flat(events, fmt), f"{path}/service_events", fmt),
    }


def _flat(events: DataFrame, fmt: str) -> DataFrame:
    """CSV has no arrays: services become comma-separated text there."""
    if fmt != "csv" or "services" not in events.columns:
        return events
    return events.withColumn("services", F.concat_ws(",", "services"))
