"""Small helpers of the registered queries."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headroom.plans.traffic import table


def rounded(df: DataFrame, columns: Iterable[str], digits: int = 9) -> DataFrame:
    """Round doubles, whose last digits depend on the order of the arithmetic.

    The small shift, the same in the SQL checks, keeps exact halves off the rounding edge.
    """
    return df.withColumns({c: F.round(F.col(c) + F.lit(3.7 * 10 ** -(digits + 2)), digits) for c in columns})


def doubles(df: DataFrame) -> list[str]:
    return [name for name, kind in df.dtypes if kind == "double"]


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with its date."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("ds"))


def order_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with its date and an hour of the day taken from its key."""
    hour = (F.col("o_orderkey") % 24).cast("int")
    return order_days(spark, sf_dir).withColumn("ds", F.col("ds") + F.make_dt_interval(F.lit(0), hour))


def event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("ds"))


ORDER_HOURS_SQL = "order_hours AS (SELECT o_orderkey, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS ds FROM orders)"
