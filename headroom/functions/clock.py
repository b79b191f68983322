"""Time as integers, without the session time zone where the column has none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECOND = 1_000_000
HOUR = 3600 * SECOND
DAY = 24 * HOUR


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, read off its fields."""
    days = F.datediff(ts, F.lit("1970-01-01").cast("date")).cast("bigint")
    minutes = (F.hour(ts) * 60 + F.minute(ts)).cast("bigint")
    fraction = (F.extract(F.lit("SECOND"), ts) * SECOND).cast("bigint")
    return days * DAY + minutes * (60 * SECOND) + fraction


def order_value(df: DataFrame, column: str) -> Column:
    """A bigint that sorts like ``column`` (a timestamp, a date or a whole number)."""
    kind = df.schema[column].dataType
    col = F.col(column)
    if isinstance(kind, T.TimestampNTZType):
        return micros(col)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col)
    if isinstance(kind, T.DateType):
        return F.unix_date(col) * F.lit(DAY)
    if isinstance(kind, T.IntegralType):
        return col.cast("bigint")
    raise TypeError(f"cannot order by {column}: {kind.simpleString()}")


def ntz(col: Column) -> Column:
    return col.cast("timestamp_ntz")


def day_floor(ts: Column) -> Column:
    """Start of the day, without a detour through the session time zone."""
    return ntz(F.to_date(ts))


def hour_floor(ts: Column) -> Column:
    return day_floor(ts) + F.make_dt_interval(F.lit(0), F.hour(ts))


def plus_micros(origin: Column, micros: Column) -> Column:
    """Add whole microseconds; seconds stay exact as a decimal."""
    days = F.floor(micros / F.lit(float(DAY))).cast("int")
    rest = (micros - days.cast("bigint") * DAY).cast("decimal(20,0)") / F.lit(SECOND).cast("decimal(10,0)")
    return ntz(origin + F.make_dt_interval(days, F.lit(0), F.lit(0), rest.cast("decimal(18,6)")))
