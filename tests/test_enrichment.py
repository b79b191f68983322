from __future__ import annotations

import math
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from headroom import fixed_values as fixed
from headroom.functions import calendar as C
from headroom.functions.clock import DAY, HOUR, SECOND
from headroom.operators import enrichment as E


def at(spark, *moments):
    return spark.createDataFrame([(m,) for m in moments], "ds string").withColumn("ds", F.col("ds").cast("timestamp_ntz"))


def test_time_grid(spark):
    grid = E.time_grid(spark, datetime(2024, 1, 1), datetime(2024, 1, 2, 23), HOUR)
    rows = [r["ds"] for r in grid.orderBy("ds").collect()]
    assert len(rows) == 48 and rows[0] == datetime(2024, 1, 1) and rows[-1] == datetime(2024, 1, 2, 23)
    odd = E.time_grid(spark, datetime(2024, 2, 28, 12), datetime(2024, 3, 1), 7 * HOUR + SECOND // 4)
    assert [r["ds"] for r in odd.orderBy("ds").collect()][2] == datetime(2024, 2, 29, 2, 0, 0, 500000)
    with pytest.raises(ValueError, match="lies before the first"):
        E.time_grid(spark, datetime(2024, 1, 2), datetime(2024, 1, 1), HOUR)
    with pytest.raises(ValueError, match="divide a day"):
        E.grid_between(spark.range(1), DAY - 1)


def test_monsoon_ends_at_its_last_full_hour(spark):
    df = at(spark, "2024-06-24 23:59:59", "2024-06-25 00:00:00", "2024-07-25 23:00:00", "2024-07-25 23:30:00")
    assert [r[0] for r in df.select(C.monsoon_flag(F.col("ds"))).collect()] == [0, 1, 1, 0]


def test_overlapping_storms_keep_the_higher_index(spark):
    landfalls = spark.createDataFrame([(date(2024, 8, 10),), (date(2024, 8, 11),)], "date date")
    df = at(spark, *[f"2024-08-{d:02d} 05:00:00" for d in range(8, 16)])
    found = [r["typhoon_index"] for r in E.with_storm_index(df, landfalls).orderBy("ds").collect()]
    assert found == [0.0, 0.1, 0.9, 0.9, 0.7, 0.3, 0.1, 0.0]


def test_overlapping_events_multiply(spark):
    years = spark.createDataFrame([(2024,)], "year int")
    scenarios = [*fixed.YEARLY_EVENTS, ("extra", (3, 20), (3, 21), 1.5, None, None)]
    events = E.event_calendar(years, scenarios)
    df = at(spark, "2024-03-09 23:00:00", "2024-03-20 23:00:00", "2024-03-20 23:30:00", "2024-07-10 00:00:00")
    plain = [r["event_boost"] for r in E.with_event_boost(df, events).orderBy("ds").collect()]
    assert plain == pytest.approx([1.0, 2.1, 1.5, 1.0])
    drawn = [r["event_boost"] for r in E.with_event_boost(df, events, draw=F.lit(0.75)).orderBy("ds").collect()]
    assert drawn == pytest.approx([1.0, 2.1, 1.5, 1.25])


def _boost(events, ds, draw):
    product = 1.0
    for start, end, multiplier, lo, hi in events:
        if start <= ds <= end:
            product *= multiplier if multiplier is not None else lo + (hi - lo) * draw if draw is not None and lo is not None else 1.0
    return product


@pytest.mark.parametrize("few", [16, 1])
def test_many_overlapping_events_equal_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(E, "_FEW_FACTORS", few)
    rng, origin = random.Random(few), datetime(2024, 2, 28, 20)
    moments = [origin + timedelta(minutes=rng.randrange(5000)) for _ in range(80)]
    events = []
    for _ in range(150):
        start = rng.choice(moments)
        end = start + timedelta(minutes=rng.choice([-5, 0, 1, 600, 3000]))
        kind = rng.randrange(4)
        multiplier = [rng.choice([0.5, 1.1, 0.0, -2.0]), rng.uniform(0.8, 1.2), None, None][kind]
        events.append((start, end, multiplier, *((0.9, 1.3) if kind == 2 else (None, None))))
    table = spark.createDataFrame([("x", *e) for e in events], "scenario string, start timestamp_ntz, end timestamp_ntz, multiplier double, multiplier_lo double, multiplier_hi double")
    times = [*moments, *[m + timedelta(minutes=rng.choice([1, 600, 601])) for m in moments], None]
    rows = spark.createDataFrame([(i, t, rng.choice([0.25, 0.75, None])) for i, t in enumerate(times)], "id int, ds timestamp_ntz, luck double")
    for draw in (None, F.col("luck")):
        found = E.with_event_boost(rows, table, draw=draw).collect()
        assert len(found) == len(times)
        for r in found:
            expected = 1.0 if r["ds"] is None else _boost(events, r["ds"], r["luck"] if draw is not None else None)
            assert r["event_boost"] == pytest.approx(expected, rel=1e-12, abs=1e-300)


def test_a_hundred_thousand_events_in_a_day(spark):
    """All overlap at noon; every one begins at a second of its own or shared, and has one of 1,000 multipliers."""
    events = spark.range(100_000).select(
        F.lit("x").alias("scenario"),
        F.expr("timestamp_ntz'2024-05-01 00:00:00' + make_dt_interval(0, 0, 0, id % 40000)").alias("start"),
        F.expr("timestamp_ntz'2024-05-01 23:59:59' - make_dt_interval(0, 0, 0, id % 40000)").alias("end"),
        F.exp((F.col("id") % 1000 - 499.5) * 1e-6).alias("multiplier"),
        *[F.lit(None).cast("double").alias(f"multiplier_{c}") for c in ("lo", "hi")],
    )
    df = at(spark, "2024-05-01 00:00:00", "2024-05-01 06:00:00", "2024-05-01 12:00:00", "2024-05-02 00:00:00")
    found = [r["event_boost"] for r in E.with_event_boost(df, events).orderBy("ds").collect()]
    logs = [sum((i % 1000 - 499.5) * 1e-6 for i in range(100_000) if i % 40_000 <= t and 86_399 - i % 40_000 >= t) for t in (0, 21_600, 43_200)]
    assert found == pytest.approx([*map(math.exp, logs), 1.0], rel=1e-12)


def test_event_services(spark):
    events = E.with_event_services(E.event_calendar(spark.createDataFrame([(2024,)], "year int")))
    assert {tuple(r["services"]) for r in events.collect()} == {tuple(fixed.SERVICES)}


def test_unknown_service_is_an_error(spark):
    df = at(spark, "2024-01-01 00:00:00").withColumn("service", F.lit("other"))
    for rule in (C.service_hour_weight(F.col("service"), F.col("ds")), C.business_event(F.col("service"), F.col("ds"))):
        with pytest.raises(Exception, match="unknown service: other"):
            df.select(rule).collect()


def _service_table(spark, start, end):
    grid = E.time_grid(spark, start, end, HOUR)
    landfalls = spark.createDataFrame([], "date date")
    return E.service_table(grid, landfalls, E.event_calendar(E.years_of(grid)))


def test_service_table_schema_and_size(spark):
    df = _service_table(spark, datetime(2024, 1, 1), datetime(2024, 1, 2, 23))
    assert df.columns == E.SERVICE_TABLE_COLUMNS
    assert df.count() == 48 * 5 and {r[0] for r in df.select("service").distinct().collect()} == set(fixed.SERVICES)


def test_day_25_is_a_repayment_day(spark):
    df = _service_table(spark, datetime(2024, 1, 25), datetime(2024, 1, 25, 23))
    assert {r[0] for r in df.where("service = 'payment'").select("business_event").distinct().collect()} == {"repayment_day"}


def test_last_assigned_label_wins(spark):
    df = at(spark, "2024-03-15 02:00:00", "2024-01-27 02:00:00", "2024-01-27 10:00:00")
    labels = E.service_grid(df).withColumn("label", C.business_event(F.col("service"), F.col("ds"))).collect()
    found = {(r["ds"].month, r["ds"].hour, r["service"]): r["label"] for r in labels}
    assert found[(3, 2, "payment")] == "spring_purchase_payment_spike"
    assert found[(3, 2, "limit_scoring")] == "spring_credit_limit_spike"
    assert found[(1, 2, "batch")] == "nightly_batch" and found[(1, 10, "batch")] == "month_end_batch"
    assert found[(1, 10, "admin")] == "business_hours" and found[(1, 2, "admin")] == "normal"


def test_model_input_schema(spark):
    grid = E.time_grid(spark, datetime(2024, 1, 1), datetime(2024, 1, 2, 23), HOUR)
    landfalls = spark.createDataFrame([], "date date")
    df = E.model_input(E.with_weather_and_events(grid, landfalls, E.event_calendar(E.years_of(grid))))
    assert df.columns == "ds is_monsoon typhoon_index request_rate cpu_utilization hour day_of_week month y".split()
    assert df.where("request_rate < 0 OR request_rate > 500 OR cpu_utilization > 100 OR y <> request_rate").isEmpty()


def test_noise_and_monsoon_columns_enter_demand(spark):
    df = at(spark, "2024-07-01 08:00:00").withColumns(
        {"is_monsoon": F.lit(1), "typhoon_index": F.lit(0.0), "event_boost": F.lit(1.0), "wet": F.lit(2.0), "noise": F.lit(3.0)}
    )
    plain = E.expected_demand(df, 100.0, 500.0).first()["y"]
    wet = E.expected_demand(df, 100.0, 500.0, monsoon_factor="wet", noise="noise").first()["y"]
    assert wet == pytest.approx(2 * plain + 3)
    assert E.expected_demand(df, 100.0, 10.0).first()["y"] == 10.0
