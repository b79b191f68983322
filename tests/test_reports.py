from __future__ import annotations

from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from headroom.functions.clock import HOUR
from headroom.operators import reports as P


def ntz(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns or ["ds"]})


@pytest.fixture(scope="module")
def hourly(spark):
    rng = np.random.default_rng(2)
    frames = []
    for name in ("a", "b"):
        ds = pd.date_range("2024-01-01", periods=24 * 6, freq="h")
        frames.append(pd.DataFrame({"service": name, "ds": ds, "actual": rng.integers(0, 50, len(ds)) / 4}))
    return pd.concat(frames)


def peak_by_hand(group: pd.DataFrame, days: int):
    group = group.sort_values("ds").reset_index(drop=True)
    if len(group) < 2:
        return group["ds"].iloc[0]
    step = group["ds"].diff().dropna().median()
    size = min(len(group), max(1, round(pd.Timedelta(days=1) / step)) * days)
    sums = [(group["actual"].iloc[i : i + size] * 4).sum() for i in range(len(group) - size + 1)]
    return group["ds"].iloc[int(np.argmax(sums))]


@pytest.mark.parametrize("how", [{}, {"step": HOUR}, {"rows": 7}])
@pytest.mark.parametrize("days", [1, 2, 30])
def test_peak_window(spark, hourly, how, days):
    df = ntz(spark.createDataFrame(hourly))
    found = {r["service"]: r["start"] for r in P.peak_window_start(df, days, series=["service"], **how).collect()}
    assert found == {name: peak_by_hand(group, days) for name, group in hourly.groupby("service")}


def test_peak_window_of_uneven_steps_ties_and_single_rows(spark):
    ds = pd.to_datetime(["2024-01-01", "2024-01-01 12:00", "2024-01-02", "2024-01-02 08:00", "2024-01-04"], format="mixed")
    uneven = pd.DataFrame({"service": "a", "ds": ds, "actual": [1.0, 5.0, 0.0, 1.0, 5.0]})
    flat = pd.DataFrame({"service": "b", "ds": pd.date_range("2024-01-01", periods=5, freq="12h"), "actual": 2.0})
    lone = pd.DataFrame({"service": "c", "ds": [pd.Timestamp("2024-05-05")], "actual": [1.0]})
    pdf = pd.concat([uneven, flat, lone])
    found = {r["service"]: r["start"] for r in P.peak_window_start(ntz(spark.createDataFrame(pdf)), 1, series=["service"]).collect()}
    assert found == {name: peak_by_hand(group, 1) for name, group in pdf.groupby("service")}
    assert found["b"] == datetime(2024, 1, 1) and found["c"] == datetime(2024, 5, 5)


def test_repeated_timestamps_have_no_step(spark):
    pdf = pd.DataFrame({"service": "a", "ds": pd.Timestamp("2024-01-01"), "actual": [1.0, 2.0, 3.0]})
    with pytest.raises(Exception, match="different timestamps"):
        P.peak_window_start(ntz(spark.createDataFrame(pdf)), 1, series=["service"]).collect()


def test_select_window(spark, hourly):
    df = ntz(spark.createDataFrame(hourly))
    assert P.select_window(df, 2, series=["service"], start="2024-01-02").count() == 2 * 48
    assert P.select_window(df, 1, series=["service"]).count() == 2 * 24
    with pytest.raises(ValueError, match="has no rows"):
        P.select_window(df, 2, series=["service"], start="2030-01-01")


def test_common_window_without_series(spark, hourly):
    one = hourly[hourly["service"] == "a"]
    df = ntz(spark.createDataFrame(pd.concat([one.assign(model="x"), one.assign(model="y", actual=one["actual"].iloc[::-1].values)])))
    window = P.common_window(df, 1, default_model="x")
    start = peak_by_hand(one, 1)
    rows = window.groupBy("model").agg(F.min("ds").alias("lo"), F.count("*").alias("n")).collect()
    assert {(r["model"], r["lo"], r["n"]) for r in rows} == {("x", start, 24), ("y", start, 24)}


def test_mismatch_spans(spark):
    rows = [("a", "2024-01-01 00:00", 2, 1), ("a", "2024-01-01 00:30", 2, 2), ("a", "2024-01-01 02:00", 1, 3), ("b", "2024-01-01 00:00", 1, 2)]
    df = ntz(spark.createDataFrame(rows, "service string, ds string, actual_pods int, predicted_pods int"))
    found = [(r["service"], r["start"], r["end"], r["kind"]) for r in P.mismatch_spans(df, series=["service"]).orderBy("service", "start").collect()]
    day = datetime(2024, 1, 1)
    assert found == [
        ("a", day, day.replace(minute=30), "under"),
        ("a", day.replace(hour=2), day.replace(hour=2, minute=30), "over"),
        ("b", day, day.replace(hour=1), "over"),
    ]


def test_daily_reports_keep_empty_days(spark):
    rows = [("2024-01-01 01:00", "payment", 2.0, 4.0), ("2024-01-01 05:00", "payment", 4.0, 4.0), ("2024-01-03 00:00", "payment", 1.0, 1.0)]
    df = ntz(spark.createDataFrame(rows, "ds string, service string, actual double, predicted double"))
    daily = P.service_daily(df).orderBy("ds").collect()
    assert [r["actual"] for r in daily] == [3.0, None, 1.0]
    wide = df.withColumns({"model": F.lit("m"), "actual_pods": F.lit(1), "predicted_pods": F.lit(2)})
    over = P.daily_overview(wide, ["m", "other"]).orderBy("ds").collect()
    assert [r["m"] for r in over] == [4.0, None, 1.0] and [r["other"] for r in over] == [None] * 3


def test_adjusted_stack_fills_missing_services(spark):
    rows = [("2024-01-01 01:00", "payment", 4, 3), ("2024-01-01 01:00", "batch", 2, 1), ("2024-03-01 00:00", "payment", 9, 9)]
    df = ntz(spark.createDataFrame(rows, "ds string, service string, predicted_pods int, onprem_adjusted_pods int"))
    found = P.adjusted_stack(df, days=2).orderBy("position").collect()
    assert [r["service"] for r in found] == ["payment", "auth", "limit_scoring", "batch", "admin"]
    assert [r["requested_stack"] for r in found] == [4.0, 4.0, 4.0, 6.0, 6.0]
    assert [r["adjusted_stack"] for r in found] == [3.0, 3.0, 3.0, 4.0, 4.0]
    assert [r["position"] for r in P.in_report_order(df).select("service", "position").distinct().orderBy("position").collect()] == [1, 4]


def test_tuning_comparison(spark):
    rows = [("gru", 0.4), ("gru_tuned", 0.3), ("lstm", 0.5), ("lstm_tuned", 0.2)]
    df = spark.createDataFrame(rows, "model string, smape double").withColumns(
        {m: F.lit(0.1) for m in ("pod_accuracy", "under_provisioning_rate", "over_provisioning_rate")}
    )
    found = {r["family"]: (r["Baseline"], r["Tuned"]) for r in P.tuning_comparison(df, "smape").collect()}
    assert found == {"GRU": (0.4, 0.3), "LSTM": (0.5, 0.2)}


@pytest.mark.parametrize("scale", [1e-11, 1e25])
def test_small_differences_and_large_values_decide_the_peak(spark, scale):
    ds = pd.date_range("2024-01-01", periods=48, freq="h")
    df = ntz(spark.createDataFrame(pd.DataFrame({"service": "a", "ds": ds, "actual": np.arange(48) * scale})))
    found = P.peak_window_start(df, 1, series=["service"], step=HOUR).first()
    assert (found["start"], found["window_rows"]) == (datetime(2024, 1, 2), 24)
