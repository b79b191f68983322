from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from headroom.functions.clock import HOUR, order_value
from headroom.operators import ordering


@pytest.fixture(scope="module")
def frame(spark):
    """Two series, one with most of its rows packed into a short span."""
    rng = np.random.default_rng(3)
    spread = rng.choice(10_000_000, 400, replace=False)
    packed = 20_000_000 + rng.choice(3_000, 900, replace=False)
    other = rng.choice(50_000, 120, replace=False)
    rows = [("a", int(v)) for v in np.concatenate([spread, packed])] + [("b", int(v)) for v in other]
    pdf = pd.DataFrame(rows, columns=["service", "t"]).sample(frac=1, random_state=1)
    pdf["ds"] = pd.Timestamp("2024-03-30 23:00:00") + pd.to_timedelta(pdf["t"], unit="s")
    pdf["y"] = pdf["t"] % 17 + 0.5
    return pdf


def _expected(pdf):
    out = pdf.sort_values(["service", "ds"]).copy()
    out["rn"] = out.groupby("service").cumcount() + 1
    out["n"] = out.groupby("service")["ds"].transform("size")
    return out


@pytest.mark.parametrize("rows", [7, 50, 100_000])
def test_position_equals_one_window(spark, frame, rows):
    df = spark.createDataFrame(frame).withColumn("ds", F.col("ds").cast("timestamp_ntz"))
    got = ordering.with_position(df, series=["service"], rows=rows).toPandas().sort_values(["service", "ds"])
    want = _expected(frame)
    assert got["rn"].tolist() == want["rn"].tolist()
    assert got["n"].tolist() == want["n"].tolist()


@pytest.mark.parametrize("rows", [7, 100_000])
def test_cut_values_equal_sorted_ranks(spark, frame, rows):
    df = spark.createDataFrame(frame[["service", "t", "y"]])
    ranks = {"mid": F.expr("n div 2"), "last": F.col("n"), "none": F.col("n") + 1}
    got = ordering.cut_values(df, ranks, series=["service"], order="t", rows=rows).toPandas().set_index("service")
    for service, group in frame.groupby("service"):
        ordered = sorted(group["t"])
        assert got.loc[service, "mid"] == ordered[len(ordered) // 2 - 1]
        assert got.loc[service, "last"] == ordered[-1]
        assert pd.isna(got.loc[service, "none"])


@pytest.mark.parametrize("rows", [5, 100_000])
def test_lags_and_running_totals_cross_chunk_borders(spark, frame, rows):
    df = spark.createDataFrame(frame[["service", "t", "y"]])
    placed = ordering.with_position(df, series=["service"], order="t", rows=rows)
    lagged = ordering.with_lags(
        placed, {"back": ("y", 3), "ahead": ("y", -2)}, series=["service"], rows=rows
    )
    total = ordering.running_total(lagged, F.col("y"), "total", series=["service"], rows=rows)
    got = total.toPandas().sort_values(["service", "t"]).reset_index(drop=True)
    want = frame.sort_values(["service", "t"]).reset_index(drop=True)
    groups = want.groupby("service")["y"]
    pd.testing.assert_series_equal(got["back"], groups.shift(3), check_names=False)
    pd.testing.assert_series_equal(got["ahead"], groups.shift(-2), check_names=False)
    pd.testing.assert_series_equal(got["total"], groups.cumsum(), check_names=False)


def test_grid_positions_need_no_gaps(spark):
    ds = pd.date_range("2024-01-01", periods=50, freq="h")
    pdf = pd.DataFrame({"service": "a", "ds": ds, "y": range(50)})
    df = spark.createDataFrame(pdf).withColumn("ds", F.col("ds").cast("timestamp_ntz"))
    got = ordering.with_position(df, series=["service"], step=HOUR).toPandas().sort_values("ds")
    assert got["rn"].tolist() == list(range(1, 51))
    with pytest.raises(Exception, match="gap-free grid"):
        ordering.with_position(df.where("y <> 7"), series=["service"], step=HOUR).collect()


def test_order_value_has_no_time_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        df = spark.sql(
            "SELECT explode(sequence(0, 4)) AS i"
        ).selectExpr("TIMESTAMP_NTZ'2024-03-31 01:30:00.123456' + make_interval(0,0,0,0,0,30*i,0) AS ds")
        values = sorted(r[0] for r in df.select(order_value(df, "ds")).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [b - a for a, b in zip(values, values[1:])] == [1800 * 1_000_000] * 4
    assert values[0] % 1_000_000 == 123456
