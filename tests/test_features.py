from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from headroom import fixed_values as fixed
from headroom.functions.clock import HOUR
from headroom.operators import features as X
from headroom.operators.features import SeasonalOrder


@pytest.fixture(scope="module")
def two_series(spark):
    ds = pd.date_range("2024-01-01", periods=10, freq="h")
    pdf = pd.concat([pd.DataFrame({"service": s, "ds": ds, "y": [float(i * k) for i in range(10)]}) for s, k in (("a", 1), ("b", 10))])
    return spark.createDataFrame(pdf).withColumn("ds", F.col("ds").cast("timestamp_ntz"))


def clock(spark, *rows):
    return spark.createDataFrame(
        list(rows), "is_monsoon int, typhoon_index double, hour int, day_of_week int, month int"
    )


def counts(df):
    return {(r["service"], r["fold"]): r["count"] for r in df.groupBy("service", "fold").count().collect()}


@pytest.mark.parametrize("how", [{}, {"step": HOUR}, {"rows": 3}])
def test_split_is_chronological(two_series, how):
    df = X.with_fold(two_series, series=["service"], **how)
    assert counts(df) == {(s, f): n for s in "ab" for f, n in (("train", 8), ("holdout", 2))}
    edge = df.groupBy("fold").agg(F.min("ds").alias("lo"), F.max("ds").alias("hi")).collect()
    span = {r["fold"]: (r["lo"], r["hi"]) for r in edge}
    assert span["train"][1] < span["holdout"][0]


def test_nested_split_and_limits(two_series):
    nested = X.with_fold(two_series, series=["service"], validation_ratio=0.25)
    assert counts(nested)[("a", "train")] == 6 and counts(nested)[("b", "validation")] == 2
    short = X.with_fold(two_series, series=["service"], train_tail=3, holdout_head=1)
    assert counts(short) == {(s, f): n for s in "ab" for f, n in (("train", 3), ("holdout", 1))}


def test_empty_folds_are_errors(two_series):
    with pytest.raises(Exception, match="left without rows"):
        X.with_fold(two_series, series=["service"], holdout_ratio=0.9).collect()
    for ratio in (0, 1):
        with pytest.raises(ValueError, match="between 0 and 1"):
            X.with_fold(two_series, series=["service"], holdout_ratio=ratio)


def test_cyclic_features(spark):
    df = X.model_features(clock(spark, (0, 0.0, 23, 6, 12), (1, 0.8, 0, 0, 1)))
    assert df.columns == fixed.MODEL_FEATURES
    row = df.where("is_monsoon = 1").first()
    assert row["hour_sin"] == row["month_sin"] == pytest.approx(0.0)
    assert row["hour_cos"] == row["month_cos"] == pytest.approx(1.0)


def test_cyclic_violations(spark):
    bad = clock(spark, (0, 0.0, 23, 6, 12), (1, 0.8, 24, 0, 0), (1, 0.8, None, 0, 1), *[(0, 0.0, 30 + i, 0, 1) for i in range(8)])
    for parts in (1, 3, 11):  # whichever row fails first, it names its first wrong column
        with pytest.raises(Exception, match="hour contains invalid cyclic values") as failure:
            X.model_features(bad.repartition(parts)).collect()
        assert "month contains" not in str(failure.value)
    with pytest.raises(ValueError, match="hour contains invalid cyclic values for range"):
        X.check_cyclic(bad)
    found = {r["column"]: r for r in X.cyclic_violations(bad).collect()}
    assert found["hour"]["invalid_rows"] == 10 and len(found["hour"]["samples"]) <= 5
    assert found["month"]["samples"] == ["0"] and "day_of_week" not in found
    good = clock(spark, (0, 0.0, 23, 6, 12))
    assert X.check_cyclic(good) is good
    with pytest.raises(ValueError, match="missing"):
        X.model_features(good.drop("month"))


def test_recipe_features(spark):
    row = X.recipe_features(clock(spark, (1, 0.5, 8, 5, 1))).first()
    assert (row["is_peak_hour"], row["is_weekend"], row["monsoon_typhoon"]) == (1, 1, 0.5)
    with pytest.raises(Exception, match="hour"):
        X.recipe_features(clock(spark, (1, 0.5, 24, 0, 1))).collect()
    with pytest.raises(ValueError, match="missing"):
        X.recipe_features(clock(spark, (1, 0.5, 1, 0, 1)).drop("hour"))


def test_scaling_uses_training_rows_and_survives_constants(two_series):
    df = X.with_fold(two_series, series=["service"]).withColumn("c", F.lit(0.1))
    params = X.scaling_params(df, ["y", "c"], series=["service"])
    row = params.where("service = 'a'").first()
    assert row["means"] == pytest.approx([3.5, 0.1]) and row["stds"][1] == 1.0
    scaled = X.scale(df, params, ["y", "c"], series=["service"])
    assert scaled.where("fold = 'train'").agg(F.avg("y")).first()[0] == pytest.approx(0.0, abs=1e-12)
    back = X.unscale(scaled, params, "y", series=["service"]).orderBy("service", "ds").toPandas()["y"]
    assert back.tolist() == pytest.approx([float(i * k) for k in (1, 10) for i in range(10)])


@pytest.mark.parametrize("rows", [3, 1000])
def test_sequences_stay_inside_their_series(two_series, rows):
    built = X.sequences(two_series, ["y"], 3, series=["service"], rows=rows).orderBy("service", "ds").collect()
    assert len(built) == 14
    assert [v[0] for v in built[7]["window"]] == [0.0, 10.0, 20.0] and built[7]["target"] == 30.0
    with pytest.raises(Exception, match="more rows"):
        X.sequences(two_series, ["y"], 10, series=["service"]).collect()


def test_orders():
    order = SeasonalOrder.parse("1, 1,1", "1,0,1,24")
    assert order == SeasonalOrder() and order.ar_lags == [1, 24, 25] and order.difference == {0: 1.0, 1: -1.0}
    assert SeasonalOrder(1, 1, 0, 0, 1, 0, 4).difference == {0: 1.0, 1: -1.0, 4: -1.0, 5: 1.0}
    for text in ("1,1", "1,-1,1"):
        with pytest.raises(ValueError):
            X.parse_order(text)


@pytest.mark.parametrize("name", sorted(X.TRANSFORMS))
def test_transforms_invert(spark, name):
    df = spark.createDataFrame([(0.0,), (2.5,), (100.0,)], "y double")
    there = X.transform_target(df, X.TRANSFORMS[name], "y", "predicted")
    back = X.inverse_target(there, X.TRANSFORMS[name]).toPandas()
    assert back["predicted"].tolist() == pytest.approx(back["y"].tolist())


def test_transforms_must_stay_finite(spark):
    df = spark.createDataFrame([(-2.0,)], "y double")
    with pytest.raises(Exception, match="NaN or infinite"):
        X.transform_target(df, X.TRANSFORMS["sqrt"]).collect()
