from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from headroom.functions.clock import HOUR
from headroom.operators import features, tuning
from headroom.operators.features import SeasonalOrder
from headroom.operators.forecast import additive, balance, batched, cells, gram, recurrent, seasonal_ar
from headroom.operators.forecast.cells import RecurrentParams
from headroom.operators.forecast.frames import prediction_frame
from headroom.operators.forecast.linear import forecast_linear, linear_stepper
from headroom.operators.forecast.recursion import recursive_forecast


def ntz(df):
    return df.withColumn("ds", F.col("ds").cast("timestamp_ntz"))


@pytest.mark.parametrize("rows", [40, 100_000])
def test_products_equal_numpy_whether_series_are_long_or_short(spark, rows):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": np.repeat(["a", "b", "c"], [300, 30, 1]), "t": np.arange(331), "x": rng.normal(size=331)})
    pdf["y"] = 3 * pdf["x"] + rng.normal(size=331)
    df = spark.createDataFrame(pdf).repartition(3)
    sums = gram.products(df, [F.lit(1.0), F.col("x")], F.col("y"), series=["k"], spread="t", rows=rows).toPandas()
    assert len(sums) == 3
    for key, group in pdf.groupby("k"):
        z = np.column_stack([np.ones(len(group)), group["x"], group["y"]])
        found = gram.square(sums[sums["k"] == key]["products"].iloc[0])
        np.testing.assert_allclose(found, z.T @ z, rtol=1e-9)


def test_ridge_ignores_empty_columns():
    z = np.array([[1.0, 0.0, 2.0], [2.0, 0.0, 4.0]])
    np.testing.assert_allclose(gram.ridge(z.T @ z, 0.0), [2.0, 0.0], atol=1e-8)


@pytest.fixture(scope="module")
def seasonal(spark):
    """Two years and more, since a yearly season cannot be told from the trend in less than one."""
    ds = pd.date_range("2020-01-01", periods=24 * 800, freq="h")
    day = (ds - pd.Timestamp("1970-01-01")) / pd.Timedelta(days=1)
    wave = 0.2 * np.sin(2 * np.pi * day / 7) + 0.1 * np.cos(2 * np.pi * day)
    level = 50 + 0.002 * np.arange(len(ds))
    frames = [
        pd.DataFrame({"service": name, "ds": ds, "y": y, "is_monsoon": 0, "typhoon_index": 0.0})
        for name, y in (("plus", level + 50 * wave), ("times", level * (1 + wave)))
    ]
    df = ntz(spark.createDataFrame(pd.concat(frames)))
    return features.with_fold(df, series=["service"], step=HOUR, holdout_ratio=0.1)


@pytest.mark.parametrize("mode", ["additive", "multiplicative"])
def test_additive_model_finds_the_signal_of_its_own_kind(seasonal, mode):
    name = {"additive": "plus", "multiplicative": "times"}[mode]
    df = seasonal.where(F.col("service") == name)
    params = additive.AdditiveParams(mode, seasonality_prior_scale=1.0)
    models = additive.fit_additive(df.where("fold = 'train'"), params, series=["service"], passes=3)
    out = additive.predict_additive(models, df.where("fold = 'holdout'"), params, series=["service"]).toPandas()
    assert len(out) == 1920
    assert np.abs(out["y"] - out["predicted"]).mean() < 1.5


def test_seasonal_ar_recovers_its_coefficients(spark):
    rng = np.random.default_rng(5)
    n, past = 4000, lambda a, i: a[i] if i >= 0 else 0.0
    shocks, left = rng.normal(size=n), np.zeros(n)
    for t in range(n):
        left[t] = (
            0.5 * past(left, t - 1) + 0.6 * past(left, t - 24) - 0.3 * past(left, t - 25)
            + shocks[t] + 0.3 * past(shocks, t - 1)
        )
    x = rng.normal(size=n).cumsum()
    y = 1000 + np.cumsum(left + 2 * np.diff(np.r_[0, x]))
    ds = pd.date_range("2020-01-01", periods=n, freq="h")
    df = ntz(spark.createDataFrame(pd.DataFrame({"service": "a", "ds": ds, "y": y, "x": x})))
    df = features.with_fold(df, series=["service"], step=HOUR, holdout_ratio=0.02)
    models, ready = seasonal_ar.fit_seasonal_ar(df, SeasonalOrder(), series=["service"], regressors=["x"], step=HOUR)
    row = models.first()
    assert abs(row["regression"][0] - 2) < 0.1
    np.testing.assert_allclose(row["ar"], [0.5, 0.6, -0.3], atol=0.08)
    np.testing.assert_allclose(row["ma"], [0.3, 0.0, 0.0], atol=0.1)
    whole = seasonal_ar.forecast_seasonal_ar(models, ready, series=["service"]).toPandas().sort_values("ds")
    parts = seasonal_ar.forecast_seasonal_ar(models, ready, series=["service"], rows_per_round=30).toPandas().sort_values("ds")
    assert len(whole) == 80
    np.testing.assert_allclose(whole["predicted"], parts["predicted"])
    assert abs(whole["predicted"].iloc[0] - y[-80]) < 5


@pytest.mark.parametrize("cell", ["gru", "lstm"])
def test_gradient_equals_finite_differences(cell):
    params = RecurrentParams(sequence_length=4, hidden_size=3, num_layers=2, dropout=0.3)
    rng = np.random.default_rng(0)
    x, y = cells.windows(rng.normal(size=(9, 4)), 4)
    shapes, weights = cells.layout(cell, 4, params), cells.start_weights(cell, 4, params, 1)
    masks = cells.dropout_masks(params, np.arange(len(y)), seed=3, epoch=1)
    _, slope = cells.gradient(cell, cells.unpack(weights, shapes), x, y, masks)
    for i in range(0, len(weights), 7):
        nudge = np.zeros_like(weights)
        nudge[i] = 1e-6
        up = cells.gradient(cell, cells.unpack(weights + nudge, shapes), x, y, masks)[0]
        down = cells.gradient(cell, cells.unpack(weights - nudge, shapes), x, y, masks)[0]
        assert abs((up - down) / 2e-6 - slope[i]) < 1e-6


def test_windows_need_more_rows_than_they_are_long():
    x, y = cells.windows(np.arange(10.0).reshape(5, 2), 3)
    assert x.shape == (2, 3, 2) and y.tolist() == [6.0, 8.0]
    with pytest.raises(ValueError, match="more rows"):
        cells.windows(np.zeros((3, 2)), 3)


@pytest.mark.parametrize(
    "wrong", [{"sequence_length": 0}, {"learning_rate": 1.5}, {"batch_size": -1}, {"dropout": 1.0}, {"gradient_clip": -1}]
)
def test_parameters_out_of_range_are_rejected(wrong):
    with pytest.raises(ValueError):
        RecurrentParams(**wrong)


@pytest.fixture(scope="module")
def prepared(spark):
    n = 60
    ds = pd.date_range("2024-01-01", periods=n, freq="h")
    frames = []
    for i, name in enumerate(["a", "b"]):
        frames.append(
            pd.DataFrame(
                {
                    "service": name,
                    "ds": ds,
                    "y": 20.0 + 5 * np.sin(np.arange(n) / 4 + i),
                    "is_monsoon": 0,
                    "typhoon_index": 0.0,
                    "hour": ds.hour,
                    "day_of_week": ds.dayofweek,
                    "month": 1,
                }
            )
        )
    df = ntz(spark.createDataFrame(pd.concat(frames)))
    df = features.with_fold(df, series=["service"], step=HOUR)
    rows, scaling = recurrent.prepare(df, series=["service"], step=HOUR)
    return rows, scaling


@pytest.mark.parametrize("batch_size", [0, 16, 256])
def test_long_series_take_the_same_steps(prepared, batch_size):
    rows, _ = prepared
    params = RecurrentParams(
        sequence_length=4, hidden_size=2, epochs=2, batch_size=batch_size, num_layers=2, dropout=0.3, gradient_clip=1.0
    )
    short, long = (
        {m["service"]: m["weights"] for m in recurrent.fit_recurrent(rows, "gru", params, series=["service"], rows_per_model=n).collect()}
        for n in (10**6, 20)
    )
    assert sorted(short) == sorted(long) == ["a", "b"]
    for name in short:
        np.testing.assert_allclose(long[name], short[name], atol=1e-5)


@pytest.mark.parametrize("cell", ["gru", "lstm"])
def test_long_series_keep_their_chunks_over_epochs(spark, prepared, cell):
    """The same weights as the plain kernel; jobs grow with the epochs in a job, not with the steps."""
    rows, _ = prepared
    known = rows.where("rn <= start")
    params = RecurrentParams(sequence_length=4, hidden_size=3, epochs=4, batch_size=8)
    tracker, counts = spark.sparkContext.statusTracker(), []
    for epochs_per_job in (1, 4):
        spark.sparkContext.setJobGroup(f"{cell}-{epochs_per_job}", "long")
        models = recurrent.fit_long_series(known, cell, params, series=["service"], rows_per_task=10, epochs_per_job=epochs_per_job).collect()
        counts.append(len(tracker.getJobIdsForGroup(f"{cell}-{epochs_per_job}")))
        for m in models:
            values = known.where(F.col("service") == m["service"]).toPandas().sort_values("rn")[recurrent.COLUMNS].to_numpy(float)
            np.testing.assert_allclose(m["weights"], cells.train(cell, values, params, recurrent._seed(42, 0, [m["service"]])), atol=1e-4)
    spark.sparkContext._jsc.clearJobGroup()
    steps = 4 * cells.batch_count(44, params)
    assert counts[1] < counts[0] < counts[1] + steps


@pytest.mark.parametrize("cell", ["gru", "lstm"])
@pytest.mark.parametrize("layers, batch_size", [(1, 0), (3, 16)])
def test_stacked_training_equals_the_plain_kernel(cell, layers, batch_size):
    rng = np.random.default_rng(layers)
    series = [np.column_stack([np.sin(np.arange(n) / 4 + n), rng.normal(size=(n, 3))]) for n in (70, 41, 70)]
    params = RecurrentParams(
        sequence_length=6, hidden_size=8, epochs=8, batch_size=batch_size, num_layers=layers, dropout=0.3, gradient_clip=1.0, weight_decay=1e-4
    )
    state = batched.train(cell, series, params, [1, 2, 3])
    for values, seed, own in zip(series, [1, 2, 3], state.weights):
        np.testing.assert_allclose(own, cells.train(cell, values, params, seed), atol=1e-4)
    resumed = batched.train(cell, series, params, [1, 2, 3], epochs=3)
    np.testing.assert_array_equal(batched.train(cell, series, params, [1, 2, 3], resumed).weights, state.weights)
    past = np.stack([values[: params.sequence_length] for values in series])
    one = [cells.forward(cell, cells.unpack(own, cells.layout(cell, 4, params)), x[None])[0][0] for own, x in zip(state.weights, past)]
    np.testing.assert_allclose(batched.predicted(cell, state.weights, past[:, None], params)[:, 0], one, atol=1e-5)


def test_blocks_do_not_change_gradients(monkeypatch):
    series = [np.random.default_rng(1).normal(size=(50, 3))] * 2
    params = RecurrentParams(sequence_length=5, hidden_size=4, num_layers=2, dropout=0.2)
    state, stack = batched.start("gru", 3, params, [1, 2]), batched.Stack(series, params)
    chosen = [np.arange(45), np.arange(7, 30)]
    whole = stack.gradients("gru", state.weights, chosen, [1, 2], 0)
    monkeypatch.setattr(batched, "BLOCK_NUMBERS", 2 * 5 * 4 * 3 * 2 * 6)
    np.testing.assert_allclose(stack.gradients("gru", state.weights, chosen, [1, 2], 0), whole, rtol=1e-4, atol=1e-4)


@pytest.mark.parametrize("rows_per_model", [20, 10**6])
def test_training_goes_on_from_its_state(prepared, rows_per_model):
    rows, _ = prepared
    trials = {t: RecurrentParams(sequence_length=4, hidden_size=3, epochs=4, batch_size=16 * t) for t in (0, 1)}

    def fitted(**more):
        models = recurrent.fit_recurrent(rows, "lstm", trials, series=["service"], rows_per_model=rows_per_model, **more)
        return recurrent.settle(models)

    whole = {(m["service"], m["trial"]): m["weights"] for m in fitted().collect()}
    half = fitted(until={0: 2, 1: 1}, keep_state=True)
    assert {(m["trial"], m["epoch"]) for m in half.collect()} == {(0, 2), (1, 1)}
    some = recurrent.settle(half.where("service = 'a' OR trial = 1"))
    on = fitted(states=some, keep_state=True).collect()
    assert {(m["service"], m["trial"]) for m in on} == {("a", 0), ("a", 1), ("b", 1)}
    for m in on:
        np.testing.assert_allclose(m["weights"], whole[m["service"], m["trial"]], atol=1e-12)


def test_halving_records_its_rungs(spark):
    n = 80
    ds = pd.date_range("2024-01-01", periods=n, freq="h")
    clock = {"is_monsoon": 0, "typhoon_index": 0.0, "hour": ds.hour, "day_of_week": ds.dayofweek, "month": 1}
    frames = [pd.DataFrame({"service": name, "ds": ds, "y": 20.0 + 5 * np.sin(np.arange(n) / 4 + i), **clock}) for i, name in enumerate("ab")]
    folds = tuning.search_folds(ntz(spark.createDataFrame(pd.concat(frames))), series=["service"], step=HOUR)
    trials = {t: RecurrentParams(sequence_length=4, hidden_size=3, epochs=3 * t, learning_rate=0.02) for t in (1, 2, 3, 4)}
    trials[9] = RecurrentParams(sequence_length=400, hidden_size=3, epochs=3)
    full = tuning.tune_recurrent(folds, "gru", trials, series=["service"], step=HOUR).toPandas().sort_values(["service", "trial"])
    one = tuning.tune_halving(folds, "gru", trials, series=["service"], step=HOUR, factor=1).toPandas().sort_values(["service", "trial"])
    np.testing.assert_array_equal(one["score"], full["score"])
    assert set(one["rung"]) == {0} and one["state"].tolist() == full["state"].tolist()
    halved = tuning.tune_halving(folds, "gru", trials, series=["service"], step=HOUR, factor=2, rungs=3).toPandas()
    assert halved.groupby(["service", "rung"]).size().unstack().values.tolist() == [[5, 2, 1]] * 2
    first = halved[halved["rung"] == 0]
    assert set(first["state"]) == {"COMPLETE", "PRUNED", "FAIL"} and first[first["trial"] == 4]["epoch"].tolist() == [3, 3]
    for _, own in first[first["state"] != "FAIL"].groupby("service"):
        assert own[own["state"] == "COMPLETE"]["score"].max() <= own[own["state"] == "PRUNED"]["score"].min()
    last = halved[halved["rung"] == 2].merge(full, on=["service", "trial"])
    np.testing.assert_array_equal(last["score_x"], last["score_y"])


def test_units_are_dealt_by_cost(spark, monkeypatch):
    lengths = spark.createDataFrame([(f"s{i}", 500 + 40 * i) for i in range(12)], "service string, start long")
    drawn = tuning.read_trials(tuning.sequence_space(spark), RecurrentParams)
    for per_shard in (1_000_000, 50):
        monkeypatch.setattr(balance, "UNITS_PER_SHARD", per_shard)
        units, bins = balance.with_bins(lengths, drawn, "gru", 9, series=["service"])
        units = units.toPandas()
        assert len(units) == len(units[["service", "trial"]].drop_duplicates()) == 12 * 30 and bins >= 16
        loads = units.groupby("bin")["cost"].sum()
        assert len(loads) == bins and loads.max() < (1.5 if per_shard > 50 else 3) * loads.mean()
        assert units["cost"].max() <= loads.max()


def test_full_batches_are_plain_gradient_steps(prepared):
    rows, _ = prepared
    params = RecurrentParams(sequence_length=4, hidden_size=2, epochs=2, batch_size=0)
    values = rows.where("service = 'a' AND rn <= start").toPandas().sort_values("rn")[recurrent.COLUMNS].to_numpy(float)
    x, y = cells.windows(values, 4)
    shapes, weights = cells.layout("gru", 9, params), cells.start_weights("gru", 9, params, 7)
    first = second = np.zeros_like(weights)
    for step in (1, 2):
        slope = cells.gradient("gru", cells.unpack(weights, shapes), x, y)[1] / len(y)
        weights, first, second = cells.adam_step(weights, slope, first, second, step, params)
    np.testing.assert_allclose(cells.train("gru", values, params, 7), weights, atol=1e-12)


def test_every_sequence_is_in_one_batch_per_epoch():
    params, rows = RecurrentParams(batch_size=10), np.arange(5, 1000)
    one, two = (cells.batch_of(rows, len(rows), params, 1, epoch) for epoch in (0, 1))
    assert cells.batch_count(len(rows), params) == 100 and set(one) <= set(range(100)) and (one != two).any()
    assert abs(np.bincount(one.astype(int), minlength=100).mean() - 9.95) < 1e-9


@pytest.mark.parametrize("rows_per_model", [20, 10**6])
def test_diverging_models_fail_at_every_length(prepared, rows_per_model):
    rows, _ = prepared
    wild = rows.withColumn("y", F.lit(float("nan")))
    params = RecurrentParams(sequence_length=4, hidden_size=2, epochs=1, batch_size=0)
    models = recurrent.fit_recurrent(wild, "gru", params, series=["service"], rows_per_model=rows_per_model).collect()
    assert {(m["state"], m["error"], m["weights"] is None) for m in models} == {("FAIL", "training diverged", True)}


def test_failed_trials_are_rows_and_forecasts_repeat(prepared):
    rows, scaling = prepared
    trials = {
        0: RecurrentParams(sequence_length=4, hidden_size=3, epochs=2),
        1: RecurrentParams(sequence_length=500, hidden_size=3, epochs=2),
    }
    models = recurrent.fit_recurrent(rows, "lstm", trials, series=["service"])
    states = {(m["service"], m["trial"]): (m["state"], m["error"]) for m in models.collect()}
    assert states[("a", 0)] == ("COMPLETE", None)
    assert states[("b", 1)][0] == "FAIL" and "more rows" in states[("b", 1)][1]
    run = [
        recurrent.forecast_recurrent(rows, models, scaling, "lstm", trials, series=["service"], rows_per_round=size)
        .toPandas()
        .sort_values(["service", "ds"])
        for size in (500, 5)
    ]
    assert len(run[0]) == 24 and set(run[0]["trial"]) == {0} and (run[0]["predicted"] >= 0).all()


def test_parameters_survive_the_parameter_table(prepared):
    rows, _ = prepared
    params = RecurrentParams(sequence_length=4, hidden_size=3, epochs=1, num_layers=2)
    from headroom.session import settle

    models = settle(recurrent.fit_recurrent(rows, "gru", params, series=["service"]))
    table = recurrent.parameter_table(models, "gru", params, series=["service"])
    assert table.count() == 2 * 10
    back = recurrent.models_from_parameters(table, "gru", params, series=["service"])
    assert {m["service"]: m["weights"] for m in models.collect()} == {m["service"]: m["weights"] for m in back.collect()}


@pytest.mark.parametrize("size", [2, 1000])
def test_recursive_forecast_uses_its_own_results(spark, size):
    data = [("a", i + 1, 3, float(v), 0.0) for i, v in enumerate([1, 2, 3, 100, 200])]
    rows = spark.createDataFrame(data, "service string, rn bigint, start bigint, y double, feature double")
    models = spark.createDataFrame([("a",)], "service string")
    step = linear_stepper({(1, 0): 1.0, (2, 1): 0.0}, constant=1.0)
    out = recursive_forecast(
        rows.withColumn("ds", F.col("rn")), models, step, series=["service"], columns=["y", "feature"], length=2, rows_per_round=size
    )
    assert [r["y"] for r in out.orderBy("rn").collect()] == [4.0, 5.0]


def test_recursive_forecast_checks_its_bounds(spark):
    rows = spark.createDataFrame([("a", 1, 1, 1.0), ("a", 2, 1, 2.0)], "service string, rn bigint, start bigint, y double")
    rows = rows.withColumn("ds", F.col("rn"))
    models = spark.createDataFrame([("a",)], "service string")
    with pytest.raises(ValueError, match="greater than 0"):
        recursive_forecast(rows, models, linear_stepper({(1, 0): 1.0}), series=["service"], columns=["y"], length=0)
    with pytest.raises(Exception, match="rows before it"):
        recursive_forecast(rows, models, linear_stepper({(2, 0): 1.0}), series=["service"], columns=["y"], length=2).collect()


def test_prediction_frame_matches_one_to_one(spark):
    holdout = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01' + make_interval(0,0,0,0,i) AS ds, y FROM VALUES (0, 10), (1, 40) AS t(i, y)")
    predicted = holdout.select("ds", F.lit(20.0).alias("predicted"))
    framed = prediction_frame(holdout, predicted, "test")
    assert framed.columns == ["ds", "actual", "predicted", "actual_pods", "predicted_pods", "model"]
    assert [(r["actual_pods"], r["predicted_pods"]) for r in framed.orderBy("ds").collect()] == [(1, 2), (3, 2)]
    for wrong in (predicted.limit(1), predicted.union(predicted)):
        with pytest.raises(Exception, match="one to one"):
            prediction_frame(holdout, wrong, "test").collect()


@pytest.mark.parametrize("rows_per_round", [2_000, 7])
def test_linear_recursion_needs_no_python(spark, rows_per_round):
    n, rng = 40, np.random.default_rng(8)
    data = [(s, i + 1, 25 + 3 * (s == "b"), float(rng.normal()), float(rng.normal())) for s in "ab" for i in range(n)]
    rows = spark.createDataFrame(data, "service string, rn long, start long, y double, x double").withColumn("n", F.lit(n).cast("long"))
    rows = ntz(rows.withColumn("ds", F.timestamp_seconds(F.col("rn") * 3600)))
    weights = {(1, 0): 0.5, (3, 0): -0.2, (2, 1): 0.7}
    found = forecast_linear(rows, weights, 0.3, series=["service"], columns=["y", "x"], rows_per_round=rows_per_round)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    models = rows.select("service").distinct()
    want = recursive_forecast(rows, models, linear_stepper(weights, 0.3), series=["service"], columns=["y", "x"], length=3)
    a, b = (df.orderBy("service", "rn").toPandas() for df in (found, want))
    assert "Python" not in plan and "Pandas" not in plan and len(a) == 15 + 12
    assert a["service"].tolist() == b["service"].tolist() and a["rn"].tolist() == b["rn"].tolist() and a["ds"].tolist() == b["ds"].tolist()
    np.testing.assert_allclose(a["y"], b["y"], atol=1e-12)


def penalised_error(matrix, penalty, absolute, b):
    return 0.5 * b @ matrix[:-1, :-1] @ b - matrix[:-1, -1] @ b + 0.5 * (penalty * b * b).sum() + (absolute * np.abs(b)).sum()


@pytest.mark.parametrize("strength", [0.01, 1.0, 30.0, 1e6])
def test_sparse_fit_meets_the_conditions_of_its_minimum(strength):
    rng = np.random.default_rng(4)
    t = np.linspace(0, 1, 300)
    z = np.column_stack([np.ones(300), t, *[np.maximum(t - k / 25, 0) for k in range(1, 26)], rng.normal(size=(300, 3)), np.zeros(300)])
    y = 2 + t - 3 * np.maximum(t - 0.4, 0) + 0.5 * z[:, -2] + 0.05 * rng.normal(size=300)
    both = np.column_stack([z, y])
    matrix, penalty, absolute = both.T @ both, np.full(31, 1e-3), np.zeros(31)
    penalty[2:27], absolute[2:27] = 0.0, strength
    b = gram.sparse(matrix, penalty, absolute)
    slope = matrix[:-1, -1] - matrix[:-1, :-1] @ b - penalty * b
    own = absolute > 0
    np.testing.assert_allclose(slope[~own], 0, atol=1e-5)
    assert np.all(np.abs(slope[own]) <= strength + 1e-5)
    np.testing.assert_allclose(slope[own & (b != 0)], strength * np.sign(b[own & (b != 0)]), atol=1e-5)
    assert b[-1] == 0 and (b[2:27] == 0).sum() >= (25 if strength == 1e6 else 15)
    for _ in range(20):
        near = b + rng.normal(size=31) * rng.choice([1e-4, 1e-2])
        assert penalised_error(matrix, penalty, absolute, b) <= penalised_error(matrix, penalty, absolute, near) + 1e-9


@pytest.mark.parametrize("mode", ["additive", "multiplicative"])
def test_additive_fit_is_the_same_in_one_task_or_many(seasonal, mode):
    train = seasonal.where("fold = 'train' AND pmod(hour(ds), 6) = 0")
    trials = {3: additive.AdditiveParams(mode), 5: additive.AdditiveParams(mode, 0.5, changepoint_range=0.9), 8: additive.AdditiveParams(mode, changepoints="sparse")}
    whole, parts = (
        {(m["service"], m["trial"]): m for m in additive.fit_additive(train, trials, series=["service"], rows_per_task=n).collect()} for n in (10**6, 700)
    )
    assert sorted(whole) == sorted(parts) == [(s, t) for s in ("plus", "times") for t in (3, 5, 8)]
    for key, m in whole.items():
        assert m["state"] == parts[key]["state"] == "COMPLETE"
        for name in ("trend", "season"):
            np.testing.assert_allclose(parts[key][name], m[name], rtol=1e-5, atol=1e-7)
    zeros = {t: sum(v == 0 for v in whole["plus", t]["trend"][2:]) for t in trials}
    assert zeros[8] > 0 == zeros[3]  # the double-exponential prior drops changepoints, the ridge none


def test_a_series_that_cannot_be_fitted_is_a_row(spark, seasonal):
    train = seasonal.where("fold = 'train' AND hour(ds) = 0").withColumn("y", F.when(F.col("service") == "plus", F.lit(float("nan"))).otherwise(F.col("y")))
    for rows in (10**6, 100):
        models = additive.fit_additive(train, {0: additive.AdditiveParams()}, series=["service"], rows_per_task=rows).collect()
        assert {(m["service"], m["state"], m["error"] is None, m["trend"] is None) for m in models} == {("plus", "FAIL", False, True), ("times", "COMPLETE", True, False)}


@pytest.fixture
def late_broadcast(spark):
    """Joins are planned by sorting and turn into broadcasts at run time, which read the shuffled rows by mapper."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "20k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@pytest.fixture
def many_series(spark):
    """Twenty series of 120 rows in six parts, the last 20 of each for the holdout."""
    ds = F.expr("timestamp_ntz'2020-01-01' + make_dt_interval(cast(id as int))")
    rows = spark.range(0, 2400, 1, 6).select((F.col("id") % 20).alias("k"), ds.alias("ds"), F.sin(F.col("id")).alias("y"), F.when(F.col("id") < 2000, "train").otherwise("holdout").alias("fold"))
    return rows.withColumns({"is_monsoon": F.lit(0), "typhoon_index": F.lit(0.0)})


def test_a_series_is_fitted_once_when_a_join_gives_up_its_order(many_series, late_broadcast):
    models = additive.fit_additive(many_series, {0: additive.AdditiveParams(), 1: additive.AdditiveParams("multiplicative")}, series=["k"]).collect()
    assert sorted((m["k"], m["trial"]) for m in models) == [(k, t) for k in range(20) for t in range(2)]


def test_a_refit_predicts_each_row_once_when_a_join_gives_up_its_order(many_series, late_broadcast):
    models, predicted = tuning.refit_additive(many_series, additive.AdditiveParams(), series=["k"])
    assert models.count() == 20
    assert predicted.count() == predicted.select("k", "ds").distinct().count() == 400


def test_rows_of_all_trials_do_not_pass_through_the_driver(spark, many_series):
    """The rows look small before each meets its trials, whatever size the planner takes them to be."""
    trials = {t: additive.AdditiveParams(mode, changepoint_range=r) for t, (mode, r) in enumerate([("additive", 0.8), ("multiplicative", 0.9), ("additive", 0.6)])}
    models = additive.fit_additive(many_series.where("fold = 'train'"), trials, series=["k"])
    later = many_series.where("fold = 'holdout'")
    found = additive.predict_additive(models, later, {t: trials[t] for t in (0, 1)}, series=["k"])
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    rows = {(r["k"], r["ds"], r["trial"]): r["predicted"] for r in found.collect()}
    assert found.count() == len(rows) == 800
    for t in (0, 1):
        alone = additive.predict_additive(models.where(F.col("trial") == t), later, {t: trials[t]}, series=["k"]).collect()
        assert {(r["k"], r["ds"], t): r["predicted"] for r in alone} == {key: value for key, value in rows.items() if key[2] == t}
