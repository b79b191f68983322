"""Series that a task takes together: the same models and forecasts as each alone."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from headroom.operators.forecast import additive

DESIGN = additive.Design(("wet",))
TRIALS = {
    2: additive.AdditiveParams(),
    4: additive.AdditiveParams("multiplicative", 0.3, changepoint_range=0.9),
    5: additive.AdditiveParams(changepoints="sparse"),
}
LENGTHS = {"a": 400, "b": 3, "c": 90, "d": 401, "e": 1, "f": 90}


def rows_of(name: str, count: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng([ord(name), count])
    days = 18_000.0 + np.sort(rng.choice(3 * count, count, replace=False))
    y = 20 + 3 * np.sin(2 * np.pi * days / 7) + rng.normal(size=count)
    return {"k": np.full(count, name), "_days": days, "_y": y, "wet": rng.random(count)}


def as_table(parts: list[dict[str, np.ndarray]], seed: int = 0) -> pa.Table:
    joined = {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}
    order = np.random.default_rng(seed).permutation(len(joined["k"]))
    return pa.table({name: pa.array(values[order], pa.string() if name == "k" else pa.float64()) for name, values in joined.items()})


def fitted(table: pa.Table) -> dict:
    found = additive._fitter(TRIALS, DESIGN, ["k"], 2)(table).to_pylist()
    return {(m["k"], m["trial"]): m for m in found}


def explained(model: dict, part: dict[str, np.ndarray]) -> np.ndarray:
    """What the model makes of the rows it was fitted to; coefficients of columns that are nearly alike are less certain."""
    params, t = TRIALS[model["trial"]], (part["_days"] - model["first_day"]) / model["span_days"]
    hinges = [np.maximum(t - params.changepoint_range * j / additive.CHANGEPOINTS, 0) for j in range(1, additive.CHANGEPOINTS + 1)]
    level = np.column_stack([np.ones(len(t)), t, *hinges]) @ model["trend"]
    swing = additive._season(part["_days"], part["wet"][:, None], DESIGN) @ model["season"]
    return level * (1 + swing) if params.seasonality_mode == "multiplicative" else level + swing


def test_series_of_unlike_lengths_have_the_models_they_have_alone(monkeypatch):
    monkeypatch.setattr(additive, "ROWS_PER_STACK", 1_000)
    parts = {name: rows_of(name, count) for name, count in LENGTHS.items()}
    parts["c"]["wet"][:] = 0.0  # a column that one series of a stack lacks
    parts["f"]["_y"][7] = np.nan
    together = fitted(as_table(list(parts.values())))
    assert sorted(together) == [(k, t) for k in sorted(LENGTHS) for t in TRIALS]
    for name, part in parts.items():
        for key, alone in fitted(as_table([part])).items():
            found = together[key]
            assert (found["state"], found["error"], found["rows"]) == (alone["state"], alone["error"], LENGTHS[name])
            assert (found["state"] == "FAIL") == (name == "f") == (found["trend"] is None)
            if found["state"] == "COMPLETE":
                np.testing.assert_allclose(explained(found, part), explained(alone, part), atol=1e-6)
    assert together["c", 2]["season"][-1] == 0.0


def test_many_series_are_solved_in_few_calls(monkeypatch):
    calls, solve = [], np.linalg.solve
    monkeypatch.setattr(np.linalg, "solve", lambda a, b: calls.append(a.shape) or solve(a, b))
    found = additive._fitter({0: TRIALS[2], 1: TRIALS[4]}, DESIGN, ["k"], 2)(as_table([rows_of(chr(97 + i), 60) for i in range(26)]))
    assert found.num_rows == 52
    assert len(calls) == 12  # two for the first trial, ten for the second, whatever the number of series


def test_a_trial_that_breaks_for_one_series_is_a_row_of_that_series(monkeypatch):
    table, solve = as_table([rows_of(name, 60) for name in "xyz"]), np.linalg.solve
    broken = rows_of("y", 60)["_y"]
    goal = (broken / np.abs(broken).max()).sum() / np.sqrt(60)

    def breaking(a, b):
        if np.isclose(b[..., 0, 0], goal).any():
            raise np.linalg.LinAlgError("Singular matrix")
        return solve(a, b)

    monkeypatch.setattr(np.linalg, "solve", breaking)
    found = additive._fitter({0: TRIALS[2]}, DESIGN, ["k"], 2)(table).to_pylist()
    assert {(m["k"], m["state"], m["error"]) for m in found} == {("x", "COMPLETE", None), ("y", "FAIL", "Singular matrix"), ("z", "COMPLETE", None)}


@pytest.fixture(scope="module")
def history(spark):
    """Four series of 200 days, one without a key; the last 60 days are to be forecast, and some have no regressor."""
    rows = spark.range(800).withColumns({"k": F.nullif(F.col("id") % 4, F.lit(3)), "n": F.floor(F.col("id") / 4).cast("int")})
    ds = F.expr("timestamp_ntz'2020-01-01' + make_dt_interval(n)")
    wet = F.when((F.col("n") < 140) | (F.col("n") % 9 != 0), F.pmod(F.hash("id"), F.lit(10)) / 10)
    y = 5 + F.col("k") + F.sin(F.col("n") / 3) + F.pmod(F.hash("n", "k"), F.lit(7)) / 7
    return rows.select("k", ds.alias("ds"), y.alias("y"), wet.alias("wet"), F.when(F.col("n") < 140, "train").otherwise("holdout").alias("fold"))


def test_a_forecast_is_the_same_in_one_part_or_many(history):
    models = additive.fit_additive(history.where("fold = 'train' AND k < 2"), TRIALS, DESIGN, series=["k"])
    assert {(m["k"], m["trial"]) for m in models.collect()} == {(k, t) for k in (0, 1) for t in TRIALS}
    later, given = history.where("fold = 'holdout'"), {t: TRIALS[t] for t in (2, 4)}
    whole, parts = (
        {(r["k"], r["ds"], r["trial"]): r["predicted"] for r in additive.predict_additive(models, later, given, DESIGN, series=["k"], floor=False, rows_per_task=n).collect()}
        for n in (10**6, 7)
    )
    assert set(whole) == {(r["k"], r["ds"], t) for r in later.where("k < 2").collect() for t in given}
    blank = {(r["k"], r["ds"]) for r in later.where("wet IS NULL").collect()}
    assert all((value is None) == (key[:2] in blank) for key, value in whole.items()) and blank
    assert set(parts) == set(whole)
    for key, value in whole.items():
        assert parts[key] is None if value is None else abs(parts[key] - value) < 1e-12
    floored = additive.predict_additive(models, later, given, DESIGN, series=["k"])
    assert {r["predicted"] for r in floored.where("wet IS NULL").collect()} == {0.0}


def test_waves_are_not_computed_per_trial(history):
    models = additive.fit_additive(history.where("fold = 'train'"), TRIALS, DESIGN, series=["k"])
    plan = additive.predict_additive(models, history.where("fold = 'holdout'"), TRIALS, DESIGN, series=["k"])._jdf.queryExecution().executedPlan().toString()
    assert "COS(" not in plan.upper()


def test_rows_without_models_and_models_without_rows_give_nothing():
    models = additive._fitter(TRIALS, DESIGN, ["k"], 2)(as_table([rows_of("a", 60)]))
    rows = pa.table({"k": ["b", "c"], "_days": [18_000.0, 18_001.0], "_x0": [0.5, None]})
    score = additive._scorer(TRIALS, DESIGN, ["k"], ["k"])
    assert [score(a, b).num_rows for a, b in ((rows, models), (rows, models.slice(0, 0)), (rows.slice(0, 0), models), (rows.schema.empty_table(), models.schema.empty_table()))] == [0] * 4
    found = score(rows.set_column(0, "k", pa.array(["a", "b"])), models).to_pylist()
    assert [(r["k"], [m["trial"] for m in r["_found"]]) for r in found] == [("a", list(TRIALS))]
