from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from headroom import fixed_values as fixed
from headroom.operators import ranking as R
from headroom.operators import trials as T
from headroom.operators import tuning
from headroom.operators.forecast.additive import AdditiveParams
from headroom.operators.forecast.cells import RecurrentParams
from headroom.plans.catalog import forecasting

SCHEMA = "model string, smape double, pod_accuracy double, under_provisioning_rate double, over_provisioning_rate double"


def order(spark, *rows):
    return [r["model"] for r in R.rank_models(spark.createDataFrame(list(rows), SCHEMA)).orderBy("rank").collect()]


def test_under_provisioning_comes_first(spark):
    assert order(spark, ("low_error", 0.1, 0.9, 0.2, 0.0), ("low_under", 0.2, 0.7, 0.0, 0.1))[0] == "low_under"


def test_accuracy_comes_before_over_provisioning(spark):
    assert order(spark, ("low_over", 0.2, 0.7, 0.0, 0.0), ("accurate", 0.2, 0.9, 0.0, 0.1))[0] == "accurate"


def test_missing_metrics_rank_last_and_ties_are_stable(spark):
    rows = [("b", 0.2, 0.7, 0.0, 0.0), ("none", None, 0.9, 0.0, 0.0), ("a", 0.2, 0.7, 0.0, 0.0), ("no_under", 0.0, 1.0, None, 0.0)]
    assert order(spark, *rows) == ["a", "b", "none", "no_under"]


def test_best_model_overall_and_per_group_agree_with_the_ranking(spark):
    rows = [("x", 0.1, 0.9, 0.2, 0.0), ("y", 0.2, 0.7, 0.0, 0.1), ("z", None, 0.7, 0.0, 0.1)]
    df = spark.createDataFrame(rows, SCHEMA)
    best = R.best_model(df).first()
    assert (best["model"], best["selection_rule"]) == ("y", fixed.SELECTION_RULE)
    per = R.best_model(df.withColumn("service", F.lit("s")), by=["service"]).first()
    assert (per["model"], per["rank"], per["service"]) == ("y", 1, "s")
    with pytest.raises(ValueError, match="no model to choose from"):
        R.ensure_not_empty(R.rank_models(df.limit(0)))
    assert {r["model"] for r in R.model_subset(df, ["x", "q"]).collect()} == {"x"}


def test_best_trial_skips_failures_and_prefers_the_earlier(spark):
    rows = [(0, 0.5, "COMPLETE"), (1, None, "FAIL"), (2, 0.3, "COMPLETE"), (3, 0.3, "COMPLETE"), (4, 0.1, "FAIL"), (5, float("nan"), "COMPLETE")]
    df = spark.createDataFrame(rows, "trial int, score double, state string")
    assert T.best_trial(df).first()["trial"] == 2
    assert T.best_trial(df.where("state = 'FAIL'")).first() is None


def test_candidates_without_a_forecast_fail(spark):
    names = spark.createDataFrame([("a",), ("b",)], "candidate string")
    scored = spark.createDataFrame([("a", 0.25, 0.8)], "candidate string, penalty_score double, combined_score double")
    found = {r["candidate"]: (r["penalty_score"], r["combined_score"], r["error"]) for r in T.score_candidates(names, scored).collect()}
    assert found == {"a": (0.25, 0.8, None), "b": (999.0, 0.0, "no forecast")}


def test_normalized_params_fill_dropout(spark):
    df = spark.createDataFrame([(1, None)], "num_layers int, dropout double")
    assert df.select(T.normalized_params(["num_layers", "dropout"]).alias("p")).first()["p"]["dropout"] == 0.0


def test_sequence_space(spark):
    space = tuning.sequence_space(spark, 300, seed=1)
    rows = space.collect()
    assert {r["sequence_length"] for r in rows} == set(tuning.SEQUENCE_LENGTHS)
    assert {r["batch_size"] for r in rows} == set(tuning.BATCH_SIZES) and {r["num_layers"] for r in rows} == {1, 2, 3}
    assert all(1e-4 <= r["learning_rate"] <= 5e-2 and 10 <= r["epochs"] <= 60 for r in rows)
    assert all(r["dropout"] == 0.0 for r in rows if r["num_layers"] == 1)
    assert all(0 <= r["dropout"] <= 0.4 for r in rows) and any(r["dropout"] > 0 for r in rows)
    assert sorted(rows) == sorted(tuning.sequence_space(spark, 300, seed=1).repartition(7).collect())
    assert sorted(rows) != sorted(tuning.sequence_space(spark, 300, seed=2).collect())
    with pytest.raises(ValueError):
        tuning.sequence_space(spark, 0)
    assert isinstance(tuning.read_trials(space, RecurrentParams)[0], RecurrentParams)


def test_additive_space(spark):
    rows = tuning.additive_space(spark, 200).collect()
    assert {r["seasonality_mode"] for r in rows} == {"additive", "multiplicative"}
    assert all(0.001 <= r["changepoint_prior_scale"] <= 0.5 and 0.75 <= r["changepoint_range"] <= 0.95 for r in rows)
    assert len(tuning.read_trials(tuning.additive_space(spark, 3), AdditiveParams)) == 3


def test_names():
    assert tuning.tuned_name("gru") == "gru_tuned"


def test_nan_is_worse_than_any_number_in_ranking_and_choice(spark):
    nan = float("nan")
    rows = [("nan_accuracy", 0.1, nan, 0.0, 0.0), ("fine", 0.1, 0.2, 0.0, 0.0), ("nan_under", 0.0, 1.0, nan, 0.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert order(spark, *rows) == ["fine", "nan_accuracy", "nan_under"]
    per = R.best_model(df.withColumn("service", F.lit("s")), by=["service"]).first()
    assert per["model"] == R.best_model(df).first()["model"] == "fine"


def test_registered_searches_draw_the_whole_space(spark, monkeypatch):
    searched = {}
    monkeypatch.setattr(forecasting, "services_in_folds", lambda *a, **b: None)
    monkeypatch.setattr(forecasting, "suppliers_in_folds", lambda *a, **b: None)
    monkeypatch.setattr(tuning, "tune_recurrent", lambda df, cell, chosen, **b: searched.update(sequence=chosen))
    monkeypatch.setattr(tuning, "tune_additive", lambda df, chosen, **b: searched.update(additive=chosen))
    forecasting.tune_sequence(spark, "")
    forecasting.tune_additive(spark, "")
    assert len(searched["sequence"]) == 30 and len(searched["additive"]) == 20
    assert searched["sequence"] == tuning.read_trials(tuning.sequence_space(spark), RecurrentParams)
    assert searched["additive"] == tuning.read_trials(tuning.additive_space(spark), AdditiveParams)


def test_candidates_fail_for_a_reason(spark):
    rows = spark.createDataFrame([(i, "train" if i < 6 else "holdout") for i in range(10)], "ds int, fold string")
    given = [("good", i, 1.0) for i in range(10)] + [("short", 6, 1.0), ("short", 7, None)] + [("early", 1, 1.0)]
    given += [("twice", i, 1.0) for i in (6, 7, 8, 9, 9)] + [("nan", i, float("nan")) for i in range(6, 10)] + [("unlisted", 6, 1.0)]
    forecasts = spark.createDataFrame(given, "candidate string, ds int, predicted double")
    names = spark.createDataFrame([(n,) for n in ("good", "short", "early", "twice", "nan", "absent", "good")], "candidate string")
    judged = T.judged_forecasts(names, rows, forecasts, keys=["ds"])
    found = {r["candidate"]: tuple(r)[1:] for r in judged.collect()}
    assert found == {
        "good": (6, 4, 4, None),
        "short": (6, 4, 2, "no forecast for 2 rows"),
        "early": (6, 4, 0, "no forecast"),
        "twice": (6, 4, 4, "several forecasts for 1 rows"),
        "nan": (6, 4, 4, "4 forecasts are not finite"),
        "absent": (6, 4, 0, "no forecast"),
    }
    scores = spark.createDataFrame([("good", 0.5, 0.7), ("nan", 0.1, 0.9)], "candidate string, penalty_score double, combined_score double")
    scored = {r["candidate"]: (r["error"], r["penalty_score"], r["combined_score"]) for r in T.score_forecasts(judged, scores).collect()}
    assert scored["good"] == (None, 0.5, 0.7) and scored["nan"] == ("4 forecasts are not finite", 999.0, 0.0)
    assert T.judged_forecasts(names, rows.where("false"), forecasts, keys=["ds"]).where("error = 'no forecast'").count() == 6
