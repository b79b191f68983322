from __future__ import annotations

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from headroom import fixed_values as fixed
from headroom.functions.clock import HOUR
from headroom.operators import features, ranking, tuning
from headroom.operators.forecast.additive import AdditiveParams
from headroom.operators.forecast.cells import RecurrentParams
from headroom.operators.sizing import DEFAULT_SERVICE_POLICIES
from headroom.plans import runs
from headroom.sources import manifest, policies, results, tables

GOOD = {"smape": 0.2, "pod_accuracy": 0.8, "under_provisioning_rate": 0.1, "over_provisioning_rate": 0.1}


def write_metric(path, model, **changes):
    (path / f"{model}_metrics.json").write_text(json.dumps({"model": model, **GOOD, **changes}, indent=2))


def test_metrics_of_all_models_are_required(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="no metrics were written"):
        results.load_model_metrics(spark, str(tmp_path))
    write_metric(tmp_path, "gru")
    with pytest.raises(FileNotFoundError) as missing:
        results.load_model_metrics(spark, str(tmp_path))
    assert all(f"/{name}_metrics" in str(missing.value) for name in fixed.MODEL_NAMES if name != "gru")
    assert "/gru_metrics" not in str(missing.value)


def test_metrics_keep_the_order_asked_for(spark, tmp_path):
    write_metric(tmp_path, "prophet")
    write_metric(tmp_path, "gru", under_provisioning_rate=0.05)
    (tmp_path / "odd_metrics.json").write_text(json.dumps(GOOD))
    found = results.load_model_metrics(spark, str(tmp_path), ["prophet", "gru", "odd"]).collect()
    assert [r["model"] for r in found] == ["prophet", "gru", "odd"]
    write_metric(tmp_path, "bad", smape=None)
    with pytest.raises(ValueError, match="lacks smape"):
        results.load_model_metrics(spark, str(tmp_path), ["bad"])


def test_comparison_outputs(spark, tmp_path):
    for i, model in enumerate(fixed.MODEL_NAMES):
        write_metric(tmp_path, model, under_provisioning_rate=0.5 - 0.05 * i)
    ranked = ranking.rank_models(results.load_model_metrics(spark, str(tmp_path)), tie="ordinal")
    out = results.write_comparison_outputs(ranked, str(tmp_path / "out"))
    assert results.read_record(spark, out["best_model"])["model"] == "lstm_tuned"
    assert spark.read.parquet(out["comparison_results"]).count() == 6
    with pytest.raises(ValueError, match="no model to choose from"):
        results.write_comparison_outputs(ranked.limit(0), str(tmp_path / "none"))


@pytest.fixture(scope="module")
def predictions(spark):
    pdf = pd.DataFrame({"ds": pd.date_range("2024-01-01", periods=4, freq="h"), "actual": [10.0, 20, 30, 40], "predicted": [10.0, 10, 40, 40]})
    return spark.createDataFrame(pdf).withColumns(
        {"ds": F.col("ds").cast("timestamp_ntz"), "actual_pods": F.lit(1), "predicted_pods": F.lit(1), "model": F.lit("m")}
    )


def test_model_outputs(spark, tmp_path, predictions):
    with pytest.raises(ValueError, match="are taken"):
        results.save_model_outputs("m", predictions, str(tmp_path), {"model": "other"})
    for name in ("m", "other"):
        record = results.save_model_outputs(name, predictions, str(tmp_path), {"train_rows": 8})
    assert record["train_rows"] == 8 and 0 < record["smape"] < 1
    assert results.read_record(spark, f"{tmp_path}/m_metrics.json")["pod_accuracy"] == record["pod_accuracy"]
    read = tables.load_model_predictions(spark, f"{tmp_path}/predictions", ["m", "other"])
    assert read.count() == 8
    with pytest.raises(FileNotFoundError, match="third"):
        tables.load_model_predictions(spark, f"{tmp_path}/predictions", ["m", "third"])
    assert results.load_model_metrics(spark, str(tmp_path), ["other", "m"]).count() == 2


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_readers_check_paths_columns_and_rows(spark, tmp_path, predictions, fmt):
    with pytest.raises(FileNotFoundError):
        tables.load_traffic(spark, str(tmp_path / "nowhere"), fmt)
    path = tables.write_table(predictions, str(tmp_path / "p"), fmt)
    read = tables.load_predictions(spark, path, fmt)
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, predictions.collect()))
    assert dict(read.dtypes)["ds"] == "timestamp_ntz" and dict(read.dtypes)["actual_pods"] == "int"
    with pytest.raises(ValueError, match="missing required columns"):
        tables.load_traffic(spark, path, fmt)
    empty = tables.write_table(predictions.limit(0), str(tmp_path / "e"), "parquet")
    with pytest.raises(ValueError, match="empty"):
        tables.load_predictions(spark, empty)


def test_policies_survive_json(spark, tmp_path):
    assert policies.load_service_policies(spark) == DEFAULT_SERVICE_POLICIES
    path = policies.write_service_policies(spark, str(tmp_path / "p.json"))
    assert policies.load_service_policies(spark, path) == DEFAULT_SERVICE_POLICIES
    with pytest.raises(FileNotFoundError):
        policies.load_service_policies(spark, str(tmp_path / "none.json"))
    (tmp_path / "bad.json").write_text(json.dumps({"payment": {"capacity_per_pod": 1.0}}))
    with pytest.raises(ValueError, match="lacks"):
        policies.load_service_policies(spark, str(tmp_path / "bad.json"))


@pytest.fixture(scope="module")
def service_rows(spark):
    frames = []
    for i, name in enumerate(["payment", "admin"]):
        ds = pd.date_range("2024-01-01", periods=60, freq="h")
        frames.append(
            pd.DataFrame(
                {"service": name, "ds": ds, "y": [50.0 + (h % 24) * (i + 1) for h in range(60)], "is_monsoon": 0,
                 "typhoon_index": 0.0, "hour": ds.hour, "day_of_week": ds.dayofweek, "month": 1}
            )
        )
    return spark.createDataFrame(pd.concat(frames)).withColumn("ds", F.col("ds").cast("timestamp_ntz"))


def test_service_run_is_written_whole(spark, tmp_path, service_rows):
    params = RecurrentParams(sequence_length=4, hidden_size=3, epochs=1)
    df = features.with_fold(service_rows, series=["service"], step=HOUR)
    run = runs.run_services(df, params, pod_budget=6, step=HOUR)
    record = runs.save_services(run, str(tmp_path), params, 6)
    assert record["services"] == ["admin", "payment"] and 0 <= record["priority_weighted_under_provisioning_rate"] <= 1
    assert spark.read.parquet(record["prediction_path"]).count() == 24
    decisions = spark.read.parquet(record["onprem_decision_path"])
    assert decisions.groupBy("ds").agg(F.sum("onprem_adjusted_pods").alias("n")).where("n > 6").isEmpty()
    published = manifest.current(spark, str(tmp_path))
    assert published.record["prediction_path"] == record["prediction_path"]
    assert results.read_parameters(spark, f"{published.folder}/service_gru_parameters").count() == 2 * 6


def test_readers_see_whole_runs_only(spark, tmp_path, service_rows, monkeypatch):
    """A run that dies between two writes changes nothing for readers; the next whole one does."""
    path, params = str(tmp_path), RecurrentParams(sequence_length=4, hidden_size=2, epochs=1)
    with pytest.raises(FileNotFoundError):
        manifest.current(spark, path)
    run = runs.run_services(features.with_fold(service_rows, series=["service"], step=HOUR), params, pod_budget=6, step=HOUR)
    first = runs.save_services(run, path, params, 6)

    def dies(*args, **kwargs):
        raise RuntimeError("lost between two writes")

    with monkeypatch.context() as broken:
        broken.setattr(results, "write_record", dies)  # predictions, metrics and decisions are written by then
        with pytest.raises(RuntimeError, match="between two writes"):
            runs.save_services(run, path, params, 3)
    seen = manifest.current(spark, path).record
    assert seen == first and seen["onprem_pod_budget"] == 6 and spark.read.parquet(seen["prediction_path"]).count() == 24
    assert len(list((tmp_path / "_runs").iterdir())) == 2
    runs.save_services(run, path, params, 3)
    assert manifest.current(spark, path).record["onprem_pod_budget"] == 3


def test_tuning_run_is_written_whole(spark, tmp_path, service_rows):
    df = features.with_fold(service_rows, series=["service"], step=HOUR, validation_ratio=0.2)
    trials = {
        0: RecurrentParams(sequence_length=4, hidden_size=3, epochs=1),
        1: RecurrentParams(sequence_length=900, hidden_size=3, epochs=1),
    }
    summary = runs.tune_and_refit(df, "gru", trials, str(tmp_path), series=["service"], step=HOUR)
    assert (summary["best_trial"], summary["tuned_model"]) == (0, "gru_tuned")
    assert results.read_record(spark, summary["best_params_path"])["dropout"] == 0.0
    assert spark.read.parquet(summary["trials_path"]).where("state = 'FAIL'").count() == 2
    tuned = summary["tuned_metrics"]
    assert tuned["base_model"] == "gru" and tuned["features"] == fixed.MODEL_FEATURES
    counts = {row["fold"]: row["count"] for row in df.groupBy("fold").count().collect()}
    assert {f"{fold}_rows": n for fold, n in counts.items()}.items() <= tuned.items()
    assert results.read_parameters(spark, tuned["model_path"]).count() > 0 and manifest.current(spark, str(tmp_path)).record["best_trial"] == 0


def test_additive_search_is_refitted_and_written_whole(spark, tmp_path, service_rows):
    df = features.with_fold(service_rows, series=["service"], step=HOUR, validation_ratio=0.2)
    trials = {0: AdditiveParams(), 1: AdditiveParams("multiplicative", 0.5), 2: AdditiveParams(changepoints="sparse")}
    summary = runs.tune_and_refit_additive(df, trials, str(tmp_path), series=["service"])
    assert summary["tuned_model"] == "additive_tuned" and summary["best_trial"] in trials
    tuned = summary["tuned_metrics"]
    assert tuned["train_rows"] + tuned["validation_rows"] + tuned["holdout_rows"] == df.count()
    predictions = spark.read.parquet(tuned["prediction_path"])
    assert predictions.count() == tuned["holdout_rows"] and predictions.where("predicted < 0 OR predicted IS NULL").isEmpty()
    assert results.read_parameters(spark, tuned["model_path"]).where("param = 'trend'").count() == 2


def test_the_trial_with_the_best_mean_is_the_written_one(spark, tmp_path):
    rows = [("x", 0, 0.10, 0.5), ("x", 1, 0.30, 0.7), ("y", 0, 0.90, 0.5), ("y", 1, 0.30, 0.7)]
    table = spark.createDataFrame(rows, "service string, trial int, score double, factor double")
    table = table.selectExpr("*", "'COMPLETE' AS state", "CAST(NULL AS STRING) AS error")
    best = tuning.best_overall(table).first()
    summary = results.write_tuning_outputs("model", table, ["factor"], str(tmp_path), chosen=best.asDict())
    assert (best["trial"], summary["best_trial"], summary["best_objective_score"]) == (1, 1, 0.30)
    assert results.read_record(spark, summary["best_params_path"]) == {"factor": 0.7}


def test_parameters_of_a_model_come_from_json(spark, tmp_path):
    def load(kind, **given):
        return policies.load_params(spark, kind, results.write_record(spark, given, str(tmp_path / "params.json")))

    assert policies.load_params(spark, AdditiveParams) == AdditiveParams()
    assert load(AdditiveParams, seasonality_mode="multiplicative", holidays_prior_scale=2) == AdditiveParams("multiplicative", holidays_prior_scale=2.0)
    assert load(RecurrentParams, epochs=7, dropout=0.1, num_layers=2) == RecurrentParams(epochs=7, dropout=0.1, num_layers=2)
    with pytest.raises(ValueError, match="has no"):
        load(AdditiveParams, growth="flat")
    with pytest.raises(ValueError, match="of type int"):
        load(RecurrentParams, epochs="7")
    with pytest.raises(ValueError, match="changepoint_range"):
        load(AdditiveParams, changepoint_range=2.0)
    with pytest.raises(FileNotFoundError):
        policies.load_params(spark, AdditiveParams, str(tmp_path / "absent.json"))
