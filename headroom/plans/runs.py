"""Whole runs: from load history to predictions, metrics, decisions and tuned models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headroom import fixed_values as fixed
from headroom.operators import decisions, evaluation, features, sizing, tuning
from headroom.operators.forecast import additive, recurrent, seasonal_ar
from headroom.operators.forecast.additive import AdditiveParams, Design
from headroom.operators.forecast.cells import RecurrentParams
from headroom.operators.forecast.frames import prediction_frame
from headroom.operators.forecast.pooled import Pooling
from headroom.session import settle
from headroom.sources import manifest, results


def _holdout(df: DataFrame) -> DataFrame:
    return df.where(F.col("fold") == "holdout")


def run_additive(
    df: DataFrame,
    params: AdditiveParams = AdditiveParams(),
    design: Design = Design(),
    *,
    series: Sequence[str],
    model: str = "additive",
) -> DataFrame:
    """Predictions of the holdout by the seasonal forecaster; needs ``fold``."""
    models = additive.fit_additive(df.where(F.col("fold") == "train"), params, design, series=series)
    predicted = additive.predict_additive(models, _holdout(df), params, design, series=series)
    return prediction_frame(_holdout(df), predicted, model, keys=[*series, "ds"])


def run_recipe(
    df: DataFrame,
    params: AdditiveParams = additive.RECIPE,
    transform: features.TargetTransform = features.TRANSFORMS["identity"],
    *,
    series: Sequence[str],
    model: str = "recipe",
) -> DataFrame:
    """The recipe model: its regressors, monthly season, and a transform around the fit."""
    prepared = features.transform_target(features.recipe_features(df), transform, "y", "_fit")
    design = additive.RECIPE_DESIGN
    models = additive.fit_additive(
        prepared.where(F.col("fold") == "train"), params, design, series=series, target="_fit"
    )
    raw = additive.predict_additive(models, _holdout(prepared), params, design, series=series, floor=False)
    return prediction_frame(_holdout(df), features.inverse_target(raw, transform), model, keys=[*series, "ds"])


def run_seasonal_ar(
    df: DataFrame,
    order: features.SeasonalOrder = features.SeasonalOrder(),
    *,
    series: Sequence[str],
    step: int | None = None,
    model: str = "seasonal_ar",
) -> DataFrame:
    """Predictions of the holdout by the seasonal autoregression with the eight model features."""
    featured = features.add_cyclic_features(df)
    models, ready = seasonal_ar.fit_seasonal_ar(featured, order, series=series, step=step)
    predicted = seasonal_ar.forecast_seasonal_ar(models, ready, order, series=series)
    return prediction_frame(_holdout(df), predicted, model, keys=[*series, "ds"])


def run_sequence(
    df: DataFrame,
    cell: str,
    params: RecurrentParams = RecurrentParams(),
    *,
    series: Sequence[str],
    step: int | None = None,
    seed: int = 42,
    model: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Train a recurrent model per series and forecast its holdout: models and predictions."""
    models, predicted = tuning.refit_recurrent(df, cell, params, series=series, step=step, seed=seed)
    return models, prediction_frame(_holdout(df), predicted, model or cell, keys=[*series, "ds"])


def run_pooled(
    df: DataFrame,
    cell: str,
    params: RecurrentParams = RecurrentParams(),
    pooling: Pooling = Pooling(),
    *,
    series: Sequence[str],
    step: int | None = None,
    seed: int = 42,
    model: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Train one recurrent model over all series and forecast the holdout of each: models and predictions."""
    models, predicted = tuning.refit_pooled(df, cell, params, pooling, series=series, step=step, seed=seed)
    return models, prediction_frame(_holdout(df), predicted, model or f"pooled_{cell}", keys=[*series, "ds"])


def run_services(
    df: DataFrame,
    params: RecurrentParams = RecurrentParams(epochs=30),
    policies: sizing.Policies = sizing.DEFAULT_SERVICE_POLICIES,
    pod_budget: int = fixed.POD_BUDGET,
    *,
    step: int | None = None,
    model: str = "service_gru",
) -> dict[str, DataFrame]:
    """One model per service, its pods and metrics, and the budgeted decisions.

    The predictions are written once, so that none of their readers trains again.
    """
    models, framed = run_sequence(df, "gru", params, series=["service"], step=step, model=model)
    predictions = settle(sizing.add_service_pod_columns(framed, policies))
    return {
        "models": models,
        "predictions": predictions,
        "metrics": evaluation.service_metrics(predictions, policies, step=step),
        "decisions": decisions.share_pod_budget(predictions, pod_budget, policies),
        "node_pools": decisions.size_node_pools(predictions, policies),
        "weighted_under": evaluation.priority_weighted_under_provisioning(predictions, policies),
    }


def save_services(
    run: Mapping[str, DataFrame], path: str, params: RecurrentParams, pod_budget: int = fixed.POD_BUDGET
) -> dict[str, object]:
    """Publish a service run with its summary: readers see all of it, by its manifest, or the run before."""
    weighted = run["weighted_under"].first()[0]
    services = [row[0] for row in run["metrics"].select("service").orderBy("service").collect()]
    summary = {
        "model": "service_gru",
        "services": services,
        "priority_weighted_under_provisioning_rate": weighted,
        "sequence_length": params.sequence_length,
        "epochs": params.epochs,
        "hidden_size": params.hidden_size,
        "learning_rate": params.learning_rate,
        "onprem_pod_budget": pod_budget,
    }
    with manifest.publish(run["predictions"].sparkSession, path) as published:
        table = recurrent.parameter_table(run["models"], "gru", params, series=["service"])
        summary["parameter_path"] = results.write_parameters(table, f"{published.folder}/service_gru_parameters")
        published.record = results.write_service_outputs(run["predictions"], run["metrics"], run["decisions"], summary, published.folder)
    return published.record


def _row_counts(df: DataFrame) -> dict[str, int]:
    """Rows per fold, as the records of tuned models hold them."""
    counts = {row["fold"]: row["n"] for row in df.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {f"{fold}_rows": counts.get(fold, 0) for fold in ("train", "validation", "holdout")}


def tune_and_refit(
    df: DataFrame,
    cell: str,
    chosen: Mapping[int, RecurrentParams],
    path: str,
    *,
    series: Sequence[str],
    step: int | None = None,
    seed: int = 42,
) -> dict[str, object]:
    """Search on train and validation rows, refit the best trial on both, score it on the holdout, write all."""
    trial_table = settle(tuning.tune_recurrent(df, cell, chosen, series=series, step=step, seed=seed))
    best = tuning.best_overall(trial_table).first()
    if best is None:
        raise ValueError("no trial completed")
    params = chosen[best["trial"]]
    name = tuning.tuned_name(cell)
    models, predictions = run_sequence(df, cell, params, series=series, step=step, seed=seed, model=name)
    with manifest.publish(df.sparkSession, path) as published:
        where = results.write_parameters(recurrent.parameter_table(models, cell, params, series=series), f"{published.folder}/{name}_parameters")
        extra = {"base_model": cell, "sequence_params": recurrent.params_row(params), "features": recurrent.COLUMNS[1:], "model_path": where}
        record = results.save_model_outputs(name, predictions, published.folder, extra | _row_counts(df))
        published.record = results.write_tuning_outputs(
            cell, trial_table, list(recurrent.params_row(params)), published.folder, record, chosen=best.asDict()
        )
    return published.record


def tune_and_refit_additive(
    df: DataFrame,
    chosen: Mapping[int, AdditiveParams],
    path: str,
    design: Design = Design(),
    *,
    series: Sequence[str],
) -> dict[str, object]:
    """The same for the seasonal forecaster: the best trial is fitted to all rows before the holdout and scored on it once."""
    trial_table = settle(tuning.tune_additive(df, chosen, design, series=series))
    best = tuning.best_overall(trial_table).first()
    if best is None:
        raise ValueError("no trial completed")
    params, name = chosen[best["trial"]], tuning.tuned_name("additive")
    models, predicted = tuning.refit_additive(df, params, design, series=series)
    predictions = prediction_frame(_holdout(df), predicted, name, keys=[*series, "ds"])
    with manifest.publish(df.sparkSession, path) as published:
        where = results.write_parameters(additive.parameter_table(models, series=series), f"{published.folder}/{name}_parameters")
        extra = {"base_model": "additive", "params": asdict(params), "features": list(design.regressors), "model_path": where}
        record = results.save_model_outputs(name, predictions, published.folder, extra | _row_counts(df))
        published.record = results.write_tuning_outputs("additive", trial_table, list(asdict(params)), published.folder, record, chosen=best.asDict())
    return published.record
