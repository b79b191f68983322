"""Reading and writing predictions, metrics, decisions, trials and model parameters."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headroom import fixed_values as fixed
from headroom import schemas
from headroom.functions.metrics import objective_formula
from headroom.operators import evaluation, ranking, trials
from headroom.schemas import METRIC_COLUMNS, TableError
from headroom.sources.tables import write_table


def write_record(spark: SparkSession, record: Mapping[str, object], path: str) -> str:
    """One JSON object as a one-row text table."""
    spark.createDataFrame([(json.dumps(record, ensure_ascii=False),)], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(path)
    return path


def read_record(spark: SparkSession, path: str) -> dict[str, object]:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def load_model_metrics(spark: SparkSession, path: str, names: Sequence[str] = tuple(fixed.MODEL_NAMES)) -> DataFrame:
    """Metric records ``<name>_metrics.json`` of the named models, in one read.

    All missing models are named in one error, as is a missing metric. ``ordinal`` is the
    place in ``names``; the model name falls back to that of the file.
    """
    wanted = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "ordinal int, file_model string")
    fields = ", ".join(["model string", *[f"{m} double" for m in METRIC_COLUMNS]])
    try:
        read = spark.read.schema(fields).option("multiLine", True).json(f"{path}/*_metrics.json")
        name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)_metrics\.json", 1)
        found = read.select("*", name.alias("file_model"))
        rows = wanted.join(found, "file_model", "left").withColumn(
            "_found", F.coalesce("model", *[F.col(m).cast("string") for m in METRIC_COLUMNS]).isNotNull()
        )
        listed = rows.collect()  # one row per asked model
    except AnalysisException as nothing:
        if "PATH_NOT_FOUND" not in str(nothing):
            raise
        listed = []
    present = {row["file_model"] for row in listed if row["_found"]}
    missing = [n for n in names if n not in present]
    if missing:
        raise FileNotFoundError("no metrics were written for " + ", ".join(f"{path}/{n}_metrics.json" for n in missing))
    for row in listed:
        for metric in METRIC_COLUMNS:
            if row[metric] is None:
                raise TableError(f"the record of {row['file_model']} lacks {metric}")
    return rows.select(F.coalesce("model", "file_model").alias("model"), *METRIC_COLUMNS, "ordinal").orderBy("ordinal")


def save_model_outputs(
    name: str, predictions: DataFrame, path: str, extra: Mapping[str, object] | None = None, fmt: str = "parquet"
) -> dict[str, object]:
    """Write predictions (partitioned by model) and the metric record; returns the record.

    Extra entries may not replace the record's own.
    """
    spark = predictions.sparkSession
    where = f"{path}/predictions"
    keys = ["model", "prediction_path", *METRIC_COLUMNS]
    clash = sorted(set(extra or {}) & set(keys))
    if clash:
        raise TableError(f"these entries of the record are taken: {clash}")
    write_table(predictions.withColumn("model", F.lit(name)), where, fmt, by=["model"])
    written = spark.read.format(fmt).option("header", True).load(where).where(F.col("model") == name)
    metrics = evaluation.evaluate(written.select(*[F.col(c).cast("double") for c in ("actual", "predicted")])).first()
    record = {"model": name, "prediction_path": where, **metrics.asDict(), **(extra or {})}
    write_record(spark, record, f"{path}/{name}_metrics.json")
    return record


def write_comparison_outputs(ranked: DataFrame, path: str, fmt: str = "parquet") -> dict[str, str]:
    """The ranked table and the record of the best model with the rule that chose it."""
    ranking.ensure_not_empty(ranked)
    best = ranked.orderBy("rank").first().asDict()
    return {
        "comparison_results": write_table(ranked, f"{path}/comparison_results", fmt),
        "best_model": write_record(
            ranked.sparkSession, {**best, "selection_rule": fixed.SELECTION_RULE}, f"{path}/best_model.json"
        ),
    }


def write_service_outputs(
    predictions: DataFrame,
    metrics: DataFrame,
    decisions: DataFrame,
    summary: Mapping[str, object],
    path: str,
    fmt: str = "parquet",
) -> dict[str, object]:
    """Predictions, metrics, decisions and one summary record of a service run."""
    spark = predictions.sparkSession
    record = {
        **summary,
        "prediction_path": write_table(predictions, f"{path}/service_predictions", fmt),
        "metric_path": write_table(metrics, f"{path}/service_metrics", fmt),
        "onprem_decision_path": write_table(decisions, f"{path}/onprem_scaling_decisions", fmt),
    }
    write_record(spark, record, f"{path}/service_summary.json")
    return record


def write_tuning_outputs(
    model: str,
    trial_table: DataFrame,
    params: Sequence[str],
    path: str,
    tuned_metrics: Mapping[str, object] | None = None,
    fmt: str = "parquet",
    chosen: Mapping[str, object] | None = None,
) -> dict[str, object]:
    """All trials, the parameters of the chosen one (dropout filled in) and a summary record.

    ``chosen`` (its ``trial`` and ``score``) is the trial that was refitted; without it the best single row is taken.
    """
    spark = trial_table.sparkSession
    where = write_table(trial_table, f"{path}/{model}_tuning_trials", fmt)
    if chosen is None:
        best = trials.best_trial(trial_table).first()
    else:
        own = trial_table.where(F.col("trial") == F.lit(chosen["trial"])).drop("score")
        best = own.withColumn("score", F.lit(chosen["score"])).first()
    if best is None:
        raise TableError("there is no finished trial to choose from")
    found = {name: best[name] for name in params if name in trial_table.columns}
    if "num_layers" in found:
        found["dropout"] = found.get("dropout") or 0.0
    params_path = write_record(spark, found, f"{path}/{model}_best_params.json")
    summary = {
        "model": model,
        "tuned_model": f"{model}_tuned",
        "best_trial": best["trial"],
        "best_objective_score": best["score"],
        "objective_formula": objective_formula(),
        "best_params_path": params_path,
        "trials_path": where,
        "tuned_metrics": dict(tuned_metrics or {}),
    }
    write_record(spark, summary, f"{path}/{model}_tuning_summary.json")
    return summary


def write_parameters(table: DataFrame, path: str) -> str:
    """Model parameters (name, shape, values per series and trial) as parquet."""
    schemas.require_columns(table, ["param", "shape", "values"], "parameter table")
    return write_table(table, path)


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    return schemas.require_columns(spark.read.parquet(path), ["param", "shape", "values"], path)
