"""Ranking and trial queries over forecasts of the service traffic."""

from __future__ import annotations

from pyspark.sql import functions as F

from headroom.functions.clock import HOUR
from headroom.operators import evaluation as V
from headroom.operators import ranking as R
from headroom.operators import features, reports, trials
from headroom.plans.catalog import sql as S
from headroom.plans.catalog.common import rounded
from headroom.plans.catalog.evaluation import _MODEL_CARD, _card
from headroom.plans.traffic import model_predictions, service_predictions, service_traffic
from headroom.schemas import METRIC_COLUMNS
from headroom.session import scratch_path, settle
from headroom.sources import results

PAIRS = [("DAY", "Baseline", "day"), ("DAY", "Tuned", "padded"), ("WEEK", "Baseline", "week"), ("WEEK", "Tuned", "blend")]
TRIALS = 10


def model_metrics(spark, sf_dir, *by):
    return rounded(V.evaluate(model_predictions(spark, sf_dir), by=["model", *by]), METRIC_COLUMNS, 6)


def rank_models(spark, sf_dir):
    return R.rank_models(model_metrics(spark, sf_dir))


def rank_models_per_service(spark, sf_dir):
    return R.rank_models(model_metrics(spark, sf_dir, "service"), by=["service"])


def best_model(spark, sf_dir):
    return R.best_model(model_metrics(spark, sf_dir))


def best_model_per_service(spark, sf_dir):
    return R.best_model(model_metrics(spark, sf_dir, "service"), by=["service"])


def model_subset(spark, sf_dir):
    return R.rank_models(R.model_subset(model_metrics(spark, sf_dir), ["week", "padded"]))


def tuning_pivot(spark, sf_dir):
    return reports.tuning_comparison(model_metrics(spark, sf_dir), "smape", PAIRS)


def trial_scores(spark, sf_dir):
    """A trial per factor applied to yesterday's value, scored by the tuning objective."""
    entries = F.array(
        *[F.struct(F.lit(i).alias("trial"), F.lit(0.7 + 0.1 * i).alias("factor")) for i in range(TRIALS)]
    )
    tried = service_predictions(spark, sf_dir).withColumn("_t", F.explode(entries))
    tried = tried.select("service", "actual", "_t.trial", "_t.factor", (F.col("predicted") * F.col("_t.factor")).alias("predicted"))
    scored = V.evaluate(tried, by=["service", "trial", "factor"])
    return rounded(trials.with_objective(scored), ["score"], 6)


def best_trial(spark, sf_dir):
    best = trials.best_trial(trial_scores(spark, sf_dir), by=["service"])
    return rounded(best.select("service", "trial", "factor", "score"), ["factor"], 6)


def save_comparison(spark, sf_dir):
    """The ranking written with its best model, and read back."""
    paths = results.write_comparison_outputs(rank_models(spark, sf_dir), scratch_path(spark, "comparison"))
    best = results.read_record(spark, paths["best_model"])
    written = spark.read.parquet(paths["comparison_results"])
    return written.withColumn("chosen", F.col("model") == F.lit(best["model"]))


def save_tuning(spark, sf_dir):
    """A search written with the trial of the lowest mean score: summary and parameters read back."""
    tried, path = settle(trial_scores(spark, sf_dir)), scratch_path(spark, "tuning")
    best = trials.best_trial(tried.groupBy("trial").agg(F.avg("score").alias("score"))).first()
    summary = results.write_tuning_outputs("naive", tried, ["factor"], path, chosen=best.asDict())
    factor = results.read_record(spark, summary["best_params_path"])["factor"]
    written = spark.read.parquet(summary["trials_path"])
    own = written.where(F.col("trial") == F.lit(summary["best_trial"]))
    return rounded(own.select("service", "trial", F.lit(float(factor)).alias("factor"), "score"), ["factor"], 6)


def score_candidates(spark, sf_dir):
    """Candidates by model name, one of which never delivered."""
    df = model_predictions(spark, sf_dir).withColumnRenamed("model", "candidate")
    scored = V.score_card(df, series=["candidate", "service"], step=HOUR).select(
        "candidate", "service", "penalty_score", "combined_score"
    )
    names = spark.createDataFrame([(n,) for n in ("day", "week", "blend", "padded", "absent")], "candidate string")
    return rounded(trials.score_candidates(names, scored), ["penalty_score", "combined_score"], 6)


def judged_candidates(spark, sf_dir):
    """Forecasts of the holdout hours, damaged in several ways: candidates with their row counts, reasons and scores."""
    rows = settle(features.with_fold(service_traffic(spark, sf_dir), series=["service"], step=HOUR))
    held = rows.where("fold = 'holdout'").select("ds", "service")
    given = model_predictions(spark, sf_dir).withColumnRenamed("model", "candidate").join(held, ["ds", "service"], "left_semi")
    at = F.hour("ds")
    late, broken = (F.col("candidate") == "week") & (at < 6), (F.col("candidate") == "padded") & (at == 7)
    damaged = given.where(~late).withColumn("predicted", F.when(broken, F.lit(float("nan"))).otherwise(F.col("predicted")))
    damaged = settle(damaged.unionByName(damaged.where((F.col("candidate") == "blend") & (at == 5))))
    names = spark.createDataFrame([(n,) for n in ("day", "week", "blend", "padded", "absent")], "candidate string")
    judged = trials.judged_forecasts(names, rows, damaged, keys=["ds", "service"])
    whole = damaged.join(judged.where("error IS NULL"), "candidate", "left_semi")
    scored = V.score_card(whole, series=["candidate", "service"], step=HOUR).select("candidate", "service", "penalty_score", "combined_score")
    return rounded(trials.score_forecasts(judged, scored), ["penalty_score", "combined_score"], 6)


QUERIES = {
    "rank_models": rank_models,
    "rank_models_per_service": rank_models_per_service,
    "best_model": best_model,
    "best_model_per_service": best_model_per_service,
    "model_subset": model_subset,
    "tuning_pivot": tuning_pivot,
    "best_trial": best_trial,
    "save_comparison": save_comparison,
    "save_tuning": save_tuning,
    "score_candidates": score_candidates,
    "judged_candidates": judged_candidates,
}

# --- SQL checks -----------------------------------------------------------------

_BY_MODEL = f"{S.MODELS}, measured AS (SELECT model, {S.CORE} FROM model_pods GROUP BY 1)"
_BY_SERVICE = f"{S.MODELS}, measured AS (SELECT model, service, {S.CORE} FROM model_pods GROUP BY 1, 2)"
_KEYS = "under_provisioning_rate, smape, pod_accuracy DESC, over_provisioning_rate, model"
_RULE = "'Lowest under_provisioning_rate, then lowest smape, highest pod_accuracy, lowest over_provisioning_rate.'"


def _ranked(source: str, extra: str = "", partition: str = "", condition: str = "TRUE") -> str:
    over = f"PARTITION BY {partition} ORDER BY {_KEYS}" if partition else f"ORDER BY {_KEYS}"
    return f"WITH {source}, ranked AS (SELECT CAST(row_number() OVER ({over}) AS INTEGER) AS rank, *{extra} FROM measured WHERE {condition})"


_TRIALS = f"""{S.PREDICTIONS},
tried AS (
  SELECT service, actual, t AS trial, 0.7::DOUBLE + 0.1::DOUBLE * t AS factor, predicted * (0.7::DOUBLE + 0.1::DOUBLE * t) AS predicted
  FROM predictions CROSS JOIN (SELECT CAST(unnest(range({TRIALS})) AS INTEGER) AS t)),
trial_pods AS (SELECT *, {S.default_pods('actual')} AS actual_pods, {S.default_pods('predicted')} AS predicted_pods FROM tried),
scored AS (
  SELECT service, trial, factor, {S.rounded(
      f"{S.rate('predicted_pods < actual_pods')} + 0.1::DOUBLE * {S.smape()} + 0.2::DOUBLE * {S.rate('predicted_pods > actual_pods')}", 6)} AS score
  FROM trial_pods GROUP BY 1, 2, 3)"""

ORACLE = {
    "rank_models": f"{_ranked(_BY_MODEL)} SELECT * FROM ranked",
    "rank_models_per_service": f"{_ranked(_BY_SERVICE, partition='service')} SELECT * FROM ranked",
    "best_model": f"{_ranked(_BY_MODEL, f', {_RULE} AS selection_rule')} SELECT * FROM ranked WHERE rank = 1",
    "best_model_per_service": f"{_ranked(_BY_SERVICE, f', {_RULE} AS selection_rule', 'service')} SELECT * FROM ranked WHERE rank = 1",
    "model_subset": f"""{_ranked(_BY_MODEL, condition="model IN ('week', 'padded')")} SELECT * FROM ranked""",
    "tuning_pivot": f"""WITH {_BY_MODEL}, pairs AS (SELECT * FROM (VALUES {', '.join(str(p) for p in PAIRS)}) AS t(family, label, model))
        SELECT family, max(CASE WHEN label = 'Baseline' THEN smape END) AS "Baseline", max(CASE WHEN label = 'Tuned' THEN smape END) AS "Tuned"
        FROM pairs JOIN measured USING (model) GROUP BY 1""",
    "best_trial": f"""WITH {_TRIALS} SELECT service, trial, {S.rounded('factor', 6)} AS factor, score FROM (
        SELECT *, row_number() OVER (PARTITION BY service ORDER BY score, trial) AS k FROM scored) WHERE k = 1""",
    "save_comparison": f"{_ranked(_BY_MODEL)} SELECT *, rank = 1 AS chosen FROM ranked",
    "save_tuning": f"""WITH {_TRIALS}, best AS (
          SELECT trial FROM (SELECT trial, avg(score) AS mean FROM scored GROUP BY 1) ORDER BY mean, trial LIMIT 1)
        SELECT service, trial, {S.rounded('factor', 6)} AS factor, score FROM scored WHERE trial = (SELECT trial FROM best)""",
    "score_candidates": f"""WITH {_MODEL_CARD}
        SELECT n.candidate, c.service, CASE WHEN c.model IS NULL THEN 'no forecast' END AS error,
          {S.rounded('coalesce(penalty_score, 999)', 6)} AS penalty_score, {S.rounded('coalesce(1 / (1 + penalty_score), 0)', 6)} AS combined_score
        FROM (SELECT unnest(['day', 'week', 'blend', 'padded', 'absent']) AS candidate) n LEFT JOIN card c ON c.model = n.candidate""",
    "judged_candidates": f"""WITH {S.MODELS}, numbered AS (
          SELECT ds, service, row_number() OVER (PARTITION BY service ORDER BY ds)
            <= floor(CAST(count(*) OVER (PARTITION BY service) AS DOUBLE) * {S.number(1 - 0.2)}) AS known FROM traffic),
        held AS (SELECT m.* FROM models m JOIN numbered n ON n.ds = m.ds AND n.service = m.service AND NOT n.known),
        counts AS (SELECT count(*) FILTER (known) AS train_rows, count(*) FILTER (NOT known) AS holdout_rows,
            count(*) FILTER (NOT known AND hour(ds) < 6) AS late, count(*) FILTER (NOT known AND hour(ds) = 5) AS twice,
            count(*) FILTER (NOT known AND hour(ds) = 7) AS broken FROM numbered),
        {_card("(SELECT *, model AS candidate FROM held WHERE model = 'day')", 'candidate, service')}
        SELECT n.candidate, train_rows, holdout_rows,
          CASE n.candidate WHEN 'absent' THEN 0 WHEN 'week' THEN holdout_rows - late ELSE holdout_rows END AS forecast_rows,
          CASE n.candidate WHEN 'absent' THEN 'no forecast' WHEN 'week' THEN 'no forecast for ' || late || ' rows'
            WHEN 'blend' THEN 'several forecasts for ' || twice || ' rows' WHEN 'padded' THEN broken || ' forecasts are not finite' END AS error,
          c.service, {S.rounded('coalesce(penalty_score, 999)', 6)} AS penalty_score,
          {S.rounded('coalesce(1 / (1 + penalty_score), 0)', 6)} AS combined_score
        FROM (SELECT unnest(['day', 'week', 'blend', 'padded', 'absent']) AS candidate) n CROSS JOIN counts
        LEFT JOIN card c ON c.candidate = n.candidate""",
}
