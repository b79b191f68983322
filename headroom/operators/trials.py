"""Trial tables: choosing the best trial, and scoring candidate forecasts with failures among them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headroom.functions import metrics as M

# What a candidate without a usable forecast scores.
FAILED_FITNESS, FAILED_PENALTY = 0.0, 999.0


def with_objective(metrics: DataFrame, smape_weight: float = 0.1, over_provisioning_weight: float = 0.2) -> DataFrame:
    return metrics.withColumn("score", M.objective_score(smape_weight, over_provisioning_weight))


def best_trial(trials: DataFrame, *, by: Sequence[str] = (), score: str = "score", trial: str = "trial") -> DataFrame:
    """The finished trial with the lowest score, the earliest of equals; failed trials never win."""
    finished = trials.where(F.col(score).isNotNull() & ~F.isnan(score))
    if "state" in trials.columns:
        finished = finished.where(F.col("state") == "COMPLETE")
    rest = [c for c in trials.columns if c not in by]
    best = F.min_by(F.struct(*rest), F.struct(F.col(score), F.col(trial))).alias("_best")
    return (
        finished.groupBy(*by)
        .agg(best)
        .where(F.col("_best").isNotNull())
        .select(*by, *[F.col(f"_best.{c}").alias(c) for c in rest])
    )


def normalized_params(columns: Sequence[str]) -> Column:
    """Parameters as a struct, a dropout that was not sampled being 0."""
    return F.struct(
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) if c == "dropout" else F.col(c) for c in columns]
    )


def score_candidates(candidates: DataFrame, scored: DataFrame, *, by: str = "candidate") -> DataFrame:
    """Scores of every listed candidate; one without a score gets the failure values."""
    joined = candidates.join(scored, by, "left")
    failed = F.col("combined_score").isNull()
    return joined.withColumns(
        {
            "error": F.when(failed, F.lit("no forecast")),
            "penalty_score": F.coalesce("penalty_score", F.lit(FAILED_PENALTY)),
            "combined_score": F.coalesce("combined_score", F.lit(FAILED_FITNESS)),
        }
    )


def judged_forecasts(
    candidates: DataFrame,
    rows: DataFrame,
    forecasts: DataFrame,
    *,
    keys: Sequence[str],
    by: str = "candidate",
    fold: str = "fold",
) -> DataFrame:
    """Per listed candidate: rows it could learn from, rows it had to forecast, rows it did, and why it fails, if it does.

    ``rows`` has ``keys`` and ``fold``, ``forecasts`` has ``by``, ``keys`` and ``predicted``. A forecast is usable if every
    holdout row has one finite value; the reason names the first that is not so, in the order missing, repeated, not finite. Forecasts of
    other rows, and of candidates that are not listed, are left out.
    """
    keys = list(keys)
    value = F.col("predicted").cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    asked = rows.where(F.col(fold) == "holdout").select(*keys)
    given = forecasts.join(asked, keys, "left_semi").groupBy(by, *keys).agg(F.count(F.lit(1)).alias("_given"), F.count_if(~finite).alias("_bad"))
    found = given.groupBy(by).agg(
        F.count(F.lit(1)).alias("forecast_rows"),
        F.count_if(F.col("_given") > 1).alias("_repeated"),
        F.sum("_bad").alias("_bad"),
    )
    counts = {f"{label}_rows": rows.agg(F.count_if(F.col(fold) == label)).scalar() for label in ("train", "holdout")}
    joined = candidates.select(by).distinct().join(found, by, "left").withColumns(counts)
    missing = F.col("holdout_rows") - F.coalesce("forecast_rows", F.lit(0))
    reason = (
        F.when(F.col("forecast_rows").isNull(), "no forecast")
        .when(missing > 0, F.concat(F.lit("no forecast for "), missing.cast("string"), F.lit(" rows")))
        .when(F.col("_repeated") > 0, F.concat(F.lit("several forecasts for "), F.col("_repeated").cast("string"), F.lit(" rows")))
        .when(F.col("_bad") > 0, F.concat(F.col("_bad").cast("string"), F.lit(" forecasts are not finite")))
    )
    return joined.select(
        by, "train_rows", "holdout_rows", F.coalesce("forecast_rows", F.lit(0)).cast("bigint").alias("forecast_rows"), reason.alias("error")
    )


def score_forecasts(judged: DataFrame, scored: DataFrame, *, by: str = "candidate") -> DataFrame:
    """``judged_forecasts`` with the scores of those that succeeded; the others get the failure values whatever they scored."""
    joined = judged.join(scored, by, "left")
    failed = F.col("error").isNotNull() | F.col("combined_score").isNull()
    return joined.withColumns(
        {
            "error": F.when(failed, F.coalesce("error", F.lit("no score"))),
            "penalty_score": F.when(failed, F.lit(FAILED_PENALTY)).otherwise(F.col("penalty_score")),
            "combined_score": F.when(failed, F.lit(FAILED_FITNESS)).otherwise(F.col("combined_score")),
        }
    )
