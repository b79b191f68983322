"""Ranking of models by capacity risk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headroom import fixed_values as fixed
from headroom import schemas


def _badness() -> list[Column]:
    """Numbers to be small, in order: under-provisioning, error, lack of accuracy, over-provisioning.

    A null or NaN metric is worse than any number.
    """
    signed = {"under_provisioning_rate": 1, "smape": 1, "pod_accuracy": -1, "over_provisioning_rate": 1}
    worst = F.lit(float("inf"))
    return [F.coalesce(F.nanvl(F.col(name) * sign, worst), worst) for name, sign in signed.items()]


def ranking_keys(tie: str = "model") -> list[Column]:
    """Least capacity risk first, null and NaN metrics last, then the tie-break."""
    return [*_badness(), F.asc(tie)]


def rank_models(metrics: DataFrame, *, by: Sequence[str] = (), tie: str = "model") -> DataFrame:
    """Add ``rank`` 1..n, overall (a table of models is small) or within each group of ``by``."""
    schemas.require_columns(metrics, ["model", *schemas.METRIC_COLUMNS, *by], "metric table")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*ranking_keys(tie)))
    return metrics.select(rank.alias("rank"), *metrics.columns)


def best_model(metrics: DataFrame, *, by: Sequence[str] = (), tie: str = "model") -> DataFrame:
    """The first model of the ranking with the rule it was chosen by.

    With ``by`` the choice is one aggregation with partial results, no sort per group.
    """
    if not by:
        ranked = rank_models(metrics, tie=tie).where("rank = 1")
    else:
        key = F.struct(*_badness(), F.col(tie))
        rest = [c for c in metrics.columns if c not in by]
        first = metrics.groupBy(*by).agg(F.min_by(F.struct(*rest), key).alias("_best"))
        ranked = first.select(F.lit(1).alias("rank"), *by, *[F.col(f"_best.{c}").alias(c) for c in rest])
    return ranked.withColumn("selection_rule", F.lit(fixed.SELECTION_RULE))


def model_subset(df: DataFrame, models: Sequence[str] = tuple(fixed.MODEL_NAMES)) -> DataFrame:
    return df.where(F.col("model").isin(list(models)))


def ensure_not_empty(ranked: DataFrame) -> DataFrame:
    if ranked.isEmpty():
        raise schemas.TableError("there is no model to choose from")
    return ranked
