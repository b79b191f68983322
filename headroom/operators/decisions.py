"""Scaling decisions: sharing a pod budget between services, and sizing node pools."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headroom import fixed_values as fixed
from headroom import schemas
from headroom.operators.sizing import DEFAULT_SERVICE_POLICIES, Policies, with_policy


def _priority_scale(policies: Policies) -> int:
    """A whole number every priority divides, so that shares are compared exactly."""
    return math.lcm(*[policy.priority for policy in policies.values()])


def _fill_evenly(df: DataFrame, key: str, deficit: Column, supply: Column, turn: list[Column], name: str) -> DataFrame:
    """Hand out ``supply`` units one by one in turns until each row has its ``deficit``.

    Equal to the round-robin loop, without a loop: the number of whole rounds follows
    from the running sum over rows sorted by deficit, and the units of the last,
    unfinished round go to the first rows in turn order that still need one.
    """
    group = Window.partitionBy(key)
    by_size = group.orderBy("_deficit", *turn).rowsBetween(Window.unboundedPreceding, 0)
    by_turn = group.orderBy(*turn).rowsBetween(Window.unboundedPreceding, 0)
    sized = df.withColumns({"_deficit": deficit, "_supply": supply}).withColumns(
        {
            "_count": F.count(F.lit(1)).over(group),
            "_seen": F.count(F.lit(1)).over(by_size),
            "_sum": F.sum("_deficit").over(by_size),
        }
    )
    used = F.expr("_sum + (_count - _seen) * _deficit")
    level = F.when(
        used <= F.col("_supply"),
        F.col("_deficit")
        + F.expr(
            "CASE WHEN _seen < _count THEN (_supply - (_sum + (_count - _seen) * _deficit)) div (_count - _seen) ELSE 0 END"
        ),
    )
    levelled = sized.withColumn(
        "_rounds", F.greatest(F.max(level).over(group), F.expr("_supply div _count"))
    ).withColumn("_given", F.least("_deficit", "_rounds"))
    open_ = F.col("_deficit") > F.col("_rounds")
    last = levelled.withColumns(
        {
            "_left": F.col("_supply") - F.sum("_given").over(group),
            "_rank": F.sum(open_.cast("int")).over(by_turn),
        }
    )
    extra = F.when(open_ & (F.col("_rank") <= F.col("_left")), 1).otherwise(0)
    return last.withColumn(name, F.col("_given") + extra).drop(
        "_deficit", "_supply", "_count", "_seen", "_sum", "_rounds", "_given", "_left", "_rank"
    )


def share_pod_budget(
    df: DataFrame, pod_budget: int = fixed.POD_BUDGET, policies: Policies = DEFAULT_SERVICE_POLICIES, ds: str = "ds"
) -> DataFrame:
    """Fit the predicted pods of all services at one time into ``pod_budget``.

    * The demand fits: everyone gets it (``within_budget``).
    * The minimums do not fit: they are filled in turns by priority (``budget_below_minimum``).
    * Otherwise everyone starts at the minimum and the rest is shared by
      ``demand above minimum / priority``; whole shares first, then single pods in the
      order of the fractions (``priority_rebalanced``).

    All windows share one shuffle by time. A group holds one row per service of the
    policy table; a repeated service at one time is an error.
    """
    if pod_budget <= 0:
        raise ValueError("pod_budget must be greater than 0")
    schemas.require_columns(df, [ds, "service", "predicted_pods"], "prediction frame")
    scale = _priority_scale(policies)
    at = Window.partitionBy(ds)
    rows = with_policy(df.select(ds, "service", F.col("predicted_pods").cast("int")), policies)
    twice = F.lag("service").over(at.orderBy("service")) == F.col("service")
    repeated = F.raise_error(F.concat(F.lit("repeated service at one time: "), F.col("service")))
    demand = rows.select(
        ds,
        "service",
        "priority",
        "predicted_pods",
        F.when(twice, repeated.cast("bigint")).otherwise(F.col("predicted_pods")).cast("bigint").alias("_want"),
        F.col("min_pods").cast("bigint").alias("_min"),
    ).withColumn("_extra", F.greatest(F.col("_want") - F.col("_min"), F.lit(0)))
    # shares as whole numbers of 38 digits; more than that stops with an overflow, nothing is rounded
    units = F.expr(f"CAST(CAST({scale} AS DECIMAL(38, 0)) / priority AS DECIMAL(27, 0))")
    totals = demand.withColumn("_weight", F.col("_extra").cast("decimal(10, 0)") * units).withColumns(
        {
            "_wanted": F.sum("_want").over(at),
            "_least": F.sum("_min").over(at),
            "_weights": F.sum("_weight").over(at),
        }
    )
    budget = F.lit(pod_budget).cast("bigint")
    reason = (
        F.when(F.col("_wanted") <= budget, "within_budget")
        .when(budget < F.col("_least"), "budget_below_minimum")
        .otherwise("priority_rebalanced")
    )
    shared = F.col("reason") == "priority_rebalanced"
    part = F.expr(f"CAST(CAST({pod_budget} - _least AS DECIMAL(38, 0)) * _weight AS DECIMAL(38, 0))")
    granted = (
        totals.withColumn("reason", reason)
        .withColumns(
            {
                "_part": F.when(shared, part),
                "_urge": F.when(shared, F.col("_extra")).otherwise(0),
            }
        )
        .withColumns(
            {
                "_whole": F.when(shared, F.least(F.expr("_part div _weights"), F.col("_extra"))).otherwise(0).cast("bigint"),
                "_fraction": F.when(shared, F.pmod("_part", "_weights")).otherwise(0),
            }
        )
        .withColumn("_granted", F.sum("_whole").over(at))
        .withColumn("_start", F.when(shared, F.col("_min") + F.col("_whole")).otherwise(0))
    )
    deficit = F.when(shared, F.greatest(F.col("_want") - F.col("_start"), F.lit(0))).otherwise(F.col("_min"))
    supply = F.when(shared, budget - F.col("_least") - F.col("_granted")).otherwise(budget)
    turn = [F.desc("_fraction"), F.desc("_urge"), F.asc("priority"), F.asc("service")]
    filled = _fill_evenly(granted, ds, deficit, supply, turn, "_filled")
    adjusted = F.when(F.col("reason") == "within_budget", F.col("_want")).otherwise(F.col("_start") + F.col("_filled"))
    return filled.select(
        ds,
        "service",
        "predicted_pods",
        adjusted.cast("int").alias("onprem_adjusted_pods"),
        "priority",
        F.lit(pod_budget).alias("pod_budget"),
        "reason",
    )


def size_node_pools(df: DataFrame, policies: Policies = DEFAULT_SERVICE_POLICIES, ds: str = "ds") -> DataFrame:
    """Nodes each pool needs at each time, on every row of the pool.

    One window over time and pool: its groups hold one row per service of the pool, so one
    shuffle does what a grouping and a join back would.
    """
    schemas.require_columns(df, [ds, "service", "predicted_pods"], "prediction frame")
    pool = Window.partitionBy(ds, "node_pool", "node_pod_capacity")
    rows = with_policy(df.select(ds, "service", F.col("predicted_pods").cast("int")), policies)
    nodes = F.ceil(F.col("node_pool_predicted_pods") / F.col("node_pod_capacity")).cast("int")
    return (
        rows.select(ds, "service", "predicted_pods", "node_pool", "node_pod_capacity")
        .withColumn("node_pool_predicted_pods", F.sum("predicted_pods").over(pool))
        .withColumn("required_nodes", F.greatest(nodes, F.lit(1)))
        .withColumn(
            "reason", F.when(F.col("required_nodes") > 1, "node_pool_scale_out").otherwise("baseline_capacity")
        )
    )
