"""Scaling decision queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from headroom import fixed_values as fixed
from headroom.functions.clock import HOUR
from headroom.operators import decisions as D
from headroom.operators import evaluation
from headroom.operators import sizing as Z
from headroom.plans.catalog import sql as S
from headroom.plans.traffic import service_predictions
from headroom.session import scratch_path, settle
from headroom.sources import policies, results

# Above the demand of most hours, the usual budget, below it, and below the sum of the minimums (9).
BUDGETS = {"allocate": fixed.POD_BUDGET, "allocate_tight": 14, "allocate_scarce": 11, "allocate_below_minimum": 8}


def sized_predictions(spark, sf_dir):
    return Z.add_service_pod_columns(service_predictions(spark, sf_dir))


def _allocate(budget: int):
    return lambda spark, sf_dir: D.share_pod_budget(sized_predictions(spark, sf_dir), budget)


def policies_from_json(spark, sf_dir):
    """Pods of service predictions under policies that went through their JSON form."""
    path = policies.write_service_policies(spark, scratch_path(spark, "policies"))
    read = policies.load_service_policies(spark, path)
    return Z.add_service_pod_columns(service_predictions(spark, sf_dir), read)


def policy_rows(spark, sf_dir):
    """The policy of every service that has load, from the JSON form, with the rules it breaks."""
    path = policies.write_service_policies(spark, scratch_path(spark, "policies"))
    loaded = service_predictions(spark, sf_dir).groupBy("service").agg(F.count("*").alias("hours"))
    rows = policies.policy_rows(spark, path)
    broken = Z.policy_violations(rows).select("service", F.size("violations").alias("broken"))
    joined = loaded.join(rows, "service").join(broken, "service", "left")
    return joined.select("service", "hours", "capacity_per_pod", "max_pods", F.coalesce("broken", F.lit(0)).alias("broken"))


def save_services(spark, sf_dir):
    """Decisions written with predictions, metrics and a summary, and read back."""
    sized = settle(sized_predictions(spark, sf_dir))
    record = results.write_service_outputs(
        sized, evaluation.service_metrics(sized, step=HOUR), D.share_pod_budget(sized, 14), {"pod_budget": 14}, scratch_path(spark, "services")
    )
    return spark.read.parquet(record["onprem_decision_path"])


QUERIES = {
    "policies_from_json": policies_from_json,
    "policy_rows": policy_rows,
    "save_services": save_services,
    **{name: _allocate(budget) for name, budget in BUDGETS.items()},
    "node_pools": lambda spark, sf_dir: D.size_node_pools(sized_predictions(spark, sf_dir)),
}

# --- SQL checks: units are listed one by one and handed out in turn order ---------

_SCALE = math.lcm(*[values[4] for values in fixed.SERVICE_POLICIES.values()])


def allocation(budget: int) -> str:
    return f"""{S.SIZED},
demand AS (
  SELECT *, greatest(predicted_pods - min_pods, 0) AS extra, sum(predicted_pods) OVER t AS wanted, sum(min_pods) OVER t AS least_pods
  FROM sized WINDOW t AS (PARTITION BY ds)),
weighted AS (
  SELECT *, extra * ({_SCALE} // priority) AS weight, sum(extra * ({_SCALE} // priority)) OVER (PARTITION BY ds) AS weights,
    CASE WHEN wanted <= {budget} THEN 'within_budget' WHEN {budget} < least_pods THEN 'budget_below_minimum'
         ELSE 'priority_rebalanced' END AS reason
  FROM demand),
shares AS (
  SELECT *, CASE WHEN reason = 'priority_rebalanced' THEN least((({budget} - least_pods) * weight) // weights, extra) ELSE 0 END AS whole,
    CASE WHEN reason = 'priority_rebalanced' THEN (({budget} - least_pods) * weight) % weights ELSE 0 END AS fraction,
    CASE WHEN reason = 'priority_rebalanced' THEN extra ELSE 0 END AS urge
  FROM weighted),
starts AS (
  SELECT *, CASE WHEN reason = 'priority_rebalanced' THEN min_pods + whole ELSE 0 END AS start_pods,
    CASE reason WHEN 'priority_rebalanced' THEN {budget} - least_pods - sum(whole) OVER (PARTITION BY ds) ELSE {budget} END AS supply
  FROM shares),
units AS (
  SELECT ds, service, supply, row_number() OVER (PARTITION BY ds ORDER BY j, fraction DESC, urge DESC, priority, service) AS place
  FROM (SELECT *, unnest(range(1, CAST(greatest(
          CASE reason WHEN 'priority_rebalanced' THEN predicted_pods - start_pods ELSE min_pods END, 0) AS BIGINT) + 1)) AS j FROM starts)),
given AS (SELECT ds, service, count(*) AS pods FROM units WHERE place <= supply GROUP BY 1, 2),
decisions AS (
  SELECT s.ds, s.service, predicted_pods,
    CAST(CASE WHEN reason = 'within_budget' THEN predicted_pods ELSE start_pods + coalesce(g.pods, 0) END AS INTEGER) AS onprem_adjusted_pods,
    priority, {budget} AS pod_budget, reason
  FROM starts s LEFT JOIN given g ON g.ds = s.ds AND g.service = s.service)"""


ORACLE = {
    "policies_from_json": f"WITH {S.SIZED} SELECT ds, service, actual, predicted, actual_pods, predicted_pods FROM sized",
    "policy_rows": f"""WITH {S.PREDICTIONS}, {S.POLICIES}
        SELECT service, count(*) AS hours, any_value(capacity) AS capacity_per_pod, any_value(max_pods) AS max_pods, 0 AS broken
        FROM predictions JOIN policies USING (service) GROUP BY 1""",
    "save_services": f"WITH {allocation(14)} SELECT * FROM decisions",
    **{name: f"WITH {allocation(budget)} SELECT * FROM decisions" for name, budget in BUDGETS.items()},
    "node_pools": f"""WITH {S.SIZED}, pools AS (
          SELECT ds, service, predicted_pods, node_pool, node_pod_capacity,
            CAST(sum(predicted_pods) OVER (PARTITION BY ds, node_pool, node_pod_capacity) AS BIGINT) AS node_pool_predicted_pods
          FROM sized),
        nodes AS (SELECT *, CAST(greatest(ceil(CAST(node_pool_predicted_pods AS DOUBLE) / node_pod_capacity), 1) AS INTEGER) AS required_nodes FROM pools)
        SELECT *, CASE WHEN required_nodes > 1 THEN 'node_pool_scale_out' ELSE 'baseline_capacity' END AS reason FROM nodes""",
}
