from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from headroom.operators import decisions as D
from headroom.operators.sizing import DEFAULT_SERVICE_POLICIES as POLICIES

ORDER = ["payment", "auth", "limit_scoring", "batch", "admin"]


def demand(spark, rows):
    return spark.createDataFrame(rows, "ds timestamp, service string, predicted_pods int").withColumn(
        "ds", F.col("ds").cast("timestamp_ntz")
    )


def all_at_most(spark):
    return demand(spark, [(datetime(2024, 1, 1), s, p.max_pods) for s, p in POLICIES.items()])


@pytest.mark.parametrize(
    "budget, pods, reason",
    [
        (12, [5, 2, 3, 1, 1], "priority_rebalanced"),
        (26, [12, 5, 5, 3, 1], "priority_rebalanced"),
        (8, [2, 2, 2, 1, 1], "budget_below_minimum"),
        (39, [12, 8, 9, 7, 3], "within_budget"),
    ],
)
def test_worked_allocations(spark, budget, pods, reason):
    rows = {r["service"]: r for r in D.share_pod_budget(all_at_most(spark), budget).collect()}
    assert [rows[s]["onprem_adjusted_pods"] for s in ORDER] == pods
    assert {r["reason"] for r in rows.values()} == {reason}


def by_hand(wanted: dict[str, int], budget: int) -> dict[str, int]:
    """The rule, one pod at a time, with exact fractions; brute force for the comparison."""
    from fractions import Fraction

    least = {s: POLICIES[s].min_pods for s in wanted}
    if sum(wanted.values()) <= budget:
        return dict(wanted)
    if budget < sum(least.values()):
        given, goal, left = {s: 0 for s in wanted}, least, budget
        turn = sorted(wanted, key=lambda s: (POLICIES[s].priority, s))
    else:
        extra = {s: max(wanted[s] - least[s], 0) for s in wanted}
        weight = {s: Fraction(extra[s], POLICIES[s].priority) for s in wanted}
        free = budget - sum(least.values())
        share = {s: free * weight[s] / sum(weight.values()) for s in wanted}
        given = {s: least[s] + min(int(share[s]), extra[s]) for s in wanted}
        goal, left = wanted, budget - sum(given.values())
        turn = sorted(wanted, key=lambda s: (-(share[s] - int(share[s])), -extra[s], POLICIES[s].priority, s))
    while left > 0:
        before = left
        for s in turn:
            if given[s] < goal[s] and left > 0:
                given[s], left = given[s] + 1, left - 1
        if left == before:
            break
    return given


def test_allocation_equals_one_pod_at_a_time(spark):
    rng = random.Random(7)
    start, cases, rows = datetime(2024, 1, 1), [], []
    for i in range(300):
        services = rng.sample(ORDER, rng.randint(1, 5))
        wanted = {s: rng.randint(0, POLICIES[s].max_pods + 20) for s in services}
        cases.append((start + timedelta(hours=i), wanted))
        rows += [(start + timedelta(hours=i), s, n) for s, n in wanted.items()]
    rng.shuffle(rows)
    df = demand(spark, rows)
    for budget in (1, 5, 9, 14, 26, 60):
        found = {(r["ds"], r["service"]): r for r in D.share_pod_budget(df, budget).collect()}
        for ds, wanted in cases:
            assert {s: found[(ds, s)]["onprem_adjusted_pods"] for s in wanted} == by_hand(wanted, budget), (budget, wanted)


def test_repeated_and_unknown_services_are_errors(spark):
    twice = all_at_most(spark).union(all_at_most(spark).limit(1))
    with pytest.raises(Exception, match="repeated service"):
        D.share_pod_budget(twice, 12).collect()
    with pytest.raises(Exception, match="no pod policy covers"):
        D.share_pod_budget(demand(spark, [(datetime(2024, 1, 1), "x", 1)]), 12).collect()
    with pytest.raises(ValueError, match="pod_budget"):
        D.share_pod_budget(all_at_most(spark), 0)
    with pytest.raises(ValueError, match="missing required columns"):
        D.share_pod_budget(all_at_most(spark).drop("service"), 3)


def test_node_pools(spark):
    row = D.size_node_pools(demand(spark, [(datetime(2024, 1, 1), "payment", 12)])).first()
    assert (row["node_pool"], row["required_nodes"], row["reason"]) == ("onprem-critical", 1, "baseline_capacity")
    rows = D.size_node_pools(all_at_most(spark)).collect()
    found = {r["service"]: (r["node_pool_predicted_pods"], r["required_nodes"], r["reason"]) for r in rows}
    assert found["payment"] == found["auth"] == (20, 2, "node_pool_scale_out")
    assert found["admin"] == (3, 1, "baseline_capacity")
    none = D.size_node_pools(demand(spark, [(datetime(2024, 1, 1), "admin", 0)])).first()
    assert none["required_nodes"] == 1
