from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from headroom.functions import metrics as M
from headroom.operators import evaluation as V
from headroom.operators import sizing as Z
from headroom.operators.sizing import PodPolicy, ServicePolicy


def pods(spark, values, policy):
    df = spark.createDataFrame([(v,) for v in values], "rate double")
    return [r[0] for r in df.select(Z.required_pods(F.col("rate"), policy)).collect()]


def rates(spark, actual, predicted, key="m"):
    rows = [(key, i, float(a), float(p)) for i, (a, p) in enumerate(zip(actual, predicted))]
    return spark.createDataFrame(rows, "model string, ds int, actual double, predicted double")


def test_required_pods_clamps(spark):
    policy = PodPolicy(10, 0.0, 1, 3)
    assert pods(spark, [-5.0, 35.0, 11.0], policy) == [1, 3, 2]


def test_required_pods_of_odd_rates(spark):
    rates_ = [None, float("nan"), float("inf"), float("-inf"), 1e300, 0.0]
    assert pods(spark, rates_, PodPolicy(10, 0.0, 1, 3)) == [1, 1, 3, 1, 3, 1]


@pytest.mark.parametrize(
    "values", [(0, 0.2, 1, 8), (10, 1.0, 1, 8), (10, -0.1, 1, 8), (10, 0.2, -1, 8), (10, 0.2, 5, 4)]
)
def test_bad_policies_are_rejected(values):
    with pytest.raises(ValueError):
        PodPolicy(*values)


def test_effective_capacity():
    assert PodPolicy().effective_capacity == 21.1 * 0.8


@pytest.mark.parametrize("change", [{"priority": 0}, {"node_pod_capacity": 0}])
def test_bad_service_policies_are_rejected(change):
    with pytest.raises(ValueError):
        ServicePolicy(**{"capacity_per_pod": 10.0, "priority": 1, "node_pod_capacity": 5, **change})


def test_policy_violations_are_listed(spark):
    good = Z.policy_frame(spark)
    assert Z.policy_violations(good).isEmpty()
    bad = good.withColumn("priority", F.when(F.col("service") == "auth", 0).otherwise(F.col("priority")))
    rows = Z.policy_violations(bad).collect()
    assert [r["service"] for r in rows] == ["auth"] and rows[0]["violations"] == ["priorities count from 1 (priority)"]


def test_service_pods_follow_the_policy_of_the_service(spark):
    df = spark.createDataFrame([("payment", 200.0), ("admin", 200.0)], "service string, rate double")
    found = {r["service"]: r["pods"] for r in Z.required_service_pods(df, "rate").collect()}
    assert found == {"payment": 11, "admin": 3}
    unknown = spark.createDataFrame([("other", 1.0)], "service string, rate double")
    with pytest.raises(Exception, match="no pod policy covers service other"):
        Z.required_service_pods(unknown, "rate").collect()


def test_service_pod_columns(spark):
    df = spark.createDataFrame([("payment", 100.0, 120.0), ("admin", 20.0, 30.0)], "service string, actual double, predicted double")
    found = {r["service"]: (r["actual_pods"], r["predicted_pods"]) for r in Z.add_service_pod_columns(df).collect()}
    assert found == {"payment": (6, 7), "admin": (1, 1)}
    with pytest.raises(ValueError, match="missing required columns"):
        Z.add_service_pod_columns(df.drop("actual"))


def test_smape_counts_double_zero_as_zero(spark):
    out = V.evaluate(rates(spark, [0, 10], [0, 20])).first()
    assert out["smape"] == pytest.approx(1 / 3)


def test_core_metrics(spark):
    policy = PodPolicy(10, 0.0, 1, 5)
    out = V.evaluate(rates(spark, [10, 20, 30, 40], [10, 10, 40, 40]), by=["model"], policy=policy).first()
    assert (out["pod_accuracy"], out["under_provisioning_rate"], out["over_provisioning_rate"]) == (0.5, 0.25, 0.25)


def test_empty_input_is_an_error(spark):
    with pytest.raises(Exception, match="no rows to measure"):
        V.evaluate(rates(spark, [], [])).collect()


def test_pairs_have_to_match(spark):
    df = rates(spark, [1, 2], [3, 4])
    assert V.paired(df, df, ["ds"]).count() == 2
    with pytest.raises(Exception, match="same rows"):
        V.paired(df, df.where("ds = 0"), ["ds"]).collect()


def test_score_card_of_the_worked_example(spark):
    out = V.score_card(rates(spark, [10, 30, 50], [10, 20, 60]), series=["model"], order="ds").first()
    want = {
        "smape": 0.193939,
        "pod_accuracy": 2 / 3,
        "under_provisioning_rate": 0.0,
        "over_provisioning_rate": 1 / 3,
        "severe_under_provisioning_rate": 0.0,
        "pod_change_rate": 1.0,
        "penalty_score": 0.136061,
        "combined_score": 0.880235,
    }
    for name, value in want.items():
        assert out[name] == pytest.approx(value, abs=1e-6), name


def test_score_card_floors_predictions_first(spark):
    df = rates(spark, [10, 10], [-10, 10])
    assert V.score_card(df, series=["model"]).first()["smape"] == pytest.approx(1.0)
    assert V.evaluate(df).first()["smape"] == pytest.approx(1.0)
    low = rates(spark, [10, 10], [-5, 10])
    assert V.score_card(low, series=["model"]).first()["smape"] == pytest.approx(1.0)
    assert V.evaluate(low).first()["smape"] == pytest.approx(1.0)
    assert V.evaluate(rates(spark, [0, 10], [-5, 10])).first()["smape"] == pytest.approx(1.0)
    assert V.score_card(rates(spark, [0, 10], [-5, 10]), series=["model"]).first()["smape"] == 0.0


def test_pod_change_rate(spark):
    rows = [("a", i, p) for i, p in enumerate([1, 1, 2, 2, 3])] + [("b", 0, 4)]
    df = spark.createDataFrame(rows, "service string, ds int, predicted_pods int").repartition(3)
    found = {r[0]: r[1] for r in V.pod_change(df, series=["service"]).collect()}
    assert found == {"a": 0.5, "b": 0.0}


def test_severe_under_provisioning(spark):
    df = spark.createDataFrame([(3, 1), (4, 3), (2, 2)], "a int, p int")
    assert df.agg(M.severe_under_provisioning_rate(F.col("a"), F.col("p"))).first()[0] == pytest.approx(1 / 3)


def test_penalty_fitness_and_objective(spark):
    row = spark.createDataFrame(
        [(0.1, 0.5, 0.2, 0.3, 0.4)],
        "under_provisioning_rate double, smape double, over_provisioning_rate double, "
        "severe_under_provisioning_rate double, pod_change_rate double",
    )
    out = row.select(M.penalty_score().alias("p"), M.objective_score().alias("o")).first()
    assert out["p"] == pytest.approx(0.24) and out["o"] == pytest.approx(0.19)
    low, high = spark.range(1).select(M.fitness(F.lit(0.1)), M.fitness(F.lit(0.5))).first()
    assert low > high
    with pytest.raises(Exception, match="below 0"):
        spark.range(1).select(M.fitness(F.lit(-0.1))).collect()
    with pytest.raises(ValueError):
        M.objective_score(-1.0)


def test_priority_weighted_under_provisioning(spark):
    rows = [("payment", 2, 1), ("payment", 2, 2), ("admin", 1, 1)]
    df = spark.createDataFrame(rows, "service string, actual_pods int, predicted_pods int")
    name = "priority_weighted_under_provisioning_rate"
    assert V.priority_weighted_under_provisioning(df).first()[name] == pytest.approx(1 / (1 + 1 + 0.2))
    assert V.priority_weighted_under_provisioning(df.limit(0)).first()[name] == 0.0


def test_rates_add_up_to_one(spark, sf_dir):
    from headroom.plans.catalog.evaluation import evaluate

    total = F.col("pod_accuracy") + F.col("under_provisioning_rate") + F.col("over_provisioning_rate")
    assert evaluate(spark, sf_dir).where(F.abs(total - 1) > 3e-6).isEmpty()
