from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from headroom.operators import decisions, sizing
from headroom.plans.traffic import service_traffic
from headroom.streaming.sizing import decide_batch, service_pod_stream


def test_stream_agrees_with_batch(spark, sf_dir, tmp_path):
    """Every hour with events before the last watermark is decided once, as in the batch run."""
    source = tmp_path / "events"
    spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts").coalesce(1).write.parquet(str(source))
    schema = spark.read.parquet(str(source)).schema
    stream = spark.readStream.schema(schema).parquet(str(source))
    out = str(tmp_path / "decisions")
    query = (
        service_pod_stream(stream)
        .writeStream.outputMode("append")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .foreachBatch(decide_batch(lambda df, n: df.write.mode("append").parquet(out), 14))
        .start()
    )
    assert query.awaitTermination(180)
    found = spark.read.parquet(out)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    closed = events.agg((F.date_trunc("hour", F.max("ts") - F.expr("INTERVAL 2 HOURS"))).cast("timestamp_ntz")).first()[0]
    batch = sizing.required_service_pods(service_traffic(spark, sf_dir), "y", "predicted_pods")
    seen = events.select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ds"), "event_type")
    from headroom.plans.traffic import service_of

    seen = seen.select("ds", service_of(F.col("event_type")).alias("service")).distinct()
    want = decisions.share_pod_budget(batch.join(seen, ["ds", "service"], "left_semi"), 14).where(F.col("ds") < F.lit(closed))
    assert found.count() > 0
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_event_types_without_a_service_stop_the_query(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.withColumn("event_type", F.when(F.col("event_id") == 3, "refund").otherwise(F.col("event_type"))).write.parquet(
        str(tmp_path / "events.parquet")
    )
    with pytest.raises(Exception, match="no service handles events of type refund"):
        service_traffic(spark, str(tmp_path)).count()


def test_raw_events_are_scanned_once(spark, sf_dir, monkeypatch):
    """Queries read hourly sums; the one scan of events is the write of those sums."""
    from headroom.plans import catalog, traffic

    scans = []
    monkeypatch.setattr(traffic, "table", lambda s, d, name: scans.append(name) or s.read.parquet(f"{d}/{name}.parquet"))
    for name in ("common_window", "peak_window", "service_metrics", "mismatch_spans", "allocate", "node_pools", "daily_overview"):
        scans.clear()
        plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert scans == ["events"] and "event_id" not in plan and "event_type" not in plan, name
