import pytest

from riskloom.operators import drift
from riskloom.session import work_path
from riskloom.streaming import jobs

SCHEMA = "id long, total_amount double"


def test_ingest_equals_batch_and_restarts(spark):
    folder, target, offsets = (work_path(spark, n) for n in ("in", "out", "offsets"))
    spark.range(100).selectExpr("id", "id * 2.5 as total_amount").repartition(5).write.option("header", True).csv(folder)
    stream = jobs.stream_files(spark, folder, SCHEMA, files_per_trigger=2)
    assert jobs.ingest(stream, target, offsets).count() == 100
    spark.range(100, 120).selectExpr("id", "1D as total_amount").write.mode("append").option("header", True).csv(folder)
    again = jobs.ingest(jobs.stream_files(spark, folder, SCHEMA), target, offsets)
    assert again.count() == 120 and again.select("id").distinct().count() == 120


def test_drift_monitor_logs_each_batch_once(spark):
    baseline = spark.range(40).selectExpr("id", "100D + id as total_amount")
    folder, log, offsets = (work_path(spark, n) for n in ("in", "log", "offsets"))
    baseline.selectExpr("id", "total_amount * 5D as total_amount").coalesce(1).write.parquet(folder)
    stream = jobs.stream_files(spark, folder, "id long, total_amount double", format="parquet")
    events = jobs.monitor_drift(stream, baseline, log, offsets, columns=["total_amount"])
    row = events.first()
    assert events.count() == 1 and row.drift_detected and row.drifted_features == ["total_amount"]
    assert (row.drift_score, row.sample_size, row.analyzed_feature_count) == (1.0, 40, 1)
    # nothing new: no event; a new calm batch: one event more
    jobs.monitor_drift(stream, baseline, log, offsets, columns=["total_amount"])
    baseline.coalesce(1).write.mode("append").parquet(folder)
    events = jobs.monitor_drift(stream, baseline, log, offsets, columns=["total_amount"])
    got = {r.metric: r.value for r in jobs.monitoring_metrics(events).collect()}
    assert got["drift_analyses_total"] == 2 and got["drift_detected_total"] == 1
    assert got["drift_last_score"] == 0.0 and got["drift_last_drifted_feature_count"] == 0
    assert got["drift_duration_le_60000ms"] == 2
    assert all(0 < r.duration_seconds for r in events.collect())
    # a replayed batch overwrites its own folder
    report = drift.distribution_drift(baseline, baseline, columns=["total_amount"])
    query_id = jobs.query_identity(spark, offsets)
    jobs.append_event(jobs.drift_event(report, 0.0), log, query_id, 0)
    assert jobs.read_events(spark, log).count() == 2
    # another query, with its own checkpoint and the same log, appends
    jobs.monitor_drift(stream, baseline, log, work_path(spark, "offsets"), columns=["total_amount"])
    again = jobs.read_events(spark, log)
    assert again.count() == 4 and again.select("query_id").distinct().count() == 2


def test_no_log_yet(spark):
    assert jobs.read_events(spark, work_path(spark, "none")).count() == 0


def test_monitor_needs_shared_columns(spark):
    baseline = spark.range(3).selectExpr("id", "1D as total_amount")
    with pytest.raises(ValueError):
        jobs.monitor_drift(baseline, baseline, "x", "y", columns=["absent"])
