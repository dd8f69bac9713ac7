from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from frames import AS_OF, DAY, jobs, slices

from conftest import rows, ts
from fleetlens.operators import jobs as ops

NO_JOBS = ()


def only(df):
    collected = df.collect()
    assert len(collected) == 1
    return collected[0]


def test_envelope_counts_gaps_and_active_time_does_not(spark):
    timeline = slices(spark, ("1", "r", 0, 10, None), ("1", "r", 30, 40, None))
    envelope = ops.run_durations(timeline, 7, AS_OF)
    active = ops.run_durations(timeline, 7, AS_OF, mode="active")
    assert only(envelope).duration_seconds == 2400
    assert only(active).duration_seconds == 1200


def test_active_time_drops_fractions_of_the_sum(spark):
    half = timedelta(milliseconds=600)
    timeline = slices(
        spark, ("1", "r", DAY, DAY + half, None), ("1", "r", DAY, DAY + half, None)
    )
    assert only(ops.run_durations(timeline, 7, AS_OF, mode="active")).duration_seconds == 1


def test_two_state_run_counts_as_both(spark):
    timeline = slices(spark, ("1", "r", 0, 1, "FAILED"), ("1", "r", 1, 2, "SUCCESS"))
    row = only(ops.job_failure_analysis(timeline, jobs(spark), 7, AS_OF))
    assert (row.total_runs, row.successful_runs, row.failed_runs) == (1, 1, 1)
    assert (row.success_rate_percent, row.failure_rate_percent) == (100.0, 100.0)


def test_other_state_counts_as_neither(spark):
    timeline = slices(spark, ("1", "r", 0, 1, "SKIPPED"))
    row = only(ops.job_failure_analysis(timeline, jobs(spark), 7, AS_OF))
    assert (row.total_runs, row.success_rate_percent, row.failure_rate_percent) == (1, 0.0, 0.0)


def test_runs_and_slices_have_different_denominators(spark):
    timeline = slices(
        spark, ("1", "r", 0, 1, None), ("1", "r", 1, 2, None), ("1", "r", 2, 3, "SUCCESS")
    )
    per_run = only(ops.job_failure_analysis(timeline, jobs(spark), 7, AS_OF))
    per_slice = only(ops.job_failure_slices(timeline, jobs(spark), 7, AS_OF))
    assert (per_run.total_runs, per_run.success_rate_percent) == (1, 100.0)
    assert (per_slice.total_runs, per_slice.success_rate_percent) == (3, 33.33)


def test_job_without_any_state_has_runtime_but_no_failure_row(spark):
    timeline = slices(spark, ("1", "r", 0, 1, None))
    assert ops.job_failure_analysis(timeline, jobs(spark), 7, AS_OF).count() == 0
    health = ops.job_health(timeline, jobs(spark), 7, AS_OF)
    assert ops.failure_view(health).count() == 0
    assert ops.runtime_view(health).count() == 1


def test_views_of_one_pass_equal_the_single_operators(spark):
    timeline = slices(
        spark,
        ("1", "a", 0, 5, "SUCCESS"),
        ("1", "b", 0, 9, None),
        ("1", "c", 0, 70, "TIMEOUT"),
        ("2", "d", 0, 1, "CANCELLED"),
        ("3", "e", 0, 1, None),
    )
    names = jobs(spark, ("1", "one", DAY))
    health = ops.job_health(timeline, names, 7, AS_OF)
    assert rows(ops.runtime_view(health)) == rows(
        ops.job_runtime_metrics(timeline, names, 7, AS_OF)
    )
    assert rows(ops.failure_view(health)) == rows(
        ops.job_failure_analysis(timeline, names, 7, AS_OF)
    )


def test_null_run_ids_count_for_durations_only(spark):
    timeline = slices(spark, ("1", None, 0, 10, "SUCCESS"), ("1", "r", 0, 20, "SUCCESS"))
    runtime = only(ops.job_runtime_metrics(timeline, jobs(spark), 7, AS_OF))
    assert (runtime.total_runs, runtime.avg_duration_seconds) == (1, 900.0)
    failures = only(ops.job_failure_analysis(timeline, jobs(spark), 7, AS_OF))
    assert (failures.total_runs, failures.successful_runs) == (1, 1)
    unidentified = slices(spark, ("1", None, 0, 10, "SUCCESS"))
    assert ops.job_runtime_metrics(unidentified, jobs(spark), 7, AS_OF).count() == 0
    assert ops.job_failure_analysis(unidentified, jobs(spark), 7, AS_OF).count() == 0


def test_id_clash_across_workspaces_counts_once_per_day(spark):
    timeline = slices(
        spark, ("1", "r", 0, 1, "SUCCESS", "A"), ("1", "r", 5, 6, "FAILED", "B")
    )
    row = only(ops.recent_job_activity(timeline, 7, AS_OF))
    assert (row.unique_jobs, row.total_runs, row.successful_runs, row.failed_runs) == (1, 1, 1, 1)


def test_recent_activity_ignores_stateless_rows_and_null_ids(spark):
    timeline = slices(
        spark,
        ("1", "r", 0, 1, None),
        ("1", None, 0, 1, "SUCCESS"),
        (None, "q", 0, 1, "SKIPPED"),
        ("2", "s", DAY - timedelta(days=1), DAY, "TIMEOUT"),
    )
    found = rows(ops.recent_job_activity(timeline, 7, AS_OF))
    assert found == [
        (DAY.date(), 1, 1, 0, 0),
        ((DAY - timedelta(days=1)).date(), 1, 1, 0, 1),
    ]


def test_simple_job_data(spark):
    timeline = slices(
        spark,
        ("1", "a", 0, 5, None),
        ("1", "a", 5, 9, None),
        ("1", "b", DAY - timedelta(days=1), DAY, None),
        ("2", "c", 1, 2, None),
        ("2", None, 3, 4, None),
    )
    found = rows(ops.simple_job_data(timeline, 7, AS_OF))
    assert found == [
        ("w", "1", 2, 2, DAY - timedelta(days=1), DAY + timedelta(minutes=9)),
        ("w", "2", 1, 1, DAY + timedelta(minutes=1), DAY + timedelta(minutes=4)),
    ]
    assert rows(ops.simple_job_data(timeline, 7, AS_OF, limit=1)) == found[:1]


def test_newest_name_wins_and_ties_are_resolved(spark):
    timeline = slices(spark, ("1", "r", 0, 1, None), ("7", "r", 0, 1, None))
    names = jobs(
        spark,
        ("1", "old", ts("2024-01-01")),
        ("1", "new a", ts("2024-01-02")),
        ("1", "new b", ts("2024-01-02")),
        ("1", "elsewhere", ts("2024-01-03"), "other"),
    )
    runtime = ops.job_runtime_metrics(timeline, names, 7, AS_OF)
    assert sorted(rows(runtime, "job_id", "job_name")) == [("1", "new b"), ("7", "Job_7")]
    active = ops.job_runtime_active(timeline, names, 7, AS_OF)
    assert sorted(rows(active, "job_id", "job_name")) == [("1", "new b"), ("7", None)]


def test_percentiles_approximate_take_an_element_and_exact_interpolate(spark):
    timeline = slices(
        spark, *[("1", str(i), 0, minutes, None) for i, minutes in enumerate([1, 2, 3, 10])]
    )
    runtime = only(ops.job_runtime_metrics(timeline, jobs(spark), 7, AS_OF))
    assert runtime.median_duration_seconds == 120
    assert runtime.p95_duration_seconds == 600
    active = only(ops.job_runtime_active(timeline, jobs(spark), 7, AS_OF))
    assert active.median_duration_seconds == 150.0
    assert active.p90_duration_seconds == pytest.approx(474.0)
    assert active.avg_duration_seconds == 240.0


def test_equal_durations_weigh_in_the_exact_percentile(spark):
    timeline = slices(
        spark, *[("1", str(i), 0, m, None) for i, m in enumerate([1, 1, 1, 1, 2])]
    )
    active = only(ops.job_runtime_active(timeline, jobs(spark), 7, AS_OF))
    assert (active.total_runs, active.median_duration_seconds) == (5, 60.0)
    assert active.avg_duration_seconds == 72.0
    assert active.p90_duration_seconds == pytest.approx(96.0)


def test_open_slices_are_left_out_of_durations(spark):
    timeline = slices(spark, ("1", "a", 0, 10, None)).unionByName(
        spark.createDataFrame([("w", "1", "b", DAY, None, None)], slices(spark).schema)
    )
    active = only(ops.job_runtime_active(timeline, jobs(spark), 7, AS_OF))
    assert (active.total_runs, active.avg_duration_seconds) == (2, 600.0)
    runtime = only(ops.job_runtime_metrics(timeline, jobs(spark), 7, AS_OF))
    assert (runtime.total_runs, runtime.avg_duration_seconds) == (2, 600.0)


def test_order_of_results(spark):
    timeline = slices(
        spark,
        ("1", "a", 0, 1, "SUCCESS"),
        ("2", "b", 0, 9, "FAILED"),
        ("3", "c", 0, 9, "FAILED"),
        ("3", "d", 0, 9, "FAILED"),
    )
    runtime = ops.job_runtime_metrics(timeline, jobs(spark), 7, AS_OF)
    assert [r[0] for r in rows(runtime, "job_id")] == ["2", "3", "1"]
    failures = ops.job_failure_analysis(timeline, jobs(spark), 7, AS_OF)
    assert [r[0] for r in rows(failures, "job_id")] == ["3", "2", "1"]


def test_default_clock_is_now(spark):
    now = datetime.now()
    timeline = slices(
        spark,
        ("1", "new", now - timedelta(hours=1), now, "SUCCESS"),
        ("1", "old", now - timedelta(days=30), now, "SUCCESS"),
    )
    assert only(ops.job_failure_analysis(timeline, jobs(spark))).total_runs == 1


def test_keys_keep_their_type(spark):
    timeline = slices(spark, ("1", "5", 0, 1, "SUCCESS")).selectExpr(
        "CAST(1 AS INT) AS workspace_id",
        "CAST(job_id AS BIGINT) AS job_id",
        "CAST(run_id AS BIGINT) AS run_id",
        "CAST(period_start_time AS TIMESTAMP_NTZ) AS period_start_time",
        "CAST(period_end_time AS TIMESTAMP_NTZ) AS period_end_time",
        "result_state",
    )
    names = jobs(spark).selectExpr(
        "CAST(workspace_id AS INT) AS workspace_id",
        "CAST(job_id AS BIGINT) AS job_id",
        "name",
        "change_time",
    )
    runtime = ops.job_runtime_metrics(timeline, names, 7, AS_OF)
    assert dict(runtime.dtypes)["job_id"] == "bigint"
    assert only(runtime).job_name == "Job_1"
