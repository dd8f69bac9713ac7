"""Sweeps over time: running sums, active runs and busy periods."""

from __future__ import annotations

import random
from datetime import timedelta

import pytest
from conftest import rows
from frames import AS_OF, DAY, empty, slices
from pyspark.sql import functions as F

from fleetlens.operators import concurrency
from fleetlens.operators.timeline import running_sums


def minute(n):
    return DAY + timedelta(minutes=n)


@pytest.mark.parametrize("seconds", [1, 7, 100, 10**6])
def test_running_sums_equal_brute_force(spark, seconds):
    rng = random.Random(seconds)
    steps = {(rng.choice(["a", "a", "a", "b", None]), rng.randrange(-300, 900)): rng.randint(-5, 9) for _ in range(500)}
    frame = spark.createDataFrame(
        [(key, at * 1_000_000, value, 1) for (key, at), value in steps.items()],
        "key STRING, at BIGINT, value BIGINT, one BIGINT",
    )
    made = running_sums(frame, ["key"], "at", {"total": "value", "n": "one"}, seconds, following="next")
    found = {(r.key, r.at // 1_000_000): (r.total, r.n, r.next and r.next // 1_000_000) for r in made.collect()}
    assert made.columns == ["key", "at", "value", "one", "total", "n", "next"]
    for key in ("a", "b", None):
        order = sorted(at for k, at in steps if k == key)
        for i, at in enumerate(order):
            total = sum(steps[key, t] for t in order[: i + 1])
            behind = order[i + 1] if i + 1 < len(order) else None
            assert found[key, at] == (total, i + 1, behind)


def test_levels_of_overlapping_runs(spark):
    timeline = slices(
        spark,
        ("1", "a", 0, 10, None),
        ("1", "b", 5, 20, None),
        ("2", "c", 10, 15, None),
        ("2", "d", 30, 40, None),
        ("2", "none", 31, 31, None),
    )
    made = concurrency.concurrency_levels(timeline, 7, AS_OF)
    levels = {r.active_runs: r.active_micros // 60_000_000 for r in made.collect()}
    assert levels == {1: 5 + 5 + 10, 2: 5 + 5, 0: 10}
    (peak,) = concurrency.peak_concurrency(timeline, 7, AS_OF).collect()
    assert (peak.peak_runs, peak.peak_start, peak.peak_seconds) == (2, minute(5), 600)
    assert (peak.busy_seconds, peak.run_seconds, peak.avg_active_runs) == (1800, 2400, 1.33)


def test_a_run_with_a_gap_is_active_throughout(spark):
    timeline = slices(spark, ("1", "a", 0, 10, None), ("1", "a", 30, 40, None), ("1", "b", 15, 20, None))
    (peak,) = concurrency.peak_concurrency(timeline, 7, AS_OF).collect()
    assert (peak.peak_runs, peak.busy_seconds) == (2, 2400)
    periods = concurrency.busy_periods(timeline, 7, AS_OF)
    assert rows(periods, "period_start", "period_end") == [
        (minute(0), minute(10)), (minute(15), minute(20)), (minute(30), minute(40)),
    ]


def test_periods_that_touch_are_one(spark):
    timeline = slices(
        spark,
        ("1", "a", 0, 10, None),
        ("1", "b", 10, 20, None),
        ("2", "c", 12, 18, None),
        ("2", "d", 21, 22, None),
        ("3", "e", 0, 5, None, "other"),
        ("3", "f", 3, 1, None, "other"),
    )
    columns = ("workspace_id", "period_start", "period_end", "busy_seconds", "n_slices", "peak_slices")
    made = concurrency.busy_periods(timeline, 7, AS_OF)
    assert sorted(rows(made, *columns)) == [
        ("other", minute(0), minute(5), 300, 1, 1),
        ("w", minute(0), minute(20), 1200, 3, 2),
        ("w", minute(21), minute(22), 60, 1, 1),
    ]


@pytest.mark.parametrize("seconds", [60, 3600, 86_400])
def test_random_runs_equal_a_minute_by_minute_count(spark, seconds):
    rng = random.Random(seconds)
    spans = []
    for i in range(120):
        start = rng.randrange(0, 1300)
        spans.append((str(i % 7), str(i), start, start + rng.choice([0, 1, 5, 90]), None, rng.choice("xy")))
    timeline = slices(spark, *spans)
    for keys in (("workspace_id",), ()):
        made = concurrency.peak_concurrency(timeline, 7, AS_OF, keys, slice_seconds=seconds)
        for row in made.collect():
            mine = [s for s in spans if not keys or s[5] == row.workspace_id]
            active = [sum(s[2] <= m < s[3] for s in mine) for m in range(1500)]
            top = max(active)
            assert row.peak_runs == top
            assert row.peak_start == minute(active.index(top))
            assert row.peak_seconds == 60 * active.count(top)
            assert row.busy_seconds == 60 * sum(a > 0 for a in active)
            assert row.run_seconds == 60 * sum(active)
    periods = concurrency.busy_periods(timeline, 7, AS_OF, keys=(), slice_seconds=seconds).collect()
    active = [any(s[2] <= m < s[3] for s in spans) for m in range(1500)]
    starts = [m for m in range(1500) if active[m] and not (m and active[m - 1])]
    assert [p.period_start for p in periods] == [minute(m) for m in starts]


def test_null_workspace_is_a_group(spark):
    timeline = slices(spark, ("1", "a", 0, 10, None, None), ("1", "b", 0, 10, None, "w"))
    made = concurrency.peak_concurrency(timeline, 7, AS_OF)
    assert sorted(rows(made, "workspace_id", "peak_runs"), key=repr) == [("w", 1), (None, 1)]


def test_empty_table(spark):
    none = empty(spark, "job_run_timeline")["job_run_timeline"]
    assert concurrency.peak_concurrency(none, 7, AS_OF).count() == 0
    assert concurrency.busy_periods(none, 7, AS_OF).count() == 0


def test_no_task_holds_a_workspace(spark):
    """One workspace over many days: its instants are sorted by day, in many tasks."""
    runs = spark.range(20_000).select(
        F.lit("w").alias("workspace_id"),
        F.expr("timestamp_seconds(1700000000 + id * 400) AS started"),
        F.expr("timestamp_seconds(1700000000 + id * 400 + id % 5000) AS ended"),
    )
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        counts = concurrency.active_counts(runs, "started", "ended")
        tasks = counts.groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len(tasks) == 16
    assert max(t["count"] for t in tasks) < sum(t["count"] for t in tasks) / 6
