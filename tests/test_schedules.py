"""Periods, spreads and phases of job starts."""

from __future__ import annotations

import random
import statistics
from datetime import timedelta

import pytest
from frames import AS_OF, empty, slices

from fleetlens.operators import schedules

FIRST = AS_OF - timedelta(days=6)


def started(spark, **jobs):
    """Starts of each job in seconds behind ``FIRST``; a run takes a minute."""
    entries = []
    for job, seconds in jobs.items():
        for i, second in enumerate(seconds):
            begin = FIRST + timedelta(seconds=second)
            entries.append((job, f"{job}-{i}", begin, begin + timedelta(minutes=1), None))
    return slices(spark, *entries)


def found(spark, timeline, **settings):
    made = schedules.job_schedules(timeline, empty(spark, "jobs")["jobs"], 7, AS_OF, None, **settings)
    return made, {row.job_id: row for row in made.collect()}


def cron(period, n, seed=0, jitter=0):
    rng = random.Random(seed)
    return [i * period + rng.randint(0, jitter) for i in range(n)]


def poisson(mean, n, seed):
    rng = random.Random(seed)
    at, starts = 0, []
    for _ in range(n):
        at += 1 + int(rng.expovariate(1 / mean))
        starts.append(at)
    return starts


def test_planted_schedules_are_told_apart(spark):
    hourly = cron(3600, 100)
    with_misses = [s for i, s in enumerate(cron(3600, 100)) if i % 7 != 3]
    planted = {f"random{i}": poisson(3600, 80, i) for i in range(12)}
    timeline = started(
        spark, hourly=hourly, misses=with_misses, late=cron(3600, 100, 1, jitter=120),
        few=[0, 100, 5000, 9000], one=[5], **planted,
    )
    made, rows = found(spark, timeline)
    assert {r.job_id for r in schedules.irregular_schedules(made).collect()} == planted.keys()
    assert rows["hourly"].period_seconds == 3600 and rows["hourly"].gap_spread == 0
    assert rows["hourly"].phase_concentration == pytest.approx(1)
    assert rows["misses"].period_seconds == 3600 and rows["misses"].phase_concentration > 0.99
    assert "one" not in rows and rows["few"].n_starts == 4


@pytest.mark.parametrize("slice_seconds", [600, 86_400])
def test_medians_equal_brute_force(spark, slice_seconds):
    jobs = {f"j{i}": sorted(set(poisson(900, 2 + i * 3, i))) for i in range(12)}
    _, rows = found(spark, started(spark, **jobs), slice_seconds=slice_seconds)
    for job, starts in jobs.items():
        gaps = [b - a for a, b in zip(starts, starts[1:], strict=False)]
        period = statistics.median(gaps)
        assert rows[job].period_seconds == period
        assert rows[job].gap_mad_seconds == statistics.median([abs(g - period) for g in gaps])
        assert rows[job].n_starts == len(starts)


def test_starts_in_one_second_are_one(spark):
    _, rows = found(spark, started(spark, a=[0, 0, 600, 600, 1200]))
    assert (rows["a"].n_starts, rows["a"].period_seconds, rows["a"].gap_mad_seconds) == (3, 600, 0)


def test_null_job_and_empty_table(spark):
    timeline = slices(spark, *[(None, str(i), 10 * i, 10 * i + 1, None) for i in range(6)])
    _, rows = found(spark, timeline)
    assert rows[None].period_seconds == 600
    assert found(spark, empty(spark, "job_run_timeline")["job_run_timeline"])[1] == {}
