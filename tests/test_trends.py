"""Daily sketches of durations, anomalies against a baseline, trends and change points."""

from __future__ import annotations

import math
import random
import statistics
from datetime import timedelta

import numpy as np
import pytest
from conftest import rows
from frames import AS_OF, empty, slices
from pyspark.sql import functions as F

from fleetlens.operators import trends
from fleetlens.sources import write_table

FIRST = AS_OF.replace(hour=0) - timedelta(days=60)


def timeline(spark, **jobs):
    """Durations in seconds of the runs of each job: a list for each day from ``FIRST`` on."""
    entries = []
    for job, days in jobs.items():
        for d, seconds in enumerate(days):
            for i, s in enumerate(seconds):
                begin = FIRST + timedelta(days=d, minutes=i)
                entries.append((job, f"{job}-{d}-{i}", begin, begin + timedelta(seconds=s), None))
    return slices(spark, *entries)


def daily(spark, **jobs):
    return trends.daily_durations(timeline(spark, **jobs), 90, AS_OF)


def test_sketches_merge_to_the_quantiles_of_all_runs(spark, tmp_path):
    rng = random.Random(1)
    days = [[rng.randint(1, 5000) for _ in range(rng.randint(1, 30))] for _ in range(40)]
    table = daily(spark, a=days)
    write_table(table, str(tmp_path / "daily"), partition_by=["day"])
    stored = spark.read.parquet(str(tmp_path / "daily"))
    every = sorted(s for day in days for s in day)
    for frame in (table, stored):
        (row,) = trends.duration_quantiles(frame).collect()
        assert row.n_runs == len(every)
        assert row.median_duration_seconds == every[math.ceil(len(every) / 2) - 1]
        assert row.p90_duration_seconds == every[math.ceil(0.9 * len(every)) - 1]


def test_rank_error_of_large_sketches(spark):
    """200,000 runs on 20 days: ranks are off by less than 0.3 %."""
    runs = spark.range(200_000).select(
        F.lit("w").alias("workspace_id"), F.expr("id % 20 AS day"), F.expr("CAST(pmod(hash(id), 1000003) AS DOUBLE) AS s")
    )
    table = runs.groupBy("workspace_id", "day").agg(
        F.count(F.lit(1)).alias("n_runs"), F.expr(f"kll_sketch_agg_double(s, {trends.SKETCH_SIZE}) AS durations")
    )
    (row,) = trends.duration_quantiles(table, ["workspace_id"]).collect()
    values = np.sort([r.s for r in runs.collect()])
    for found, wanted in ((row.median_duration_seconds, 0.5), (row.p90_duration_seconds, 0.9), (row.p95_duration_seconds, 0.95)):
        assert abs(np.searchsorted(values, found) / len(values) - wanted) < 0.003


def test_planted_anomalies_are_found(spark):
    rng = random.Random(2)

    def usual():
        return [rng.randint(900, 1100) for _ in range(5)]

    jobs = {f"j{i}": [usual() for _ in range(60)] for i in range(4)}
    jobs["j1"][58] = [5000, 5100, 5200]
    jobs["j2"][57] = [100, 110]
    jobs["new"] = [[]] * 55 + [[9000] for _ in range(5)]
    found = trends.statistical_anomalies(daily(spark, **jobs), 7, AS_OF, tail_percent=1)
    columns = ("job_id", "day", "direction", "n_runs", "baseline_runs")
    assert sorted(rows(found, *columns)) == [
        ("j1", (FIRST + timedelta(days=58)).date(), "slower", 3, 265),
        ("j2", (FIRST + timedelta(days=57)).date(), "faster", 2, 265),
    ]


def test_baseline_percent_counts_whole_percents(spark):
    base = [[s] for s in range(1, 54)]
    recent = [[27], [53], [1], [0], [54], [], []]
    table = daily(spark, a=base + recent)
    found = trends.statistical_anomalies(table, 7, AS_OF, tail_percent=50)
    percents = {r.median_seconds: r.baseline_percent for r in found.collect()}
    n = 53
    expected = {float(v): 100 * sum(s <= v for s in range(1, n + 1)) // n for v in (27, 53, 1, 0, 54)}
    assert percents == {v: p for v, p in expected.items() if p >= 50 or p < 50}


def brute_trend(series):
    pairs = [(p, q) for i, p in enumerate(series) for q in series[i + 1 :]]
    slope = statistics.median((q[1] - p[1]) / (q[0] - p[0]) for p, q in pairs)
    up = sum((q[1] > p[1]) - (q[1] < p[1]) for p, q in pairs)
    n = len(series)
    values = [v for _, v in series]
    ties = sum(t * (t - 1) * (2 * t + 5) for t in (values.count(v) for v in set(values)))
    variance = (n * (n - 1) * (2 * n + 5) - ties) / 18
    z = (up - (up > 0) + (up < 0)) / math.sqrt(variance) if variance else 0.0
    fitted = np.polyfit([d for d, _ in series], values, 1)[0]
    return slope, z, fitted


def test_trends_equal_brute_force(spark):
    rng = random.Random(3)
    jobs = {}
    for i in range(12):
        step = (-20, 0, 15)[i % 3]
        jobs[f"j{i}"] = [
            [] if rng.random() < 0.3 else [1500 + step * d + rng.randint(-30, 30) * rng.choice([0, 1])] for d in range(25)
        ]
    jobs["short"] = [[1], [2], [3], [4]]
    jobs["flat"] = [[7]] * 10
    found = {r.job_id: r for r in trends.duration_trends(daily(spark, **jobs), digits=None).collect()}
    assert found.keys() == jobs.keys() - {"short"}
    kinds = set()
    for job, days in jobs.items():
        if job == "short":
            continue
        series = [(d, s[0]) for d, s in enumerate(days) if s]
        slope, z, fitted = brute_trend(series)
        row = found[job]
        assert row.n_days == len(series)
        assert row.seconds_per_day == pytest.approx(slope)
        assert row.mann_kendall_z == pytest.approx(z)
        assert row.fitted_seconds_per_day == pytest.approx(fitted, abs=1e-6)
        assert row.trend == ("rising" if z > 1.96 else "falling" if z < -1.96 else "steady")
        kinds.add(row.trend)
    assert kinds == {"rising", "falling", "steady"}


def brute_changes(series, rounds, limit, start=0):
    n = len(series)
    if not rounds or n < 10:
        return []
    total = sum(series)
    far = [abs(n * sum(series[:i]) - i * total) for i in range(1, n)]
    cut = far.index(max(far)) + 1
    spread = n * sum(v * v for v in series) - total * total
    if not spread or max(far) / math.sqrt(spread) / math.sqrt(n) <= limit:
        return []
    return [
        start + cut,
        *brute_changes(series[:cut], rounds - 1, limit, start),
        *brute_changes(series[cut:], rounds - 1, limit, start + cut),
    ]


@pytest.mark.parametrize("limit", [0.7, trends.CHANGE_LIMIT])
def test_changes_equal_brute_force(spark, limit):
    rng = random.Random(4)
    jobs = {}
    for i in range(10):
        levels = [rng.choice([1000, 1000, 1400, 2500]) for _ in range(4)]
        jobs[f"j{i}"] = [[levels[d // 15] + rng.randint(-100, 100)] for d in range(60)]
    found: dict[str, list] = {job: [] for job in jobs}
    for row in trends.duration_changes(daily(spark, **jobs), limit=limit).collect():
        found[row.job_id].append((row.change_day - FIRST.date()).days)
    for job, days in jobs.items():
        assert sorted(found[job]) == sorted(brute_changes([s[0] for s in days], 3, limit))
    assert any(found.values())


def test_planted_shift_is_found_on_its_day(spark):
    rng = random.Random(5)
    days = [[1000 + rng.randint(-50, 50)] for _ in range(30)] + [[1600 + rng.randint(-50, 50)] for _ in range(30)]
    (row,) = trends.duration_changes(daily(spark, shifted=days, flat=[[5]] * 40)).collect()
    assert (row.job_id, row.round, row.days_before, row.days_after) == ("shifted", 1, 30, 30)
    assert row.change_day == (FIRST + timedelta(days=30)).date()
    assert row.mean_after_seconds - row.mean_before_seconds == pytest.approx(600, abs=40)


def test_bad_rounds_null_keys_and_empty_tables(spark):
    none = trends.daily_durations(empty(spark, "job_run_timeline")["job_run_timeline"], 90, AS_OF)
    for made in (
        trends.duration_quantiles(none), trends.statistical_anomalies(none, 7, AS_OF),
        trends.duration_trends(none), trends.duration_changes(none),
    ):
        assert made.count() == 0
    with pytest.raises(ValueError, match="a round or more"):
        trends.duration_changes(none, rounds=0)
    lost = slices(spark, *[(None, str(i), FIRST + timedelta(days=i), FIRST + timedelta(days=i, seconds=60 + i), None) for i in range(60)])
    table = trends.daily_durations(lost, 90, AS_OF)
    (row,) = trends.duration_trends(table).collect()
    assert (row.job_id, row.trend, row.seconds_per_day) == (None, "rising", 1.0)
    # The null job meets its baseline: all its recent days are slower than before.
    assert trends.statistical_anomalies(table, 7, AS_OF).count() == 7


def test_no_python_in_the_plans(spark):
    table = daily(spark, a=[[1]])
    for made in (trends.duration_trends(table), trends.duration_changes(table), trends.statistical_anomalies(table, 7, AS_OF)):
        assert "Python" not in made._jdf.queryExecution().executedPlan().toString()
