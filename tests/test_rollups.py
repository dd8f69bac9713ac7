"""Daily partials: refresh, expiry, and figures merged from them."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from conftest import rows
from frames import empty, readings

from fleetlens.operators import nodes
from fleetlens.plans import rollups

LAST = datetime(2024, 1, 31, 13)


def on_days(spark, days, seed=1, clusters="abc"):
    rng = random.Random(seed)
    entries = []
    for day in days:
        for _ in range(rng.randint(3, 12)):
            start = datetime(2024, 1, 1) + timedelta(days=day - 1, seconds=rng.randrange(86_400))
            half = rng.choice([None, rng.uniform(0, 60)])
            entries.append(
                (rng.choice(clusters), rng.uniform(0, 40), half, rng.choice([None, 20.0]), rng.uniform(0, 99),
                 rng.choice([True, False]), rng.choice("ij"), start)
            )
    return readings(spark, *entries)


def files(path):
    return sorted(str(f.relative_to(path)) for f in path.rglob("*.parquet"))


def content(spark, path):
    daily = spark.read.parquet(str(path))
    return sorted(rows(daily.select(sorted(daily.columns))), key=repr)


def test_merged_figures_equal_direct_ones(spark, tmp_path):
    timeline = on_days(spark, range(1, 32))
    path = str(tmp_path / "daily")
    for day in (20, 21, 27, 31):
        rollups.refresh(timeline, path, datetime(2024, 1, day, 13))
    daily = spark.read.parquet(path)
    for days in (4, 7, 30):
        pairs = [
            (rollups.utilization_top(daily, days, LAST), nodes.cluster_utilization_top(timeline, days, LAST)),
            (rollups.utilization(daily, days, LAST), nodes.cluster_utilization(timeline, days, LAST)),
            (rollups.efficiency(daily, days, LAST, 2), nodes.cluster_efficiency(timeline, days, LAST, 2)),
        ]
        for ours, direct in pairs:
            assert ours.columns == direct.columns
            assert rows(ours) == rows(direct)
            assert rows(direct)


def test_a_repeated_refresh_changes_nothing(spark, tmp_path):
    timeline = on_days(spark, range(20, 32))
    path = tmp_path / "daily"
    assert rollups.refresh(timeline, str(path), LAST) == (date(2024, 1, 1), date(2024, 1, 31))
    before, names = content(spark, path), files(path)
    assert rollups.refresh(timeline, str(path), LAST) == (date(2024, 1, 30), date(2024, 1, 31))
    assert content(spark, path) == before
    # Days that are not touched keep their files.
    kept = [name for name in files(path) if name in names]
    assert {name.split("/")[0] for name in kept} == {f"day=2024-01-{d}" for d in range(20, 30)}


def test_late_readings_and_earlier_days(spark, tmp_path):
    path = str(tmp_path / "daily")
    rollups.refresh(on_days(spark, range(20, 30)), path, datetime(2024, 1, 29, 23))
    late = on_days(spark, range(20, 32)).unionByName(on_days(spark, [26, 28], seed=9))
    rollups.refresh(late, path, LAST, late_days=1)
    once = rollups.merged(spark.read.parquet(path), 30, LAST).selectExpr("sum(points)").first()[0]
    rollups.refresh(late, path, LAST, late_days=5)
    again = rollups.merged(spark.read.parquet(path), 30, LAST).selectExpr("sum(points)").first()[0]
    assert once < again == late.count()
    # A refresh as of an earlier day leaves later days as they are.
    rollups.refresh(late, path, datetime(2024, 1, 25, 5))
    assert rollups.merged(spark.read.parquet(path), 30, LAST).selectExpr("sum(points)").first()[0] == again


def test_expired_days_are_deleted(spark, tmp_path):
    path = str(tmp_path / "daily")
    timeline = on_days(spark, range(1, 32))
    rollups.refresh(timeline, path, datetime(2024, 1, 20), retention_days=7)
    assert rollups.stored_days(spark, path)[0] == date(2024, 1, 13)
    rollups.refresh(timeline, path, LAST, retention_days=7)
    assert rollups.stored_days(spark, path) == [date(2024, 1, d) for d in range(24, 32)]
    daily = spark.read.parquet(path)
    with pytest.raises(ValueError, match="retained"):
        rollups.utilization(daily, 8, LAST, retention_days=7)
    direct = nodes.cluster_utilization(timeline, 7, LAST)
    assert rows(rollups.utilization(daily, 7, LAST, retention_days=7)) == rows(direct)


def test_only_the_days_of_a_look_back_are_read(spark, tmp_path, sf_dir):
    path = str(tmp_path / "daily")
    rollups.refresh(on_days(spark, range(1, 32)), path, LAST)
    made = rollups.utilization(spark.read.parquet(path), 3, LAST)
    text = made._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in text and "2024-01-28" in text
    made.collect()
    scan = made._jdf.queryExecution().executedPlan().toString()
    assert scan.count("FileScan parquet") >= 1
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumnRenamed("ts", "start_time")
    some = rollups.touched(events, date(2024, 1, 30), LAST)
    pushed = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(start_time,2024-01-30" in pushed or "GreaterThanOrEqual(ts,2024-01-30" in pushed
    assert "LessThan(" in pushed


def test_bad_settings_and_empty_tables(spark, tmp_path):
    timeline = empty(spark, "node_timeline")["node_timeline"]
    path = str(tmp_path / "daily")
    with pytest.raises(ValueError, match="negative"):
        rollups.refresh(timeline, path, LAST, late_days=-1)
    with pytest.raises(ValueError, match="1 day or more"):
        rollups.refresh(timeline, path, LAST, retention_days=0)
    assert rollups.stored_days(spark, path) == []
    rollups.refresh(timeline, path, LAST)
    assert rollups.stored_days(spark, path) == []
