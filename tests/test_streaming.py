from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from frames import readings

from conftest import rows
from fleetlens.operators.advise import row_issues
from fleetlens.streaming import (
    read_timeline,
    run_available,
    start_periodic,
    windowed_issues,
    windowed_utilization,
)
from fleetlens.streaming.utilization import FILES_PER_TRIGGER

START = datetime(2024, 1, 1)


def at(minute, cpu=50.0, cluster="c"):
    return (cluster, cpu, 0.0, 1.0, 50.0, False, "i", START + timedelta(minutes=minute))


@pytest.fixture
def folder(tmp_path):
    def add(spark, *entries):
        readings(spark, *entries).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    return tmp_path, add


def windows(spark, tmp_path, **options):
    stream = read_timeline(spark, str(tmp_path / "in"))
    return windowed_utilization(stream, "5 minutes", "5 minutes", **options)


def step(spark, tmp_path, stream):
    run_available(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    written = spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))
    return written.select(stream.columns)


def test_late_readings_are_dropped_and_state_survives_restarts(spark, folder):
    tmp_path, add = folder
    add(spark, at(0), at(1), at(6))
    done = step(spark, tmp_path, windows(spark, tmp_path, min_points=1))
    assert done.count() == 0
    add(spark, at(2), at(20))
    done = step(spark, tmp_path, windows(spark, tmp_path, min_points=1))
    found = sorted(rows(done, "window_start", "data_points"))
    assert found == [(START, 3), (START + timedelta(minutes=5), 1)]
    add(spark, at(3, cpu=99.0), at(40))
    done = step(spark, tmp_path, windows(spark, tmp_path, min_points=1))
    found = sorted(rows(done, "window_start", "data_points"))
    assert found == [
        (START, 3),
        (START + timedelta(minutes=5), 1),
        (START + timedelta(minutes=20), 1),
    ]


def test_stream_equals_batch_for_closed_windows(spark, folder):
    tmp_path, add = folder
    entries = [at(i / 2, cpu=float(i % 97), cluster=f"c{i % 2}") for i in range(200)]
    add(spark, *entries)
    stream = windows(spark, tmp_path)
    done = step(spark, tmp_path, stream)
    batch = windowed_utilization(readings(spark, *entries), "5 minutes", "5 minutes")
    closed = START + timedelta(minutes=199 / 2 - 5)
    expected = batch.filter(batch.window_end <= closed)
    assert expected.count() > 0
    assert sorted(rows(done), key=str) == sorted(rows(expected), key=str)


def test_alerts_follow_the_windows(spark, folder):
    tmp_path, add = folder
    add(spark, at(0, 95.0), at(1, 95.0), at(30, 50.0))
    done = step(spark, tmp_path, windowed_issues(windows(spark, tmp_path, min_points=2)))
    assert rows(done, "window_start", "issue") == [(START, "[HIGH] High CPU: Cluster c - 95.0%")]


def test_periodic_run(spark, folder):
    tmp_path, add = folder
    add(spark, at(0), at(30))
    stream = windows(spark, tmp_path, min_points=1)
    query = start_periodic(stream, str(tmp_path / "out"), str(tmp_path / "state"), "0 seconds")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).count() == 1


def test_windowed_issues_on_batch_frames(spark):
    batch = windowed_utilization(readings(spark, *[at(i, 5.0) for i in range(5)]), "5 minutes")
    assert rows(windowed_issues(batch), "severity") == [("LOW",)]
    assert rows(row_issues(batch), "severity") == [("LOW",)]


def test_one_reading_makes_a_window_and_few_tasks_write(spark, folder):
    """All windows have one date: several tasks write it, but no more than asked for in a trigger."""
    tmp_path, add = folder
    add(spark, *[at(m, cluster=f"c{m % 40}") for m in range(80)], at(200))
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        done = step(spark, tmp_path, windows(spark, tmp_path))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert done.count() == 80
    files = list((tmp_path / "out").rglob("part-*.parquet"))
    assert len({f.parent for f in files}) == 1
    assert FILES_PER_TRIGGER / 2 < len(files) <= FILES_PER_TRIGGER
