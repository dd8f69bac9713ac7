"""Overlap of runs with node readings."""

from __future__ import annotations

import random
from datetime import timedelta

import pytest
from conftest import rows
from frames import AS_OF, DAY, empty, readings, slices
from pyspark.sql import functions as F

from fleetlens.config import Thresholds
from fleetlens.operators import resources


def on_cluster(spark, *entries):
    """(job, run, start minute, end minute, cluster) as slices with a cluster."""
    timeline = slices(spark, *[(j, r, a, b, None) for j, r, a, b, _ in entries])
    of_run = dict.fromkeys((r, c) for _, r, _, _, c in entries)
    named = spark.createDataFrame(list(of_run), "run_id STRING, cluster_id STRING")
    return timeline.join(named, "run_id", "left")


def reading(cluster, start, cpu, memory, instance="i", seconds=60):
    return (cluster, cpu, 0.0 if cpu is not None else None, 0.0, memory, False, instance, DAY + timedelta(seconds=start), seconds)


def taken(spark, *entries):
    made = readings(spark, *[e[:8] for e in entries])
    lengths = {(e[0], e[6], e[7]): e[8] for e in entries}
    ends = spark.createDataFrame(
        [(c, i, s, s + timedelta(seconds=n)) for (c, i, s), n in lengths.items()],
        "cluster_id STRING, instance_id STRING, start_time TIMESTAMP, end_at TIMESTAMP",
    )
    joined = made.join(ends, ["cluster_id", "instance_id", "start_time"])
    return joined.withColumn("end_time", F.col("end_at")).drop("end_at")


def usage(spark, runs, load, bucket=3600):
    none = empty(spark, "jobs")["jobs"]
    found = resources.job_resource_usage(runs, load, none, 7, AS_OF, None, False, bucket)
    return {r.job_id: r for r in found.collect()}


@pytest.mark.parametrize("bucket", [7, 60, 3600, 86_400])
def test_random_overlaps_equal_brute_force(spark, bucket):
    rng = random.Random(bucket)
    runs = []
    for i in range(40):
        start = rng.randrange(0, 300)
        runs.append((f"j{i % 9}", f"r{i}", start, start + rng.choice([0, 1, 5, 130]), rng.choice(["a", "a", "b", "none"])))
    load = {}
    for _ in range(150):
        cluster, instance, start = rng.choice("ab"), rng.choice("xyz"), rng.randrange(0, 18_000, 20)
        load[cluster, instance, start] = reading(
            cluster, start, rng.choice([None, 10.0, 95.0]), rng.choice([None, 50.0, 70.0]), instance,
            rng.choice([0, 20, 60, 4000]),
        )
    found = usage(spark, on_cluster(spark, *runs), taken(spark, *load.values()), bucket)
    expected: dict[str, dict] = {}
    for job, run, first, last, cluster in runs:
        for (c, _, start), entry in load.items():
            overlap = min(last * 60, start + entry[8]) - max(first * 60, start)
            if c != cluster or overlap <= 0:
                continue
            e = expected.setdefault(job, {"runs": set(), "n": 0, "cs": 0, "cw": 0.0, "ms": 0, "mw": 0.0})
            e["runs"].add(run)
            e["n"] += 1
            if entry[1] is not None:
                e["cs"] += overlap
                e["cw"] += overlap * entry[1]
            if entry[4] is not None:
                e["ms"] += overlap
                e["mw"] += overlap * entry[4]
    assert found.keys() == expected.keys() and len(expected) > 3
    for job, e in expected.items():
        row = found[job]
        assert (row.measured_runs, row.n_readings, row.node_seconds) == (len(e["runs"]), e["n"], e["cs"])
        assert row.cpu_node_seconds == pytest.approx(e["cw"] / 100) if e["cs"] else row.cpu_node_seconds is None
        for mean, whole, part in (("avg_cpu_utilization", "cs", "cw"), ("avg_memory_utilization", "ms", "mw")):
            assert row[mean] == pytest.approx(e[part] / e[whole]) if e[whole] else row[mean] is None


def test_a_reading_counts_once_over_many_buckets(spark):
    found = usage(
        spark,
        on_cluster(spark, ("1", "r", 0, 600, "c")),
        taken(spark, reading("c", 1000, 50.0, 40.0, "i", 20_000), reading("c", 1000, 70.0, None, "j", 20_000)),
        bucket=60,
    )
    assert (found["1"].n_readings, found["1"].node_seconds) == (2, 40_000)
    assert found["1"].avg_cpu_utilization == pytest.approx(60)


def test_limits_are_strict(spark):
    columns = "job_id STRING, avg_cpu_utilization DOUBLE, avg_memory_utilization DOUBLE"
    frame = spark.createDataFrame(
        [("at", 80.0, 85.0), ("cpu", 80.1, None), ("memory", None, 85.1), ("nan", float("nan"), 1.0), ("none", None, None)],
        columns,
    )
    heavy = resources.resource_intensive_jobs(frame, Thresholds())
    assert sorted(rows(heavy, "job_id")) == [("cpu",), ("memory",)]


def test_bad_bucket_and_empty_tables(spark):
    none = empty(spark, "job_run_timeline", "node_timeline", "jobs")
    runs = none["job_run_timeline"].withColumn("cluster_id", F.lit("c"))
    assert usage(spark, runs, none["node_timeline"]) == {}
    with pytest.raises(ValueError, match="a second or more"):
        usage(spark, runs, none["node_timeline"], bucket=0)


def test_runs_meet_readings_by_bucket(spark, sf_dir):
    from fleetlens.checks import registry

    made = registry.queries()["job_resource_usage"](spark, sf_dir)
    text = made._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text
    join = next(line for line in text.splitlines() if "Join" in line and "piece_" in line)
    assert "bucket" in join.split("piece_")[0]
