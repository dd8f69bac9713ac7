"""As-of joins: facts with the metadata of their time."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from conftest import rows, ts
from frames import AS_OF, DAY, clusters, empty, jobs, readings, slices
from pyspark.sql import functions as F

from fleetlens.operators import history
from fleetlens.operators.timeline import asof_join

FACTS = "key STRING, at TIMESTAMP, n INT"
VERSIONS = "key STRING, since TIMESTAMP, label STRING"


def expected(facts, versions):
    found = []
    for key, at, n in facts:
        valid = [
            (since, label)
            for k, since, label in versions
            if k == key and k is not None and since is not None and at is not None and since <= at
        ]
        found.append((key, at, n, max(valid, key=lambda v: (v[0], v[1] or ""))[1] if valid else None))
    return sorted(found, key=repr)


def joined(spark, facts, versions, seconds=3600):
    made = asof_join(
        spark.createDataFrame(facts, FACTS),
        spark.createDataFrame(versions, VERSIONS),
        ["key"],
        "at",
        "since",
        {"label": "label"},
        tie_break=["label"],
        slice_seconds=seconds,
    )
    return sorted(rows(made), key=repr)


@pytest.mark.parametrize("seconds", [1, 600, 86_400, 10**9])
def test_random_facts_equal_brute_force(spark, seconds):
    rng = random.Random(seconds)
    start = datetime(1969, 12, 31, 20)

    def moment():
        return None if rng.random() < 0.05 else start + timedelta(seconds=rng.randrange(0, 30_000, 300))

    keys = ["hot"] * 6 + ["a", "b", "only facts", None]
    facts = [(rng.choice(keys), moment(), i) for i in range(400)]
    versions = [
        (rng.choice(["hot", "a", "b", "only versions", None]), moment(), f"v{i % 40}") for i in range(120)
    ]
    assert joined(spark, facts, versions, seconds) == expected(facts, versions)


def test_version_counts_from_its_instant_on(spark):
    since = ts("2024-01-05 00:00:00")
    facts = [("a", since - timedelta(microseconds=1), 1), ("a", since, 2), ("a", ts("2024-03-01"), 3)]
    versions = [("a", since, "x")]
    assert [row[3] for row in joined(spark, facts, versions)] == [None, "x", "x"]


def test_null_label_is_a_version(spark):
    facts = [("a", ts("2024-01-03"), 1)]
    versions = [("a", ts("2024-01-01"), "old"), ("a", ts("2024-01-02"), None)]
    assert joined(spark, facts, versions) == [("a", ts("2024-01-03"), 1, None)]


def test_empty_sides(spark):
    assert joined(spark, [], [("a", DAY, "x")]) == []
    assert joined(spark, [("a", DAY, 1)], []) == [("a", DAY, 1, None)]


def test_bad_arguments(spark):
    facts, versions = spark.createDataFrame([], FACTS), spark.createDataFrame([], VERSIONS)
    with pytest.raises(ValueError, match="there already"):
        asof_join(facts, versions, ["key"], "at", "since", {"n": "label"})
    with pytest.raises(ValueError, match="a second or more"):
        asof_join(facts, versions, ["key"], "at", "since", {"x": "label"}, slice_seconds=0)


def test_extra_columns_are_kept(spark):
    facts = spark.createDataFrame([("a", DAY, 1)], FACTS).withColumn("label", F.lit("own"))
    versions = spark.createDataFrame([("a", DAY, "x")], VERSIONS)
    made = asof_join(facts, versions, ["key"], "at", "since", {"valid": "label"})
    assert rows(made) == [("a", DAY, 1, "own", "x")]


def test_hot_key_is_split_over_tasks(spark):
    """Half of all facts have one key; no task sorts more than a small part of them."""
    facts = spark.range(20_000).select(
        F.expr("IF(id % 2 = 0, 'hot', concat('k', id % 500)) AS key"),
        F.expr("timestamp_seconds(1700000000 + id * 400) AS at"),
    )
    versions = spark.range(50).select(
        F.lit("hot").alias("key"), F.expr("timestamp_seconds(1700000000 + id * 100000) AS since"),
        F.expr("concat('v', id) AS label"),
    )
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        made = asof_join(facts, versions, ["key"], "at", "since", {"label": "label"})
        of_hot = made.filter("key = 'hot' AND label IS NOT NULL")
        tasks = of_hot.groupBy(F.spark_partition_id().alias("task")).count().collect()
        text = made._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sum(t["count"] for t in tasks) == 10_000
    assert len(tasks) == 16
    assert max(t["count"] for t in tasks) < 2_000
    # The facts themselves are shuffled once, by slice and key, and no Python is involved.
    assert "hashpartitioning(_slice" in text and "Python" not in text


NAMES = [("1", "old", ts("2024-01-01")), ("1", "new", ts("2024-01-14 00:30:00"))]


def test_runs_have_the_name_of_their_time(spark):
    timeline = slices(
        spark,
        ("1", "before", 10, 20, "SUCCESS"),
        ("1", "across", 20, 40, "FAILED"),
        ("1", "at", 30, 50, None),
        ("1", "after", 60, 70, "SUCCESS"),
        ("2", "unnamed", 0, 10, "SUCCESS"),
        ("1", "other", 60, 70, "SUCCESS", "elsewhere"),
    )
    made = history.runs_asof_jobs(timeline, jobs(spark, *NAMES), 7, AS_OF)
    named = {row.run_id: row.job_name for row in made.collect()}
    assert named == {
        "before": "old", "across": "old", "at": "new", "after": "new", "unnamed": "Job_2", "other": "Job_1",
    }


def test_health_is_told_by_name(spark):
    timeline = slices(
        spark,
        ("1", "a", 10, 20, "SUCCESS"),
        ("1", "b", 20, 40, "FAILED"),
        ("1", "c", 60, 70, "SUCCESS"),
    )
    made = history.job_health_by_name(timeline, jobs(spark, *NAMES), 7, AS_OF)
    columns = ("job_name", "total_runs", "avg_duration_seconds", "failure_rate_percent")
    assert rows(made, *columns) == [("old", 2, 900.0, 50.0), ("new", 1, 600.0, 0.0)]


def test_readings_have_the_version_of_their_time(spark):
    taken = readings(
        spark,
        ("c", 10.0, 0.0, 0.0, 50.0, False, "i", DAY),
        ("c", 30.0, 0.0, 0.0, 50.0, False, "i", DAY + timedelta(minutes=5)),
        ("c", None, 0.0, 0.0, 50.0, False, "j", DAY + timedelta(minutes=6)),
        (None, 50.0, 0.0, 0.0, 50.0, False, "i", DAY),
    )
    described = clusters(spark, ("c", "small", DAY), ("c", "large", DAY + timedelta(minutes=5)))
    made = history.cluster_utilization_by_version(taken, described, 7, AS_OF)
    columns = ("cluster_id", "cluster_name", "data_points", "n_instances", "avg_cpu_utilization")
    assert rows(made, *columns) == [
        (None, None, 1, 1, 50.0), ("c", "small", 1, 1, 10.0), ("c", "large", 2, 2, 30.0),
    ]


def test_empty_tables(spark):
    none = empty(spark, "job_run_timeline", "jobs", "node_timeline", "clusters")
    assert history.runs_asof_jobs(none["job_run_timeline"], none["jobs"], 7, AS_OF).count() == 0
    assert history.readings_asof_clusters(none["node_timeline"], none["clusters"], 7, AS_OF).count() == 0
