from __future__ import annotations

import pytest
from frames import utilization

from conftest import rows
from fleetlens.config import Thresholds
from fleetlens.functions import format_duration, threshold_level
from fleetlens.operators import advise, detect
from pyspark.sql import functions as F

BELOW, ABOVE = -0.01, 0.01


def runtime(spark, *seconds):
    return spark.createDataFrame(
        [(str(i), f"job {i}", s, 7200) for i, s in enumerate(seconds)],
        "job_id STRING, job_name STRING, avg_duration_seconds DOUBLE, max_duration_seconds BIGINT",
    )


def instances(spark, *pairs):
    return spark.createDataFrame(
        [("c", "name", cpu, memory) for cpu, memory in pairs],
        "cluster_id STRING, cluster_name STRING, avg_cpu_utilization DOUBLE, "
        "avg_memory_utilization DOUBLE",
    )


def test_long_running_is_strict_and_in_minutes(spark):
    found = detect.long_running_jobs(runtime(spark, 3599.99, 3600.0, 3600.6, None, float("nan")))
    assert rows(found) == [("2", "job 2", 60.01, 120.0)]


def test_high_failure_is_strict(spark):
    failures = spark.createDataFrame(
        [("a", "a", 9.99, 1, 9), ("b", "b", 10.0, 1, 10), ("c", "c", 10.01, 2, 10), ("d", "d", None, 0, 0)],
        "job_id STRING, job_name STRING, failure_rate_percent DOUBLE, failed_runs BIGINT, "
        "total_runs BIGINT",
    )
    assert rows(detect.high_failure_rates(failures)) == [("c", "c", 10.01, 2, 10)]


def test_underutilized_needs_both(spark):
    pairs = [(19.99, 29.99), (20.0, 29.0), (19.0, 30.0), (None, 1.0), (1.0, None)]
    found = detect.underutilized_clusters(instances(spark, *pairs))
    assert rows(found, "avg_cpu_utilization") == [(19.99,)]


def test_overutilized_needs_one(spark):
    nan = float("nan")
    pairs = [(85.0, 90.0), (85.01, 0.0), (0.0, 90.01), (None, 91.0), (None, None), (nan, nan)]
    found = detect.overutilized_clusters(instances(spark, *pairs))
    assert rows(found, "avg_cpu_utilization", "avg_memory_utilization") == [
        (85.01, 0.0),
        (0.0, 90.01),
        (None, 91.0),
    ]


def test_inefficient_clusters_and_collected_anomalies(spark):
    efficiency = spark.createDataFrame(
        [("a", 5.0, 50.0, 60.0, "Underutilized"), ("b", 50.0, 0.0, 0.0, "Normal")],
        "cluster_id STRING, avg_cpu_utilization DOUBLE, low_cpu_percent DOUBLE, "
        "low_memory_percent DOUBLE, efficiency_category STRING",
    )
    assert rows(detect.inefficient_clusters(efficiency)) == [("a", 5.0, 50.0, 60.0)]
    found = detect.cluster_anomalies(instances(spark, (1.0, 1.0), (99.0, 1.0)), efficiency)
    assert rows(found, "kind", "cluster_id", "cluster_name", "low_cpu_percent") == [
        ("underutilized_clusters", "c", "name", None),
        ("overutilized_clusters", "c", "name", None),
        ("inefficient_clusters", "a", None, 50.0),
    ]


def test_collected_job_anomalies(spark):
    health = spark.createDataFrame(
        [
            ("0", "n", 4000.0, 5000, 0.0, 0, 3),
            ("a", "a", 5.0, 5, 50.0, 1, 2),
            ("b", "b", 4000.0, 5000, 50.0, 2, 4),
            ("c", "c", 3600.0, 5000, None, 0, 0),
        ],
        "job_id STRING, job_name STRING, avg_duration_seconds DOUBLE, max_duration_seconds BIGINT, "
        "failure_rate_percent DOUBLE, failed_runs BIGINT, finished_runs BIGINT",
    )
    found = detect.job_anomalies(health)
    assert sorted(rows(found, "kind", "job_id", "avg_duration_minutes", "failed_runs")) == [
        ("high_failure_rates", "a", None, 1),
        ("high_failure_rates", "b", None, 2),
        ("long_running_jobs", "0", 66.67, None),
        ("long_running_jobs", "b", 66.67, None),
    ]


@pytest.mark.parametrize(
    "cpu, memory, wait, expected",
    [
        (80.0, 85.0, 15.0, []),
        (80.01, 50.0, 0.0, [("High CPU", "MEDIUM")]),
        (90.0, 50.0, 0.0, [("High CPU", "MEDIUM")]),
        (90.01, 50.0, 0.0, [("High CPU", "HIGH")]),
        (50.0, 85.01, 0.0, [("High Memory", "MEDIUM")]),
        (50.0, 95.0, 0.0, [("High Memory", "MEDIUM")]),
        (50.0, 95.01, 0.0, [("High Memory", "HIGH")]),
        (50.0, 50.0, 15.01, [("High CPU Wait", "MEDIUM")]),
        (20.0, 50.0, 0.0, []),
        (19.99, 50.0, 0.0, [("Underutilized", "LOW")]),
        (95.0, 99.0, 20.0, [("High CPU", "HIGH"), ("High Memory", "HIGH"), ("High CPU Wait", "MEDIUM")]),
        (None, None, None, []),
    ],
)
def test_issue_limits(spark, cpu, memory, wait, expected):
    found = advise.row_issues(utilization(spark, ("c", cpu, memory, wait)))
    assert rows(found, "rule", "severity") == expected


def test_issue_texts(spark):
    found = advise.performance_issues(utilization(spark, ("c", 91.25, 50.0, 16.0), ("d", 1.0, 1.0, 1.0)))
    assert sorted(rows(found, "issue")) == [
        ("[HIGH] High CPU: Cluster c - 91.3%",),
        ("[LOW] Underutilized: Cluster d - Only 1.0% CPU",),
        ("[MEDIUM] High CPU Wait: Cluster c - 16.0%",),
    ]


def test_issue_remarks(spark):
    quiet = advise.performance_issues(utilization(spark, ("c", 50.0, 50.0, 0.0)))
    assert rows(quiet, "severity", "issue") == [
        ("OTHER", "No significant performance issues detected")
    ]
    empty = advise.performance_issues(utilization(spark))
    assert rows(empty, "severity", "issue") == [("OTHER", "No cluster data available for analysis")]
    assert rows(advise.issues_by_severity(empty)) == [("OTHER", 1, 4)]


def test_issues_by_severity_add_up_in_order(spark):
    issues = advise.performance_issues(
        utilization(spark, ("a", 95.0, 99.0, 20.0), ("b", 5.0, 5.0, 20.0), ("c", 85.0, 1.0, 1.0))
    )
    counted = rows(advise.issues_by_severity(issues), "severity", "n_issues")
    assert counted == [("HIGH", 2), ("MEDIUM", 3), ("LOW", 1)]
    assert sum(n for _, n in counted) == issues.count()


def test_recommendations_count_rows_and_clusters(spark):
    found = advise.recommendations(
        utilization(
            spark,
            ("a", 29.99, 50.0, 0.0, 5, True),
            ("a", 10.0, 50.0, 0.0, 5, False),
            ("b", 30.0, 50.0, 0.0),
            ("c", 85.01, 90.01, 0.0),
            ("d", 85.0, 90.0, 0.0),
        )
    )
    assert rows(found, "theme", "message") == [
        ("COST OPTIMIZATION", "2 clusters with <30% CPU usage could be downsized"),
        ("PERFORMANCE", "1 clusters with >85% CPU usage may need scaling"),
        ("MEMORY", "1 clusters with >90% memory usage need attention"),
    ]


def test_balance_is_weighted_by_points(spark):
    df = utilization(spark, ("a", 90.0, 10.0, 0.0, 9, True), ("a", 0.0, 90.0, 0.0, 1, False))
    assert rows(advise.imbalanced_clusters(df)) == [("a", 81.0, 18.0, 63.0)]
    assert rows(advise.recommendations(df), "theme", "n") == [
        ("COST OPTIMIZATION", 1),
        ("PERFORMANCE", 1),
        ("BALANCE", 1),
    ]


def test_balance_is_strict_and_leaves_out_rows_without_cluster(spark):
    df = utilization(spark, ("a", 80.0, 40.0, 0.0), (None, 80.0, 1.0, 0.0))
    assert rows(advise.imbalanced_clusters(df)) == []
    assert rows(advise.recommendations(df), "message") == [("System appears well-optimized",)]


def test_recommendation_remark_without_data(spark):
    assert rows(advise.recommendations(utilization(spark)), "theme", "n", "message") == [
        ("OTHER", None, "No data available for recommendations")
    ]


def test_other_limits_change_rules_and_texts(spark):
    limits = Thresholds(cpu_percent=40.0, downsize_cpu=60.0)
    df = utilization(spark, ("a", 50.0, 50.0, 0.0))
    assert rows(advise.performance_issues(df, limits), "rule") == [("High CPU",)]
    assert rows(advise.recommendations(df, limits), "message") == [
        ("1 clusters with <60% CPU usage could be downsized",)
    ]


@pytest.mark.parametrize(
    "value, level",
    [(79.99, "normal"), (80.0, "warning"), (89.99, "warning"), (90.0, "critical"), (None, "normal")],
)
def test_levels_are_inclusive(spark, value, level):
    df = spark.createDataFrame([(value,)], "v DOUBLE")
    assert rows(df.select(threshold_level(F.col("v"), 80.0, 90.0))) == [(level,)]


@pytest.mark.parametrize(
    "seconds, text",
    [(0.0, "0.0s"), (59.9, "59.9s"), (60.0, "1.0m"), (3599.0, "60.0m"), (3600.0, "1.0h"), (None, None)],
)
def test_durations(spark, seconds, text):
    df = spark.createDataFrame([(seconds,)], "s DOUBLE")
    assert rows(df.select(format_duration(F.col("s")))) == [(text,)]
