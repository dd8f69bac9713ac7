from __future__ import annotations

from datetime import timedelta

import pytest
from frames import AS_OF, DAY, clusters, empty, jobs, readings, slices, utilization

from conftest import rows
from fleetlens.config import Thresholds
from fleetlens.operators import advise
from fleetlens.operators.jobs import job_health
from fleetlens.operators.nodes import cluster_efficiency
from fleetlens.plans import reports
from fleetlens.plans.bundles import cluster_bundle, job_bundle
from fleetlens.sources import Tables


def text(lines):
    return [line for (line,) in rows(lines.orderBy("ord", "rank", "line"), "line")]


def job_tables(spark):
    runs = [
        (str(job), f"{job}-{run}", 0, 50 + 5 * job, "FAILED" if run < job else "SUCCESS")
        for job in range(8)
        for run in range(4)
    ]
    return Tables.of(
        spark,
        {
            "job_run_timeline": slices(spark, *runs),
            "jobs": jobs(spark, *[(str(job), f"name {job}", DAY) for job in range(8)]),
            "node_timeline": readings(spark, *[("c", 40.0, 10.0, 1.0, 20.0)] * 6),
            "clusters": clusters(spark, ("c", "cluster c", DAY)),
            **empty(spark, "node_types", "billing_usage"),
        },
    )


def test_job_report(spark):
    tables = job_tables(spark)
    health = job_health(tables.job_run_timeline, tables.jobs, 7, AS_OF)
    top = job_bundle(tables, 7, AS_OF)["cluster_utilization"]
    lines = text(reports.job_report_lines(health, top, 7, AS_OF))
    assert lines[:15] == [
        "# Job Monitoring Report",
        "Generated: 2024-01-15 13:00:00",
        "Period: Last 7 days",
        "## Summary Statistics",
        "- Total Jobs Monitored: 8",
        "- Average Job Runtime: 67.50 minutes",
        "- Average Success Rate: 31.25%",
        "- Total Job Runs: 32",
        "- Total Failures: 22",
        "- Average CPU Utilization: 50.00%",
        "- Average Memory Utilization: 20.00%",
        "- Average CPU Utilization (all groups): 50.00%",
        "- Average Memory Utilization (all groups): 20.00%",
        "## Detected Anomalies",
        "### Long Running Jobs (5 detected)",
    ]
    assert lines[15] == "- **name 7** (ID: 7): Avg 85.0 min"
    assert lines[19] == "- **name 3** (ID: 3): Avg 65.0 min"
    assert lines[20] == "### High Failure Rate Jobs (7 detected)"
    assert lines[21] == "- **name 4** (ID: 4): 100.0% failure rate"
    assert lines[26:] == [
        "## Details",
        "- job_health: 8 rows since midnight 7 days ago",
        "- cluster_utilization: 1 rows since midnight 7 days ago",
    ]


def test_job_report_without_data_has_no_figures(spark):
    tables = Tables.of(spark, empty(spark, "job_run_timeline", "node_timeline"))
    health = job_health(tables.job_run_timeline, tables.jobs, 7, AS_OF)
    top = job_bundle(tables, 7, AS_OF)["cluster_utilization"]
    assert text(reports.job_report_lines(health, top, 7, AS_OF)) == [
        "# Job Monitoring Report",
        "Generated: 2024-01-15 13:00:00",
        "Period: Last 7 days",
        "## Summary Statistics",
        "## Detected Anomalies",
        "## Details",
        "- job_health: 0 rows since midnight 7 days ago",
        "- cluster_utilization: 0 rows since midnight 7 days ago",
    ]


def test_kpis_are_unweighted(spark):
    found = reports.cluster_kpis(utilization(spark, ("a", 10.0, 20.0, 0.0, 1), ("b", 30.0, 40.0, 0.0, 99)))
    assert rows(found, "metric", "value", "text") == [
        ("Clusters analyzed", 2.0, "2"),
        ("Average CPU utilization", 20.0, "20.00%"),
        ("Peak CPU utilization", 30.0, "30.00%"),
        ("Average memory utilization", 30.0, "30.00%"),
        ("Peak memory utilization", 40.0, "40.00%"),
    ]
    assert rows(reports.cluster_kpis(utilization(spark))) == []


def test_cluster_report(spark):
    df = utilization(
        spark, ("a", 95.0, 50.0, 0.0), ("b", 92.0, 50.0, 20.0), ("c", 10.0, 96.0, 0.0)
    )
    lines = text(reports.cluster_report_lines(df, 7, AS_OF))
    start = lines.index("## Performance Issues")
    assert lines[start : start + 12] == [
        "## Performance Issues",
        "### HIGH (3)",
        "- High CPU: Cluster a - 95.0%",
        "- High CPU: Cluster b - 92.0%",
        "- High Memory: Cluster c - 96.0%",
        "### MEDIUM (1)",
        "- High CPU Wait: Cluster b - 20.0%",
        "### LOW (1)",
        "- Underutilized: Cluster c - Only 10.0% CPU",
        "## Recommendations",
        "### COST OPTIMIZATION",
        "- 1 clusters with <30% CPU usage could be downsized",
    ]
    assert "- Time Window: 2024-01-08 13:00 to 2024-01-15 13:00" in lines
    assert "- CPU utilization: p50 92.00, p75 93.50, p90 94.40, p95 94.70" in lines


def test_cluster_report_without_data(spark):
    lines = text(reports.cluster_report_lines(utilization(spark), 7, AS_OF))
    assert "### OTHER (1)" in lines
    assert "- No cluster data available for analysis" in lines
    assert "- No data available for recommendations" in lines


def test_cluster_monitor_report(spark):
    timeline = readings(
        spark, *[(f"c{i}", float(i), 0.0, 1.0, 1.0, False, f"i{i}") for i in range(7)],
        ("hot", 90.0, 0.0, 1.0, 1.0, False, "h"),
    )
    tables = Tables.of(
        spark,
        {
            "node_timeline": timeline,
            "clusters": clusters(spark, ("hot", "big one", DAY)),
            **empty(spark, "node_types", "billing_usage"),
        },
    )
    instances = cluster_bundle(tables, 7, AS_OF)["cluster_utilization"]
    lines = text(reports.cluster_monitor_lines(instances, 7, AS_OF))
    assert lines[4:9] == [
        "- Total Clusters Monitored: 8",
        "- Average CPU Utilization: 13.9%",
        "- Average Memory Utilization: 1.0%",
        "## Detected Issues",
        "### Underutilized Clusters (7 found)",
    ]
    assert lines[9] == "- **c6**: CPU 6.0%, Memory 1.0%"
    assert lines[-2:] == [
        "### Overutilized Clusters (1 found)",
        "- **big one**: CPU 90.0%, Memory 1.0%",
    ]
    assert len(lines) == 16


def test_long_look_backs_are_not_cut(spark):
    old = readings(spark, ("c", 1.0, 1.0, 1.0, 1.0, False, "i", AS_OF - timedelta(days=95)))
    others = empty(spark, "node_types", "billing_usage", "job_run_timeline")
    tables = Tables.of(spark, {"node_timeline": old, **others})
    assert cluster_bundle(tables, 400, AS_OF)["cluster_utilization"].count() == 1
    assert cluster_bundle(tables, 400, AS_OF)["efficiency_metrics"].count() == 1
    with pytest.raises(ValueError, match="look-back"):
        cluster_bundle(tables, 0, AS_OF)
    assert set(cluster_bundle(tables, 7, AS_OF)) == {
        "cluster_utilization",
        "node_types",
        "efficiency_metrics",
        "cost_analysis",
    }
    assert set(job_bundle(tables, 400, AS_OF)) == {
        "runtime_metrics",
        "failure_analysis",
        "cluster_utilization",
    }


def test_written_reports(spark, tmp_path):
    tables = job_tables(spark)

    def report(name):
        parts = sorted((tmp_path / name / "report").glob("part-*"))
        return "".join(part.read_text() for part in parts).splitlines()

    def table(name, of):
        return spark.read.parquet(str(tmp_path / of / name))

    reports.write_job_report(tables, str(tmp_path / "job"), 7, AS_OF)
    assert report("job")[0] == "# Job Monitoring Report"
    assert table("runtime_metrics", "job").count() == 8
    assert table("failure_analysis", "job").count() == 8
    reports.write_cluster_monitor_report(tables, str(tmp_path / "monitor"), 7, AS_OF)
    assert report("monitor")[0] == "# Cluster Monitoring Report"
    assert table("efficiency_metrics", "monitor").count() == 1
    reports.write_cluster_report(tables, str(tmp_path / "cluster"), 7, AS_OF)
    assert report("cluster")[0] == "# Cluster Performance Analysis Report"
    assert table("cluster_utilization", "cluster").columns == list(reports.DETAIL_COLUMNS)
    assert table("cluster_info", "cluster").count() == 1


def test_limits_reach_the_written_efficiency(spark, tmp_path):
    tables = job_tables(spark)
    limits = Thresholds(efficient_cpu_floor=101, efficient_memory_floor=101)
    reports.write_cluster_monitor_report(tables, str(tmp_path / "m"), 7, AS_OF, limits)
    written = spark.read.parquet(str(tmp_path / "m" / "efficiency_metrics"))
    direct = cluster_efficiency(tables.node_timeline, 7, AS_OF, limits=limits)
    assert rows(written) == rows(direct)
    assert rows(written, "efficiency_category") == [("Underutilized",)]


def test_reports_need_rows_and_tables(spark, tmp_path):
    none = Tables.of(spark, empty(spark, "job_run_timeline", "node_timeline"))
    with pytest.raises(LookupError, match="no rows"):
        reports.write_cluster_report(none, str(tmp_path / "a"), 7, AS_OF)
    with pytest.raises(LookupError, match="not bound"):
        reports.write_job_report(Tables.of(spark, {}), str(tmp_path / "b"), 7, AS_OF)


def test_limits_are_printed_in_full(spark):
    given = advise.recommendations(utilization(spark, ("c", 10.0, 10.0, 0.0)), Thresholds(downsize_cpu=32.5))
    assert rows(given, "message")[0] == ("1 clusters with <32.5% CPU usage could be downsized",)
