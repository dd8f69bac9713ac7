"""The registered queries: every operator over the whole test tables.

Figures the operators leave unrounded are rounded to four digits here, because
the last bits of a sum of doubles depend on the engine. Dates become text and
nullable integers doubles, the types that clients of both engines show alike.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.checks import bindings
from fleetlens.checks.bindings import (
    INFO_DAYS,
    JOB_AS_OF,
    JOB_DAYS,
    NODE_AS_OF,
    NODE_DAYS,
)
from fleetlens.config import Thresholds
from fleetlens.functions import (
    calendar_lookback,
    format_duration,
    rolling_lookback,
    stable_round,
    threshold_level,
)
from fleetlens.operators import (
    advise,
    clusters,
    concurrency,
    detect,
    history,
    jobs,
    nodes,
    resources,
    schedules,
    spend,
    stats,
    trends,
    versions,
)
from fleetlens.plans import reports, rollups
from fleetlens.plans.bundles import cluster_bundle
from fleetlens.sources import catalog
from fleetlens.sources.sinks import shared_folder
from fleetlens.sources.tables import Tables
from fleetlens.streaming import (
    AlertRule,
    alert_episodes,
    read_timeline,
    read_windows,
    run_available,
    windowed_issues,
    windowed_utilization,
)

Query = Callable[[SparkSession, str], DataFrame]

LIMITS = Thresholds()
CHECK_DIGITS = 4

# Window and lateness of the streaming queries.
STREAM_WINDOW = "1 day"
STREAM_LATENESS = "2 hours"

_QUERIES: dict[str, Query] = {}


def _register(function: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(bindings.tables(spark, sf_dir))

    _QUERIES[function.__name__] = run
    return function


def _text_date(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.date_format(name, "yyyy-MM-dd"))


def _doubles(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.col(name).cast("double") for name in names})


# Jobs


def _health(t: Tables) -> DataFrame:
    return jobs.job_health(t.job_run_timeline, t.jobs, JOB_DAYS, JOB_AS_OF)


@_register
def job_runtime_metrics(t: Tables) -> DataFrame:
    return jobs.job_runtime_metrics(t.job_run_timeline, t.jobs, JOB_DAYS, JOB_AS_OF)


@_register
def job_failure_analysis(t: Tables) -> DataFrame:
    return jobs.job_failure_analysis(t.job_run_timeline, t.jobs, JOB_DAYS, JOB_AS_OF)


@_register
def simple_job_data(t: Tables) -> DataFrame:
    return jobs.simple_job_data(t.job_run_timeline, JOB_DAYS, JOB_AS_OF)


@_register
def recent_job_activity(t: Tables) -> DataFrame:
    days = jobs.recent_job_activity(t.job_run_timeline, JOB_DAYS, JOB_AS_OF)
    return _text_date(days, "job_date")


@_register
def job_runtime_active(t: Tables) -> DataFrame:
    return jobs.job_runtime_active(t.job_run_timeline, t.jobs, JOB_DAYS, JOB_AS_OF, CHECK_DIGITS)


@_register
def job_failure_slices(t: Tables) -> DataFrame:
    return jobs.job_failure_slices(t.job_run_timeline, t.jobs, JOB_DAYS, JOB_AS_OF)


@_register
def run_durations(t: Tables) -> DataFrame:
    return jobs.run_durations(t.job_run_timeline, JOB_DAYS, JOB_AS_OF)


@_register
def run_durations_active(t: Tables) -> DataFrame:
    return jobs.run_durations(t.job_run_timeline, JOB_DAYS, JOB_AS_OF, mode="active")


def _window_rows(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_slices"),
        F.min("period_start_time").alias("first_start"),
        F.max("period_start_time").alias("last_start"),
    )


@_register
def lookback_calendar(t: Tables) -> DataFrame:
    slices = t.job_run_timeline
    return _window_rows(calendar_lookback(slices, "period_start_time", JOB_DAYS, JOB_AS_OF))


@_register
def lookback_rolling(t: Tables) -> DataFrame:
    slices = t.job_run_timeline
    return _window_rows(rolling_lookback(slices, "period_start_time", JOB_DAYS, JOB_AS_OF))


@_register
def formatted_durations(t: Tables) -> DataFrame:
    runs = jobs.run_durations(t.job_run_timeline, JOB_DAYS, JOB_AS_OF)
    return runs.withColumn("duration", format_duration(F.col("duration_seconds")))


@_register
def standard_percentiles(t: Tables) -> DataFrame:
    runs = jobs.run_durations(t.job_run_timeline, JOB_DAYS, JOB_AS_OF)
    return stats.quantiles(runs, {"duration_seconds": "duration_seconds"}, digits=CHECK_DIGITS)


# History: figures with the metadata of their time

def _wall_clock(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.col(name).cast("timestamp_ntz") for name in names})


@_register
def runs_asof_jobs(t: Tables) -> DataFrame:
    return history.runs_asof_jobs(t.job_run_timeline, t.jobs, JOB_DAYS, JOB_AS_OF)


@_register
def job_health_by_name(t: Tables) -> DataFrame:
    return history.job_health_by_name(t.job_run_timeline, t.jobs, JOB_DAYS, JOB_AS_OF)


@_register
def readings_asof_clusters(t: Tables) -> DataFrame:
    taken = history.readings_asof_clusters(t.node_timeline, t.clusters, NODE_DAYS, NODE_AS_OF)
    figures = ("cpu_percent", "mem_used_percent")
    rounded = taken.withColumns({c: stable_round(F.col(c), CHECK_DIGITS) for c in figures})
    return _doubles(rounded, "num_workers")


@_register
def cluster_utilization_by_version(t: Tables) -> DataFrame:
    by_version = history.cluster_utilization_by_version(
        t.node_timeline, t.clusters, NODE_DAYS, NODE_AS_OF, CHECK_DIGITS
    )
    return _doubles(by_version, "num_workers")


# Concurrency


@_register
def concurrency_levels(t: Tables) -> DataFrame:
    return concurrency.concurrency_levels(t.job_run_timeline, JOB_DAYS, JOB_AS_OF)


@_register
def peak_concurrency(t: Tables) -> DataFrame:
    peaks = concurrency.peak_concurrency(
        t.job_run_timeline, JOB_DAYS, JOB_AS_OF, digits=CHECK_DIGITS
    )
    return _wall_clock(peaks, "peak_start")


@_register
def peak_concurrency_fleet(t: Tables) -> DataFrame:
    peaks = concurrency.peak_concurrency(
        t.job_run_timeline, JOB_DAYS, JOB_AS_OF, keys=(), digits=CHECK_DIGITS
    )
    return _wall_clock(peaks, "peak_start")


@_register
def busy_periods(t: Tables) -> DataFrame:
    periods = concurrency.busy_periods(t.job_run_timeline, JOB_DAYS, JOB_AS_OF)
    return _wall_clock(periods, "period_start", "period_end")


# Resources and schedules


def _usage(t: Tables, digits: int | None) -> DataFrame:
    return resources.job_resource_usage(
        bindings.run_clusters(t.job_run_timeline), t.node_timeline, t.jobs, NODE_DAYS, NODE_AS_OF, digits
    )


@_register
def job_resource_usage(t: Tables) -> DataFrame:
    return _usage(t, CHECK_DIGITS)


@_register
def resource_intensive_jobs(t: Tables) -> DataFrame:
    heavy = resources.resource_intensive_jobs(_usage(t, None), LIMITS)
    figures = [c for c in heavy.columns if c.endswith("utilization") or c == "cpu_node_seconds"]
    return heavy.withColumns({c: stable_round(F.col(c), CHECK_DIGITS) for c in figures})


def _schedules(t: Tables, digits: int | None) -> DataFrame:
    return schedules.job_schedules(t.job_run_timeline, t.jobs, JOB_DAYS, JOB_AS_OF, digits)


@_register
def job_schedules(t: Tables) -> DataFrame:
    return _schedules(t, CHECK_DIGITS)


@_register
def irregular_schedules(t: Tables) -> DataFrame:
    irregular = schedules.irregular_schedules(_schedules(t, None))
    figures = ("period_seconds", "gap_mad_seconds", "gap_spread", "phase_concentration")
    return irregular.withColumns({c: stable_round(F.col(c), CHECK_DIGITS) for c in figures})


# Trends; workspaces, as single jobs of the test tables have too few runs

WORKSPACES = ("workspace_id",)
RECENT_DAYS = 60


def _daily_durations(t: Tables) -> DataFrame:
    return trends.daily_durations(t.job_run_timeline, JOB_DAYS, JOB_AS_OF, WORKSPACES)


@_register
def duration_quantiles(t: Tables) -> DataFrame:
    return trends.duration_quantiles(_daily_durations(t), WORKSPACES)


@_register
def job_duration_quantiles(t: Tables) -> DataFrame:
    return trends.duration_quantiles(trends.daily_durations(t.job_run_timeline, JOB_DAYS, JOB_AS_OF))


@_register
def statistical_anomalies(t: Tables) -> DataFrame:
    found = trends.statistical_anomalies(_daily_durations(t), RECENT_DAYS, JOB_AS_OF, WORKSPACES)
    return _text_date(found, "day")


@_register
def duration_trends(t: Tables) -> DataFrame:
    return trends.duration_trends(_daily_durations(t), WORKSPACES)


@_register
def duration_changes(t: Tables) -> DataFrame:
    # A limit below the usual one, as durations of the test tables do not really change.
    changes = trends.duration_changes(_daily_durations(t), WORKSPACES, limit=0.8)
    return _text_date(changes, "change_day")


# Nodes and clusters


def _zero(t: Tables, ordered: bool = False) -> DataFrame:
    return nodes.cluster_utilization(t.node_timeline, NODE_DAYS, NODE_AS_OF, ordered=ordered)


# Rules look at unrounded figures; only tables that are results themselves are rounded.
def _instances(t: Tables, digits: int | None = None, ordered: bool = False) -> DataFrame:
    return nodes.cluster_instance_utilization(
        t.node_timeline, t.clusters, NODE_DAYS, NODE_AS_OF, digits, ordered
    )


def _efficiency(t: Tables, digits: int | None = None, ordered: bool = False) -> DataFrame:
    return nodes.cluster_efficiency(
        t.node_timeline, NODE_DAYS, NODE_AS_OF, digits, LIMITS, ordered
    )


@_register
def cluster_utilization_top20(t: Tables) -> DataFrame:
    return nodes.cluster_utilization_top(t.node_timeline, NODE_DAYS, NODE_AS_OF)


@_register
def cluster_utilization_zero(t: Tables) -> DataFrame:
    return _zero(t, ordered=True)


@_register
def cluster_utilization_raw(t: Tables) -> DataFrame:
    return nodes.cluster_utilization_raw(t.node_timeline, NODE_DAYS, NODE_AS_OF, CHECK_DIGITS)


@_register
def cluster_instance_utilization(t: Tables) -> DataFrame:
    return _instances(t, CHECK_DIGITS, ordered=True)


@_register
def instance_utilization_null_cluster(t: Tables) -> DataFrame:
    """Readings of one cluster come without its id: they are kept, without a description."""
    lost = t.node_timeline.withColumn("cluster_id", F.expr("nullif(cluster_id, 'c-07')"))
    return nodes.cluster_instance_utilization(
        lost, t.clusters, NODE_DAYS, NODE_AS_OF, CHECK_DIGITS, ordered=False
    )


@_register
def cluster_efficiency(t: Tables) -> DataFrame:
    return _efficiency(t, CHECK_DIGITS, ordered=True)


@_register
def cluster_efficiency_limits(t: Tables) -> DataFrame:
    limits = Thresholds(efficient_cpu_floor=70, efficient_memory_floor=70, low_cpu_reading=30)
    view = cluster_bundle(t, NODE_DAYS, NODE_AS_OF, limits=limits)["efficiency_metrics"]
    means = ("avg_cpu_utilization", "avg_memory_utilization")
    return view.withColumns({name: stable_round(F.col(name), CHECK_DIGITS) for name in means})


@_register
def reading_percentiles(t: Tables) -> DataFrame:
    cpu = F.col("cpu_user_percent") + F.col("cpu_system_percent")
    readings = t.node_timeline.select(cpu.alias("cpu"), "mem_used_percent")
    columns = {"cpu": "cpu", "memory": "mem_used_percent"}
    return stats.quantiles(readings, columns, digits=CHECK_DIGITS)


@_register
def cluster_report_details(t: Tables) -> DataFrame:
    return stats.present_columns(_zero(t), (*reports.DETAIL_COLUMNS, "not_there"))


@_register
def cluster_basic_info(t: Tables) -> DataFrame:
    return clusters.cluster_basic_info(t.clusters, INFO_DAYS, NODE_AS_OF)


@_register
def node_types(t: Tables) -> DataFrame:
    return clusters.node_types(t.node_types)


@_register
def cluster_costs(t: Tables) -> DataFrame:
    costs = clusters.cluster_costs(t.billing_usage, t.clusters, NODE_DAYS, NODE_AS_OF)
    return _doubles(costs, "total_usage", "num_workers")


@_register
def expensive_clusters(t: Tables) -> DataFrame:
    listed = spend.expensive_clusters(
        t.billing_usage, t.clusters, NODE_DAYS, NODE_AS_OF, digits=CHECK_DIGITS
    )
    return _doubles(listed, "total_usage")


@_register
def latest_jobs(t: Tables) -> DataFrame:
    return versions.latest_jobs(t.jobs)


@_register
def latest_clusters(t: Tables) -> DataFrame:
    return versions.latest_clusters(t.clusters)


@_register
def top_cpu(t: Tables) -> DataFrame:
    return stats.top_cpu(_zero(t))


@_register
def top_memory(t: Tables) -> DataFrame:
    return stats.top_memory(_zero(t))


@_register
def threshold_levels(t: Tables) -> DataFrame:
    cpu = F.col("avg_cpu_utilization")
    level = threshold_level(cpu, LIMITS.cpu_percent, LIMITS.severe_cpu)
    return _zero(t).select("cluster_id", "driver", cpu, level.alias("level"))


# Anomalies, issues and recommendations


@_register
def anomaly_long_running(t: Tables) -> DataFrame:
    runtime = jobs.job_runtime_metrics(
        t.job_run_timeline, t.jobs, JOB_DAYS, JOB_AS_OF, ordered=False
    )
    return detect.long_running_jobs(runtime, LIMITS)


@_register
def anomaly_high_failure(t: Tables) -> DataFrame:
    failures = jobs.job_failure_analysis(
        t.job_run_timeline, t.jobs, JOB_DAYS, JOB_AS_OF, ordered=False
    )
    return detect.high_failure_rates(failures, LIMITS)


@_register
def anomaly_underutilized(t: Tables) -> DataFrame:
    return detect.underutilized_clusters(_instances(t), LIMITS)


@_register
def anomaly_overutilized(t: Tables) -> DataFrame:
    return detect.overutilized_clusters(_instances(t), LIMITS)


@_register
def anomaly_inefficient(t: Tables) -> DataFrame:
    return detect.inefficient_clusters(_efficiency(t))


@_register
def job_anomalies(t: Tables) -> DataFrame:
    return _doubles(detect.job_anomalies(_health(t), LIMITS), "failed_runs", "total_runs")


@_register
def cluster_anomalies(t: Tables) -> DataFrame:
    rollup = nodes.node_rollup(t.node_timeline, NODE_DAYS, NODE_AS_OF, limits=LIMITS)
    per_cluster = nodes.regroup(rollup, ["cluster_id"])
    return detect.cluster_anomalies(
        nodes.instance_view(rollup, t.clusters, ordered=False),
        nodes.efficiency_view(per_cluster, limits=LIMITS, ordered=False),
        LIMITS,
    )


@_register
def performance_issues(t: Tables) -> DataFrame:
    return advise.performance_issues(_zero(t), LIMITS)


# A clock so late that its look-back finds no reading, and limits that no reading is over.
LATE_AS_OF = NODE_AS_OF + timedelta(days=365)
NO_LIMITS = Thresholds(
    cpu_percent=1e9, memory_percent=1e9, high_wait=1e9, idle_cpu=-1, downsize_cpu=-1,
    scale_up_cpu=1e9, relieve_memory=1e9, imbalance_gap=1e9,
)


def _nothing(t: Tables) -> DataFrame:
    return nodes.cluster_utilization(t.node_timeline, NODE_DAYS, LATE_AS_OF, ordered=False)


@_register
def issues_without_data(t: Tables) -> DataFrame:
    return advise.performance_issues(_nothing(t), LIMITS)


@_register
def issues_none_found(t: Tables) -> DataFrame:
    return advise.performance_issues(_zero(t), NO_LIMITS)


@_register
def recommendations_without_data(t: Tables) -> DataFrame:
    return advise.recommendations(_nothing(t), LIMITS)


@_register
def recommendations_none_found(t: Tables) -> DataFrame:
    return advise.recommendations(_zero(t), NO_LIMITS)


@_register
def issues_by_severity(t: Tables) -> DataFrame:
    return advise.issues_by_severity(advise.performance_issues(_zero(t), LIMITS))


@_register
def recommendations(t: Tables) -> DataFrame:
    return advise.recommendations(_zero(t), LIMITS)


@_register
def imbalanced_clusters(t: Tables) -> DataFrame:
    return advise.imbalanced_clusters(_zero(t), LIMITS, CHECK_DIGITS)


# Reports


@_register
def cluster_kpis(t: Tables) -> DataFrame:
    return reports.cluster_kpis(_zero(t))


@_register
def cluster_quantiles(t: Tables) -> DataFrame:
    return reports.cluster_quantiles(_zero(t))


@_register
def job_report_summary(t: Tables) -> DataFrame:
    return reports.job_summary(_health(t), _groups(t))


def _groups(t: Tables) -> DataFrame:
    return nodes.cluster_utilization_top(t.node_timeline, NODE_DAYS, NODE_AS_OF, limit=None)


@_register
def job_report_lines(t: Tables) -> DataFrame:
    return reports.job_report_lines(_health(t), _groups(t), JOB_DAYS, JOB_AS_OF, LIMITS)


@_register
def cluster_monitor_summary(t: Tables) -> DataFrame:
    return reports.cluster_monitor_summary(_instances(t))


@_register
def cluster_monitor_lines(t: Tables) -> DataFrame:
    return reports.cluster_monitor_lines(_instances(t), NODE_DAYS, NODE_AS_OF, LIMITS)


@_register
def cluster_report_lines(t: Tables) -> DataFrame:
    return reports.cluster_report_lines(_zero(t), NODE_DAYS, NODE_AS_OF, limits=LIMITS)


@_register
def metrics_summary(t: Tables) -> DataFrame:
    return stats.metrics_summary(cluster_bundle(t, NODE_DAYS, NODE_AS_OF))


# Daily partials


def _daily(t: Tables) -> DataFrame:
    """The partials that a refresh writes, here merged as they are made: no query stores a table."""
    first = NODE_AS_OF.date() - timedelta(days=rollups.RETENTION_DAYS)
    return rollups.daily_partials(rollups.touched(t.node_timeline, first, NODE_AS_OF), LIMITS)


@_register
def rollup_utilization_top20(t: Tables) -> DataFrame:
    return rollups.utilization_top(_daily(t), NODE_DAYS, NODE_AS_OF)


@_register
def rollup_utilization_zero(t: Tables) -> DataFrame:
    return rollups.utilization(_daily(t), NODE_DAYS, NODE_AS_OF)


@_register
def rollup_efficiency(t: Tables) -> DataFrame:
    return rollups.efficiency(_daily(t), NODE_DAYS, NODE_AS_OF, CHECK_DIGITS, LIMITS)


# Catalog and SQL

FAILED_RUNS_SQL = """
    SELECT job_id, count(DISTINCT run_id) AS failed_runs, max(period_end_time) AS last_end
    FROM {job_run_timeline}
    WHERE period_start_time >= date_sub(:as_of, :days)
      AND period_date >= date_sub(:as_of, :days)
      AND result_state IN ('FAILED', 'TIMEOUT', 'CANCELLED')
    GROUP BY job_id
"""


def sql_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = bindings.tables(spark, sf_dir)
    return catalog.run_sql(
        spark, FAILED_RUNS_SQL, tables, as_of=JOB_AS_OF.date(), days=JOB_DAYS
    )


@_register
def availability(t: Tables) -> DataFrame:
    return catalog.availability(t, count_rows=True)


# Streaming


def _windows_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = read_timeline(spark, sf_dir, schema, glob="events.parquet")
    return windowed_utilization(bindings.node_timeline(events), STREAM_WINDOW, STREAM_LATENESS)


def _completed(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all files and read back what it wrote."""
    spark = stream.sparkSession
    folder = shared_folder(spark, name)
    run_available(stream, f"{folder}/out", f"{folder}/checkpoint")
    written = spark.read.schema(stream.schema).parquet(f"{folder}/out").select(stream.columns)
    bounds = ("window_start", "window_end")
    return written.withColumns({c: F.col(c).cast("timestamp_ntz") for c in bounds})


def stream_utilization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _completed(_windows_from_files(spark, sf_dir), "stream-utilization")


def stream_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _completed(windowed_issues(_windows_from_files(spark, sf_dir), LIMITS), "stream-issues")


# Windows of a day are few, so that short rows of them decide here.
EPISODE_RULE = AlertRule(limit=50.0, open_after=2, close_after=1)


def stream_alert_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _find_code(spark)
    windows = _windows_from_files(spark, sf_dir)
    folder = shared_folder(spark, "stream-alert-windows")
    run_available(windows, f"{folder}/out", f"{folder}/checkpoint")
    written = read_windows(spark, f"{folder}/out", windows.schema)
    return _completed(alert_episodes(written, EPISODE_RULE), "stream-alert-episodes")


def _find_code(spark: SparkSession) -> None:
    """Let Python workers of a session on one machine find the package. A cluster is sent its code."""
    if (spark.conf.get("spark.master", None) or "").startswith("local"):
        root = str(Path(__file__).resolve().parents[2])
        spark.sparkContext.environment.setdefault("PYTHONPATH", root)


def queries() -> dict[str, Query]:
    return {
        **_QUERIES,
        "sql_passthrough": sql_passthrough,
        "stream_utilization": stream_utilization,
        "stream_issues": stream_issues,
        "stream_alert_episodes": stream_alert_episodes,
    }
