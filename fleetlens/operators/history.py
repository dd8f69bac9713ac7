"""Figures with the metadata that was valid at the time, not with today's."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens import wording
from fleetlens.functions import calendar_lookback, descending, percent, rounded
from fleetlens.operators.jobs import JOB_KEYS, RUN_KEYS, run_rollup
from fleetlens.operators.timeline import SLICE_SECONDS, asof_join

CLUSTER_COLUMNS = {
    "cluster_name": "cluster_name",
    "node_type": "node_type_id",
    "num_workers": "num_workers",
    "version_time": "change_time",
}


def _named_runs(
    timeline: DataFrame, jobs: DataFrame, days: int, as_of: datetime | None, slice_seconds: int
) -> DataFrame:
    runs = run_rollup(calendar_lookback(timeline, "period_start_time", days, as_of))
    unnamed = F.concat(F.lit(wording.UNNAMED_JOB_PREFIX), F.col("job_id").cast("string"))
    return asof_join(
        runs,
        jobs,
        JOB_KEYS,
        "started",
        "change_time",
        {"job_name": "name", "version_time": "change_time"},
        tie_break=["name"],
        slice_seconds=slice_seconds,
    ).withColumn("job_name", F.coalesce("job_name", unnamed))


def runs_asof_jobs(
    timeline: DataFrame,
    jobs: DataFrame,
    days: int = 7,
    as_of: datetime | None = None,
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """Each run with the name its job had when the run started, and since when it had it.

    Runs that started before their job's first version get the fallback name.
    """
    named = _named_runs(timeline, jobs, days, as_of, slice_seconds)
    return named.select(
        *RUN_KEYS, "started", "envelope_seconds", "succeeded", "failed", "job_name", "version_time"
    )


def job_health_by_name(
    timeline: DataFrame,
    jobs: DataFrame,
    days: int = 7,
    as_of: datetime | None = None,
    digits: int | None = 2,
    ordered: bool = True,
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """Runs, durations and failures of each job under each name it had.

    A job that was renamed has a row for each name under which it ran, so that a change
    of its figures can be told from a change of the job.
    """
    keys = (*JOB_KEYS, "job_name")
    health = (
        _named_runs(timeline, jobs, days, as_of, slice_seconds)
        .groupBy(*keys)
        .agg(
            F.count("run_id").alias("total_runs"),
            F.min("started").alias("first_start"),
            F.max("started").alias("last_start"),
            F.expr(f"{rounded('avg(envelope_seconds)', digits)} AS avg_duration_seconds"),
            F.expr("count_if(run_id IS NOT NULL AND succeeded) AS successful_runs"),
            F.expr("count_if(run_id IS NOT NULL AND failed) AS failed_runs"),
        )
        .filter("total_runs > 0")
        .selectExpr(
            "*",
            f"{percent('successful_runs', 'total_runs')} AS success_rate_percent",
            f"{percent('failed_runs', 'total_runs')} AS failure_rate_percent",
        )
    )
    return health.orderBy(*descending(keys, "total_runs")) if ordered else health


def readings_asof_clusters(
    node_timeline: DataFrame,
    clusters: DataFrame,
    days: int = 7,
    as_of: datetime | None = None,
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """Each node reading with the name, node type and size its cluster had when it was taken."""
    readings = calendar_lookback(node_timeline, "start_time", days, as_of).select(
        "cluster_id",
        "instance_id",
        "driver",
        "start_time",
        (F.col("cpu_user_percent") + F.col("cpu_system_percent")).alias("cpu_percent"),
        "mem_used_percent",
    )
    return asof_join(
        readings,
        clusters,
        ["cluster_id"],
        "start_time",
        "change_time",
        CLUSTER_COLUMNS,
        tie_break=["cluster_name", "node_type_id", "num_workers"],
        slice_seconds=slice_seconds,
    )


def cluster_utilization_by_version(
    node_timeline: DataFrame,
    clusters: DataFrame,
    days: int = 7,
    as_of: datetime | None = None,
    digits: int | None = 2,
    ordered: bool = True,
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """CPU and memory of each cluster under each of its versions, so that a resize shows."""
    keys = ("cluster_id", *CLUSTER_COLUMNS)
    taken = readings_asof_clusters(node_timeline, clusters, days, as_of, slice_seconds)
    per_version = taken.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("data_points"),
        F.countDistinct("instance_id").alias("n_instances"),
        F.expr(f"{rounded('avg(cpu_percent)', digits)} AS avg_cpu_utilization"),
        F.expr(f"{rounded('avg(mem_used_percent)', digits)} AS avg_memory_utilization"),
    )
    order = [F.asc_nulls_first(c) for c in ("cluster_id", "version_time", "cluster_name")]
    return per_version.orderBy(*order) if ordered else per_version
