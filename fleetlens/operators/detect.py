"""Threshold anomalies of jobs and clusters.

Each kind is a condition on a metric table and the columns it reports. Null and
NaN pass no condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import wording
from fleetlens.config import Thresholds
from fleetlens.functions import minutes, stable_round


def _number(name: str) -> Column:
    # Spark ranks NaN above all numbers.
    return F.nanvl(name, F.lit(None))


def runs_long(limits: Thresholds) -> Column:
    return _number("avg_duration_seconds") > limits.job_duration_minutes * 60


def fails_often(limits: Thresholds) -> Column:
    return _number("failure_rate_percent") > limits.failure_rate * 100


def is_idle(limits: Thresholds) -> Column:
    return (_number("avg_cpu_utilization") < limits.underutilized_cpu) & (
        _number("avg_memory_utilization") < limits.underutilized_memory
    )


def is_overloaded(limits: Thresholds) -> Column:
    return (_number("avg_cpu_utilization") > limits.overutilized_cpu) | (
        _number("avg_memory_utilization") > limits.overutilized_memory
    )


def long_running_jobs(runtime: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Jobs whose average run takes too long."""
    return runtime.filter(runs_long(limits)).select(
        "job_id",
        "job_name",
        minutes(F.col("avg_duration_seconds")).alias("avg_duration_minutes"),
        minutes(F.col("max_duration_seconds")).alias("max_duration_minutes"),
    )


def high_failure_rates(failures: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Jobs of which too many runs fail."""
    return failures.filter(fails_often(limits)).select(
        "job_id", "job_name", "failure_rate_percent", "failed_runs", "total_runs"
    )


def _cluster_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "cluster_id",
        "cluster_name",
        stable_round(F.col("avg_cpu_utilization")).alias("avg_cpu_utilization"),
        stable_round(F.col("avg_memory_utilization")).alias("avg_memory_utilization"),
    )


def underutilized_clusters(instances: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Instances with low CPU and low memory; a cluster appears once per instance."""
    return _cluster_columns(instances.filter(is_idle(limits)))


def overutilized_clusters(instances: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Instances with high CPU or high memory."""
    return _cluster_columns(instances.filter(is_overloaded(limits)))


def inefficient_clusters(efficiency: DataFrame) -> DataFrame:
    """Clusters of the lowest efficiency category."""
    return efficiency.filter(F.col("efficiency_category") == wording.CATEGORY_LOW).select(
        "cluster_id",
        stable_round(F.col("avg_cpu_utilization")).alias("avg_cpu_utilization"),
        "low_cpu_percent",
        "low_memory_percent",
    )


def _hits(
    df: DataFrame, kinds: dict[str, Column], columns: dict[str, tuple[Column, str, tuple]]
) -> DataFrame:
    """A row for each kind whose condition a row meets, from one pass.

    ``columns`` gives a figure, its type and the kinds that report it; others get null.
    """
    structs = [
        F.when(
            condition,
            F.struct(
                F.lit(kind).alias("kind"),
                *(
                    (value if kind in of else F.lit(None).cast(value_type)).alias(name)
                    for name, (value, value_type, of) in columns.items()
                ),
            ),
        )
        for kind, condition in kinds.items()
    ]
    return df.select(F.inline(F.array_compact(F.array(*structs))))


def job_anomalies(health: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """All anomalies of ``jobs.job_health`` as one table with a ``kind``.

    Columns of the other kind are null. Both rules look at the same row, so the
    health of jobs is computed once.
    """
    long, failing = wording.LONG_RUNNING_JOBS, wording.HIGH_FAILURE_RATES
    both = (long, failing)
    types = dict(health.dtypes)
    return _hits(
        health,
        {long: runs_long(limits), failing: (F.col("finished_runs") > 0) & fails_often(limits)},
        {
            "job_id": (F.col("job_id"), types["job_id"], both),
            "job_name": (F.col("job_name"), "string", both),
            "avg_duration_minutes": (minutes(F.col("avg_duration_seconds")), "double", (long,)),
            "max_duration_minutes": (minutes(F.col("max_duration_seconds")), "double", (long,)),
            "failure_rate_percent": (F.col("failure_rate_percent"), "double", (failing,)),
            "failed_runs": (F.col("failed_runs"), "bigint", (failing,)),
            "total_runs": (F.col("finished_runs"), "bigint", (failing,)),
        },
    )


def cluster_anomalies(
    instances: DataFrame, efficiency: DataFrame, limits: Thresholds = Thresholds()
) -> DataFrame:
    """All cluster anomalies as one table with a ``kind``; instances are read once."""
    idle, overloaded = wording.UNDERUTILIZED_CLUSTERS, wording.OVERUTILIZED_CLUSTERS
    both = (idle, overloaded)
    types = dict(instances.dtypes)
    of_instances = _hits(
        instances,
        {idle: is_idle(limits), overloaded: is_overloaded(limits)},
        {
            "cluster_id": (F.col("cluster_id"), types["cluster_id"], both),
            "cluster_name": (F.col("cluster_name"), "string", both),
            **{
                name: (stable_round(F.col(name)), "double", both)
                for name in ("avg_cpu_utilization", "avg_memory_utilization")
            },
        },
    )
    of_clusters = inefficient_clusters(efficiency).select(
        F.lit(wording.INEFFICIENT_CLUSTERS).alias("kind"), "*"
    )
    return of_instances.unionByName(of_clusters, allowMissingColumns=True)
