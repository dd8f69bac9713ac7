"""What runs cost the clusters they ran on: an overlap join of runs with node readings."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.config import Thresholds
from fleetlens.functions import calendar_lookback, descending, rounded
from fleetlens.operators.jobs import JOB_KEYS, RUN_KEYS, _with_names
from fleetlens.operators.timeline import micros

#: Length of the time buckets in which runs and readings meet.
BUCKET_SECONDS = 3600


def _cut(intervals: DataFrame, bucket_seconds: int) -> DataFrame:
    """Pieces of intervals [from, to), cut at the edges of buckets: disjoint, and none is lost."""
    if bucket_seconds < 1:
        raise ValueError(f"a bucket needs a second or more, not {bucket_seconds}")
    size = bucket_seconds * 1_000_000
    buckets = f"sequence(floor(from / {size}D), floor((to - 1) / {size}D))"
    return (
        intervals.filter("to > from")
        .withColumn("bucket", F.explode(F.expr(buckets)))
        .withColumn("piece_from", F.expr(f"greatest(from, bucket * {size})"))
        .withColumn("piece_to", F.expr(f"least(to, (bucket + 1) * {size})"))
    )


def run_usage(
    run_clusters: DataFrame,
    node_timeline: DataFrame,
    days: int = 7,
    as_of: datetime | None = None,
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """Node time, CPU and memory of each run on each cluster it used.

    ``run_clusters`` has the slices of ``job_run_timeline`` with a ``cluster_id``. A run uses
    a cluster from its first start to its last end there; it counts for the nodes' whole load, also where
    other runs share them. A reading counts for the seconds that it overlaps the run, and ``n_readings``
    counts it once. Runs and readings without a cluster, a bound or a duration are left out, and so are runs
    without a reading.

    Both sides are cut at the edges of time buckets and joined on cluster and bucket, so that
    each overlap is found once, long runs included. Readings of one cluster at the same times are summed up
    first: what is joined does not grow with the nodes of a cluster.
    """
    runs = (
        calendar_lookback(run_clusters, "period_start_time", days, as_of)
        .filter("cluster_id IS NOT NULL")
        .groupBy(*RUN_KEYS, "cluster_id")
        .agg(
            F.min(micros("period_start_time")).alias("from"),
            F.max(micros("period_end_time")).alias("to"),
        )
    )
    cpu = "cpu_user_percent + cpu_system_percent"
    # Readings may begin before the look-back and reach into it, a day at most.
    readings = (
        calendar_lookback(node_timeline, "start_time", days + 1, as_of)
        .filter("cluster_id IS NOT NULL")
        .groupBy("cluster_id", micros("start_time").alias("from"), micros("end_time").alias("to"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.expr(f"sum({cpu}) AS cpu"),
            F.expr(f"count({cpu}) AS n_cpu"),
            F.sum("mem_used_percent").alias("mem"),
            F.count("mem_used_percent").alias("n_mem"),
            F.max("mem_used_percent").alias("peak_mem"),
        )
    )
    pieces = _cut(runs, bucket_seconds).withColumnRenamed("from", "run_from").drop("to")
    loads = (
        _cut(readings, bucket_seconds)
        .drop("to")
        .withColumnsRenamed({"piece_from": "load_from", "piece_to": "load_to", "from": "reading_from"})
    )
    both = pieces.join(loads, ["cluster_id", "bucket"]).filter(
        "load_from < piece_to AND piece_from < load_to"
    )
    overlaps = both.selectExpr(
        *RUN_KEYS,
        "cluster_id",
        "least(piece_to, load_to) - greatest(piece_from, load_from) AS micros",
        "IF(greatest(piece_from, load_from) = greatest(run_from, reading_from), n, 0L) AS n",
        "cpu", "n_cpu", "mem", "n_mem", "peak_mem",
    )
    return overlaps.groupBy(*RUN_KEYS, "cluster_id").agg(
        F.sum("n").alias("n_readings"),
        F.expr("sum(micros * n_cpu) AS cpu_node_micros"),
        F.expr("sum(micros * cpu) AS cpu_percent_micros"),
        F.expr("sum(micros * n_mem) AS memory_node_micros"),
        F.expr("sum(micros * mem) AS memory_percent_micros"),
        F.max("peak_mem").alias("peak_memory_percent"),
    )


def job_resource_usage(
    run_clusters: DataFrame,
    node_timeline: DataFrame,
    jobs: DataFrame,
    days: int = 7,
    as_of: datetime | None = None,
    digits: int | None = 2,
    ordered: bool = True,
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """Load of the nodes while a job ran: averages weighted by the time of overlap, and CPU time.

    ``cpu_node_seconds`` is busy node time: a node at 50 % for ten seconds gives five.
    """
    usage = run_usage(run_clusters, node_timeline, days, as_of, bucket_seconds)
    per_run = usage.groupBy(*RUN_KEYS).agg(
        *(F.sum(c).alias(c) for c in usage.columns if c.endswith(("micros", "readings"))),
        F.max("peak_memory_percent").alias("peak_memory_percent"),
    )
    per_job = per_run.groupBy(*JOB_KEYS).agg(
        F.count(F.lit(1)).alias("measured_runs"),
        F.sum("n_readings").alias("n_readings"),
        F.expr("sum(cpu_node_micros) div 1000000 AS node_seconds"),
        F.expr(f"{rounded('sum(cpu_percent_micros) / 1e8', digits)} AS cpu_node_seconds"),
        F.expr(
            f"{rounded('try_divide(sum(cpu_percent_micros), sum(cpu_node_micros))', digits)}"
            " AS avg_cpu_utilization"
        ),
        F.expr(
            f"{rounded('try_divide(sum(memory_percent_micros), sum(memory_node_micros))', digits)}"
            " AS avg_memory_utilization"
        ),
        F.expr(f"{rounded('max(peak_memory_percent)', digits)} AS peak_memory_utilization"),
    )
    named = _with_names(per_job, jobs)
    return named.orderBy(*descending(JOB_KEYS, "cpu_node_seconds")) if ordered else named


def resource_intensive_jobs(usage: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Jobs during whose runs the nodes were, on average, over the CPU or memory limit.

    ``usage`` are unrounded rows of ``job_resource_usage``.
    """
    cpu, memory = (F.nanvl(f"avg_{c}_utilization", F.lit(None)) for c in ("cpu", "memory"))
    return usage.filter((cpu > limits.cpu_percent) | (memory > limits.memory_percent))
