"""Small hand-written input tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from fleetlens.schemas import SCHEMAS

AS_OF = datetime(2024, 1, 15, 13)
DAY = datetime(2024, 1, 14)


def slices(spark, *entries):
    """(job, run, start minute, end minute, state[, workspace]) on the day before AS_OF."""
    made = [
        (
            entry[5] if len(entry) > 5 else "w",
            entry[0],
            entry[1],
            entry[2] if isinstance(entry[2], datetime) else DAY + timedelta(minutes=entry[2]),
            entry[3] if isinstance(entry[3], datetime) else DAY + timedelta(minutes=entry[3]),
            entry[4],
        )
        for entry in entries
    ]
    return spark.createDataFrame(made, SCHEMAS["job_run_timeline"])


def jobs(spark, *entries):
    """(job, name, change_time[, workspace])"""
    made = [(e[3] if len(e) > 3 else "w", e[0], e[1], e[2]) for e in entries]
    return spark.createDataFrame(made, SCHEMAS["jobs"])


def readings(spark, *entries):
    """(cluster, user, system, wait, memory[, driver[, instance[, start]]])"""
    made = []
    for i, entry in enumerate(entries):
        cluster, user, system, wait, memory, *rest = entry
        driver = rest[0] if rest else False
        instance = rest[1] if len(rest) > 1 else "i"
        start = rest[2] if len(rest) > 2 else DAY + timedelta(minutes=i)
        end = start + timedelta(minutes=1)
        made.append(
            (cluster, instance, driver, start, end, user, system, wait, memory, 1048576, None)
        )
    return spark.createDataFrame(made, SCHEMAS["node_timeline"])


def clusters(spark, *entries):
    """(cluster, name, change_time)"""
    made = [(c, name, "UI", changed, "d", "n", 2) for c, name, changed in entries]
    return spark.createDataFrame(made, SCHEMAS["clusters"])


UTILIZATION = (
    "cluster_id STRING, driver BOOLEAN, data_points BIGINT, avg_cpu_utilization DOUBLE, "
    "peak_cpu_utilization DOUBLE, avg_cpu_wait DOUBLE, avg_memory_utilization DOUBLE, "
    "peak_memory_utilization DOUBLE"
)


def utilization(spark, *entries):
    """(cluster, cpu, memory, wait[, points[, driver]])"""
    made = [
        (
            e[0],
            e[5] if len(e) > 5 else False,
            e[4] if len(e) > 4 else 10,
            e[1],
            e[1],
            e[3],
            e[2],
            e[2],
        )
        for e in entries
    ]
    return spark.createDataFrame(made, UTILIZATION)


def empty(spark, *names):
    """Typed tables without rows."""
    return {name: spark.createDataFrame([], SCHEMAS[name]) for name in names}
