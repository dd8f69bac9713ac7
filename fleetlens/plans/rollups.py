"""Daily partials of the node readings: kept, refreshed and expired by day, and merged on demand."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.config import TOP_UTILIZATION_ROWS, RefreshSettings, Thresholds
from fleetlens.functions import calendar_lookback
from fleetlens.functions.time import checked_days, clock
from fleetlens.operators.nodes import (
    INSTANCE_KEYS,
    NODE_KEYS,
    SKIP_FIGURES,
    ZERO_FIGURES,
    NullPolicy,
    by_cpu,
    efficiency_view,
    partials,
    readings,
    regroup,
    utilization_view,
)

DAY = "day"
POLICIES: tuple[NullPolicy, ...] = ("skip", "zero")
RETENTION_DAYS = RefreshSettings().retention_days


def daily_partials(timeline: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Mergeable aggregates per day, null policy and instance. Readings without a start have no day."""
    parts = []
    for policy in POLICIES:
        dated = readings(
            timeline, policy, *INSTANCE_KEYS, "start_time", "end_time", f"CAST(start_time AS DATE) AS {DAY}"
        )
        part = dated.groupBy(DAY, *INSTANCE_KEYS).agg(*partials(limits))
        parts.append(part.withColumn("null_policy", F.lit(policy)))
    return reduce(DataFrame.unionByName, parts).filter(F.col(DAY).isNotNull())


def stored_days(spark: SparkSession, path: str) -> list[date]:
    """The days at a path, as the names of its folders."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    found = [re.fullmatch(rf"{DAY}=(\d{{4}}-\d\d-\d\d)", name) for name in names]
    return sorted(date.fromisoformat(m[1]) for m in found if m)


def touched(timeline: DataFrame, first: date, as_of: datetime) -> DataFrame:
    """Readings from a day on up to the day of ``as_of``, both whole. The bounds reach the scan."""
    since = calendar_lookback(timeline, "start_time", (as_of.date() - first).days, as_of)
    return since.filter(F.col("start_time") < F.date_add(clock(as_of), 1))


def refresh(
    timeline: DataFrame,
    path: str,
    as_of: datetime,
    retention_days: int = RETENTION_DAYS,
    late_days: int = 1,
    limits: Thresholds = Thresholds(),
) -> tuple[date, date]:
    """Bring the daily partials at a path up to the day of ``as_of``; the first and last day written.

    Only days from ``late_days`` before the newest stored one on are read and written anew, each as a
    whole, so that a run that failed or is repeated changes nothing else. Readings that come later than
    ``late_days`` are seen by a refresh with a larger one. The first refresh goes back ``retention_days``; days
    older than that are deleted. The table is taken to be append-only: a day with readings keeps some.
    """
    spark = timeline.sparkSession
    checked_days(retention_days)
    if late_days < 0:
        raise ValueError(f"late days must not be negative, not {late_days}")
    last = as_of.date()
    oldest = last - timedelta(days=retention_days)
    days = [day for day in stored_days(spark, path) if day <= last]
    first = max(oldest, days[-1] - timedelta(days=late_days)) if days else oldest
    (
        daily_partials(touched(timeline, first, as_of), limits)
        .hint("rebalance", DAY)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(DAY)
        .parquet(path)
    )
    expire(spark, path, oldest)
    return first, last


def expire(spark: SparkSession, path: str, oldest: date) -> list[date]:
    """Delete the days before ``oldest``; the days deleted."""
    gone = [day for day in stored_days(spark, path) if day < oldest]
    for day in gone:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{DAY}={day.isoformat()}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return gone


def merged(
    daily: DataFrame,
    days: int,
    as_of: datetime | None = None,
    null_policy: NullPolicy = "skip",
    by: tuple[str, ...] = NODE_KEYS,
    retention_days: int = RETENTION_DAYS,
) -> DataFrame:
    """A roll-up of a calendar look-back from daily partials; it reads the folders of its days only.

    A look-back beyond what is retained raises, as its first days may be gone.
    """
    if checked_days(days) > retention_days:
        raise ValueError(f"only {retention_days} days are retained, not {days}")
    recent = daily.filter(F.col(DAY) >= F.date_sub(clock(as_of), days))
    return regroup(recent.filter(F.col("null_policy") == null_policy), by)


def utilization_top(
    daily: DataFrame,
    days: int = 1,
    as_of: datetime | None = None,
    min_points: int = 6,
    limit: int | None = TOP_UTILIZATION_ROWS,
    retention_days: int = RETENTION_DAYS,
) -> DataFrame:
    """``nodes.cluster_utilization_top`` from daily partials."""
    rollup = merged(daily, days, as_of, "skip", NODE_KEYS, retention_days)
    busiest = by_cpu(utilization_view(rollup, SKIP_FIGURES, min_points), *NODE_KEYS)
    return busiest if limit is None else busiest.limit(limit)


def utilization(
    daily: DataFrame,
    days: int = 7,
    as_of: datetime | None = None,
    min_points: int = 5,
    ordered: bool = True,
    retention_days: int = RETENTION_DAYS,
) -> DataFrame:
    """``nodes.cluster_utilization`` from daily partials."""
    rollup = merged(daily, days, as_of, "zero", NODE_KEYS, retention_days)
    view = utilization_view(rollup, ZERO_FIGURES, min_points)
    return by_cpu(view, *NODE_KEYS) if ordered else view


def efficiency(
    daily: DataFrame,
    days: int = 7,
    as_of: datetime | None = None,
    digits: int | None = None,
    limits: Thresholds = Thresholds(),
    ordered: bool = True,
    retention_days: int = RETENTION_DAYS,
) -> DataFrame:
    """``nodes.cluster_efficiency`` from daily partials, which must be of the same limits."""
    rollup = merged(daily, days, as_of, "skip", ("cluster_id",), retention_days)
    return efficiency_view(rollup, digits, limits, ordered)
