"""Node utilisation at any grain.

Each figure is derived from sums, counts and extremes that merge: readings can
be grouped directly, or a stored roll-up per instance can be grouped further.
Both ways aggregate before the shuffle, so a cluster with most of the readings
costs no more than its number of groups.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import wording
from fleetlens.config import TOP_UTILIZATION_ROWS, Thresholds
from fleetlens.functions import calendar_lookback, descending, percent, rounded
from fleetlens.functions.numbers import BYTES_PER_MB
from fleetlens.operators.versions import latest_clusters

NullPolicy = Literal["skip", "zero"]
NODE_KEYS = ("cluster_id", "driver")
INSTANCE_KEYS = (*NODE_KEYS, "instance_id")
METRICS = ("cpu", "wait", "memory", "received", "sent")


def readings(timeline: DataFrame, null_policy: NullPolicy = "skip", *extra: str) -> DataFrame:
    """One row per reading with the five metrics the figures are built on.

    ``skip`` leaves a missing reading out of averages, and a CPU reading is
    missing if either half is; ``zero`` counts every missing part as 0.
    """

    def value(name: str) -> str:
        number = f"CAST({name} AS DOUBLE)"
        return f"coalesce({number}, 0.0D)" if null_policy == "zero" else number

    return timeline.selectExpr(
        *extra,
        f"{value('cpu_user_percent')} + {value('cpu_system_percent')} AS cpu",
        f"{value('cpu_wait_percent')} AS wait",
        f"{value('mem_used_percent')} AS memory",
        f"{value('network_received_bytes')} AS received",
        f"{value('network_sent_bytes')} AS sent",
    )


def _aggregates(parts: dict[str, str]) -> list[Column]:
    return [F.expr(f"{sql} AS {name}") for name, sql in parts.items()]


def partials(limits: Thresholds = Thresholds()) -> list[Column]:
    """Mergeable aggregates of readings. Those no figure uses are pruned by Spark."""
    parts = {"points": "count(1)"}
    for name in METRICS:
        parts |= {f"{name}_{part}": f"{part}({name})" for part in ("sum", "count", "min", "max")}
    return _aggregates(
        parts
        | {
            "low_cpu_count": f"count_if(cpu < {limits.low_cpu_reading}D)",
            "low_memory_count": f"count_if(memory < {limits.low_memory_reading}D)",
            "first_start": "min(start_time)",
            "last_end": "max(end_time)",
        }
    )


def merged_partials() -> list[Column]:
    """The aggregates that merge ``partials`` of finer groups."""
    how = {"points": "sum", "low_cpu_count": "sum", "low_memory_count": "sum"}
    for name in METRICS:
        how |= {f"{name}_sum": "sum", f"{name}_count": "sum"}
        how |= {f"{name}_min": "min", f"{name}_max": "max"}
    how |= {"first_start": "min", "last_end": "max"}
    return _aggregates({name: f"{function}({name})" for name, function in how.items()})


def _mean(metric: str) -> str:
    return f"try_divide({metric}_sum, {metric}_count)"


#: Every figure over the partial aggregates, under its public name.
FIGURES = {
    "avg_cpu_utilization": _mean("cpu"),
    "peak_cpu_utilization": "cpu_max",
    "min_cpu_utilization": "cpu_min",
    "avg_cpu_wait": _mean("wait"),
    "max_cpu_wait": "wait_max",
    "avg_memory_utilization": _mean("memory"),
    "max_memory_utilization": "memory_max",
    "peak_memory_utilization": "memory_max",
    "min_memory_utilization": "memory_min",
    "avg_network_mb_received_per_minute": f"{_mean('received')} / {BYTES_PER_MB}",
    "avg_network_mb_sent_per_minute": f"{_mean('sent')} / {BYTES_PER_MB}",
}

NETWORK_FIGURES = ("avg_network_mb_received_per_minute", "avg_network_mb_sent_per_minute")
SKIP_FIGURES = (
    "avg_cpu_utilization",
    "peak_cpu_utilization",
    "avg_cpu_wait",
    "max_cpu_wait",
    "avg_memory_utilization",
    "max_memory_utilization",
    *NETWORK_FIGURES,
)
ZERO_FIGURES = (
    "avg_cpu_utilization",
    "peak_cpu_utilization",
    "avg_cpu_wait",
    "avg_memory_utilization",
    "peak_memory_utilization",
    *NETWORK_FIGURES,
)
INSTANCE_FIGURES = (
    "avg_cpu_utilization",
    "peak_cpu_utilization",
    "min_cpu_utilization",
    "avg_cpu_wait",
    "max_cpu_wait",
    "avg_memory_utilization",
    "peak_memory_utilization",
    "min_memory_utilization",
    *NETWORK_FIGURES,
)


def show(names: Sequence[str], digits: int | None) -> list[str]:
    """SQL of the named figures over partial aggregates."""
    return [f"{rounded(FIGURES[name], digits)} AS {name}" for name in names]


def by_cpu(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*descending(keys, "avg_cpu_utilization"))


def _windowed(
    timeline: DataFrame, days: int, as_of: datetime | None, null_policy: NullPolicy, *keys: str
) -> DataFrame:
    recent = calendar_lookback(timeline, "start_time", days, as_of)
    return readings(recent, null_policy, *keys, "start_time", "end_time")


def node_rollup(
    timeline: DataFrame,
    days: int = 7,
    as_of: datetime | None = None,
    null_policy: NullPolicy = "skip",
    by: Sequence[str] = INSTANCE_KEYS,
    limits: Thresholds = Thresholds(),
) -> DataFrame:
    """Partial aggregates of the look-back window per group."""
    return _windowed(timeline, days, as_of, null_policy, *by).groupBy(*by).agg(*partials(limits))


def regroup(rollup: DataFrame, by: Sequence[str]) -> DataFrame:
    """Merge a roll-up to coarser groups."""
    return rollup.groupBy(*by).agg(*merged_partials())


def utilization_view(
    rollup: DataFrame,
    names: Sequence[str],
    min_points: int = 0,
    digits: int | None = 2,
    count_as: str | None = "data_points",
) -> DataFrame:
    """Figures per (cluster_id, driver) of a roll-up at that grain."""
    enough = rollup.filter(F.col("points") >= min_points) if min_points else rollup
    count = [] if count_as is None else [f"points AS {count_as}"]
    return enough.selectExpr(*NODE_KEYS, *count, *show(names, digits))


def cluster_utilization_top(
    timeline: DataFrame,
    days: int = 1,
    as_of: datetime | None = None,
    min_points: int = 6,
    limit: int | None = TOP_UTILIZATION_ROWS,
) -> DataFrame:
    """The busiest (cluster, driver) groups, or all; missing readings are skipped."""
    rollup = node_rollup(timeline, days, as_of, by=NODE_KEYS)
    view = utilization_view(rollup, SKIP_FIGURES, min_points)
    busiest = by_cpu(view, *NODE_KEYS)
    return busiest if limit is None else busiest.limit(limit)


def cluster_utilization(
    timeline: DataFrame,
    days: int = 7,
    as_of: datetime | None = None,
    min_points: int = 5,
    ordered: bool = True,
) -> DataFrame:
    """All (cluster, driver) groups; missing readings count as 0."""
    rollup = node_rollup(timeline, days, as_of, "zero", by=NODE_KEYS)
    view = utilization_view(rollup, ZERO_FIGURES, min_points)
    return by_cpu(view, *NODE_KEYS) if ordered else view


def cluster_utilization_raw(
    timeline: DataFrame,
    days: int = 1,
    as_of: datetime | None = None,
    digits: int | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Unrounded figures of all (cluster, driver) groups, however few their readings."""
    rollup = node_rollup(timeline, days, as_of, by=NODE_KEYS)
    view = utilization_view(rollup, SKIP_FIGURES, digits=digits, count_as=None)
    return by_cpu(view, *NODE_KEYS) if ordered else view


def instance_view(
    rollup: DataFrame, clusters: DataFrame, digits: int | None = None, ordered: bool = True
) -> DataFrame:
    """Figures per instance with the newest description of its cluster."""
    described = latest_clusters(clusters).select(
        "cluster_id", "cluster_name", "driver_node_type_id", "node_type_id"
    )
    view = rollup.join(described, "cluster_id", "left").selectExpr(
        "cluster_id",
        "cluster_name",
        "driver_node_type_id",
        "node_type_id",
        "driver",
        "instance_id",
        *show(INSTANCE_FIGURES, digits),
        "points AS measurement_count",
        "first_start AS monitoring_start",
        "last_end AS monitoring_end",
    )
    return by_cpu(view, *INSTANCE_KEYS) if ordered else view


def cluster_instance_utilization(
    timeline: DataFrame,
    clusters: DataFrame,
    days: int = 7,
    as_of: datetime | None = None,
    digits: int | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Figures per instance. Readings are aggregated before the descriptions are joined."""
    return instance_view(node_rollup(timeline, days, as_of), clusters, digits, ordered)


def efficiency_view(
    rollup: DataFrame,
    digits: int | None = None,
    limits: Thresholds = Thresholds(),
    ordered: bool = True,
) -> DataFrame:
    """Efficiency category per cluster of a roll-up at cluster grain."""
    cpu, memory = _mean("cpu"), _mean("memory")
    view = rollup.selectExpr(
        "cluster_id",
        *show(["avg_cpu_utilization", "avg_memory_utilization"], digits),
        "points AS total_measurements",
        "low_cpu_count",
        "low_memory_count",
        f"{percent('low_cpu_count', 'points')} AS low_cpu_percent",
        f"{percent('low_memory_count', 'points')} AS low_memory_percent",
        f"""CASE
            WHEN {cpu} < {limits.efficient_cpu_floor}D
                 AND {memory} < {limits.efficient_memory_floor}D
            THEN '{wording.CATEGORY_LOW}'
            WHEN {cpu} > {limits.efficient_cpu_ceiling}D
                 OR {memory} > {limits.efficient_memory_ceiling}D
            THEN '{wording.CATEGORY_HIGH}'
            ELSE '{wording.CATEGORY_NORMAL}' END AS efficiency_category""",
    )
    return by_cpu(view, "cluster_id") if ordered else view


def cluster_efficiency(
    timeline: DataFrame,
    days: int = 7,
    as_of: datetime | None = None,
    digits: int | None = None,
    limits: Thresholds = Thresholds(),
    ordered: bool = True,
) -> DataFrame:
    """Averages, shares of low readings and efficiency category per cluster."""
    rollup = node_rollup(timeline, days, as_of, by=["cluster_id"], limits=limits)
    return efficiency_view(rollup, digits, limits, ordered)
