"""Metric bundles: the tables of one report, from as few scans as possible.

Each bundle rests on one aggregate that several of its tables share. A caller
that uses more than one of them passes the aggregate in staged form.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from fleetlens.config import Thresholds
from fleetlens.functions import checked_days
from fleetlens.operators import clusters, jobs, nodes
from fleetlens.sources.tables import Tables


def job_bundle(
    tables: Tables,
    days: int = 7,
    as_of: datetime | None = None,
    health: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Runtime, failures and node utilisation for one look-back.

    Runtime and failures are views of ``jobs.job_health``, one pass over the slices.
    """
    if health is None:
        health = jobs.job_health(tables.job_run_timeline, tables.jobs, days, as_of)
    return {
        "runtime_metrics": jobs.runtime_view(health),
        "failure_analysis": jobs.failure_view(health),
        "cluster_utilization": nodes.cluster_utilization_top(tables.node_timeline, days, as_of),
    }


def cluster_bundle(
    tables: Tables,
    days: int = 7,
    as_of: datetime | None = None,
    rollup: DataFrame | None = None,
    limits: Thresholds = Thresholds(),
) -> dict[str, DataFrame]:
    """Instance utilisation, node types, efficiency and costs for one look-back.

    Utilisation and efficiency come from ``nodes.node_rollup`` per instance.
    """
    checked_days(days)
    if rollup is None:
        rollup = nodes.node_rollup(tables.node_timeline, days, as_of, limits=limits)
    return {
        "cluster_utilization": nodes.instance_view(rollup, tables.clusters),
        "node_types": clusters.node_types(tables.node_types),
        "efficiency_metrics": nodes.efficiency_view(
            nodes.regroup(rollup, ["cluster_id"]), limits=limits
        ),
        "cost_analysis": clusters.cluster_costs(
            tables.billing_usage, tables.clusters, days, as_of
        ),
    }
