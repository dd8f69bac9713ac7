"""Cluster metadata, the node type catalogue and usage per cluster."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import calendar_lookback, descending
from fleetlens.operators.versions import latest_clusters


def cluster_basic_info(
    clusters: DataFrame, days: int = 30, as_of: datetime | None = None, ordered: bool = True
) -> DataFrame:
    """Every distinct recent version of every cluster, newest first."""
    columns = ["cluster_id", "cluster_name", "cluster_source", "change_time"]
    recent = calendar_lookback(clusters, "change_time", days, as_of).select(*columns).distinct()
    if not ordered:
        return recent
    return recent.orderBy(*descending(columns[:-1], "change_time"))


def node_types(catalogue: DataFrame, ordered: bool = True) -> DataFrame:
    """Node types by size."""
    view = catalogue.select(
        F.col("node_type").alias("node_type_id"),
        "memory_mb",
        F.col("core_count").alias("num_cores"),
        F.col("gpu_count").alias("num_gpus"),
    )
    return view.orderBy("num_cores", "memory_mb", "node_type_id") if ordered else view


def cluster_costs(
    billing_usage: DataFrame,
    clusters: DataFrame,
    days: int = 7,
    as_of: datetime | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Usage per cluster, SKU and unit with the newest description of the cluster.

    ``usage_metadata`` may be a struct or a map.
    """
    cluster_id = F.col("usage_metadata")["cluster_id"]
    usage = (
        calendar_lookback(billing_usage, "usage_date", days, as_of)
        .filter(cluster_id.isNotNull())
        .groupBy(cluster_id.alias("cluster_id"), "sku_name", "usage_unit")
        .agg(
            F.sum("usage_quantity").alias("total_usage"),
            F.count(F.lit(1)).alias("usage_records"),
        )
    )
    view = usage.join(latest_clusters(clusters), "cluster_id", "left").select(
        "cluster_id",
        "cluster_name",
        "sku_name",
        "usage_unit",
        "total_usage",
        "usage_records",
        "driver_node_type_id",
        "node_type_id",
        "num_workers",
    )
    keys = ["cluster_id", "sku_name", "usage_unit"]
    return view.orderBy(*descending(keys, "total_usage")) if ordered else view
