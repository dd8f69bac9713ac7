"""Newest version of each entry of an append-only metadata table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_version(
    df: DataFrame,
    keys: Sequence[str],
    order_by: str = "change_time",
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """One row per key: the newest, ties resolved by the largest ``tie_break``.

    The rank filter becomes a group limit that runs before the shuffle as well,
    so every map task sends at most one version per key, however many a key has.
    """
    newest_first = [F.desc_nulls_last(name) for name in (order_by, *tie_break)]
    ranked = df.withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest_first))
    )
    return ranked.filter(F.col("_rank") == 1).drop("_rank")


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """Newest name per (workspace_id, job_id)."""
    wanted = jobs.select("workspace_id", "job_id", "name", "change_time")
    return latest_version(wanted, ["workspace_id", "job_id"], tie_break=["name"])


def latest_clusters(clusters: DataFrame) -> DataFrame:
    """Newest name, node types and size per cluster."""
    described = ["cluster_name", "driver_node_type_id", "node_type_id", "num_workers"]
    wanted = clusters.select("cluster_id", *described, "change_time")
    return latest_version(wanted, ["cluster_id"], tie_break=described)
