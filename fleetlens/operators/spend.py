"""The few clusters that make up most of the usage: a prefix sum over a global order."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import calendar_lookback, rounded
from fleetlens.operators.versions import latest_clusters

#: Ranges of values between a number and its double. Clusters of one range are sorted together.
RANGES_PER_OCTAVE = 64


def ranked_shares(amounts: DataFrame, group: str, key: str, amount: str) -> DataFrame:
    """Add ``place``, ``running`` and ``total``: amounts of a group summed up from the largest down.

    Keys are unique in a group, and amounts are decimals above 0. Ties go by key. Amounts are dealt to narrow
    ranges; the totals of the ranges, a bounded number, are summed up first, and only the keys
    of a range are sorted together. So no task sorts a group.
    """
    ranged = amounts.withColumn(
        "_range", F.expr(f"CAST(floor(-log2(CAST({amount} AS DOUBLE)) * {RANGES_PER_OCTAVE}) AS INT)")
    )
    by_range = Window.partitionBy("_group").orderBy("_of")
    totals = ranged.groupBy(F.col(group).alias("_group"), F.col("_range").alias("_of")).agg(
        F.sum(amount).alias("_sum_of"), F.count(F.lit(1)).alias("_n_of")
    )
    starts = totals.select(
        "_group",
        "_of",
        (F.sum("_sum_of").over(by_range) - F.col("_sum_of")).alias("_sum_before"),
        (F.sum("_n_of").over(by_range) - F.col("_n_of")).alias("_n_before"),
        F.sum("_sum_of").over(Window.partitionBy("_group")).alias("total"),
    )
    inside = Window.partitionBy(group, "_range").orderBy(F.desc(amount), key)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumn("_sum", F.sum(amount).over(so_far)).withColumn("_n", F.row_number().over(inside))
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_of"))
    return placed.join(starts, same).select(
        *amounts.columns,
        F.expr("_n_before + _n AS place"),
        F.expr("_sum_before + _sum AS running"),
        "total",
    )


def expensive_clusters(
    usage: DataFrame,
    clusters: DataFrame,
    days: int = 7,
    as_of: datetime | None = None,
    share_percent: float = 80,
    digits: int | None = 2,
) -> DataFrame:
    """The clusters with the most usage that together make up ``share_percent`` of it.

    Units are not added up: each has a list of its own. A cluster is on it as long as those before
    it do not reach the share. Usage without a cluster, and clusters whose usage is not above 0, are left out.
    """
    recent = calendar_lookback(usage, "usage_date", days, as_of)
    per_cluster = (
        recent.groupBy("usage_unit", F.col("usage_metadata")["cluster_id"].alias("cluster_id"))
        .agg(F.sum("usage_quantity").alias("total_usage"))
        .filter("cluster_id IS NOT NULL AND total_usage > 0")
    )
    shares = ranked_shares(per_cluster, "usage_unit", "cluster_id", "total_usage")
    top = shares.filter(f"(running - total_usage) * 100 < total * {share_percent}BD").select(
        "usage_unit",
        "cluster_id",
        F.col("place").cast("bigint").alias("place"),
        "total_usage",
        F.expr(f"{rounded('total_usage * 100.0D / total', digits)} AS share_percent"),
        F.expr(f"{rounded('running * 100.0D / total', digits)} AS running_percent"),
    )
    names = latest_clusters(clusters).select("cluster_id", "cluster_name")
    return top.join(names, "cluster_id", "left").select(
        "usage_unit", "place", "cluster_id", "cluster_name", "total_usage", "share_percent", "running_percent"
    )
