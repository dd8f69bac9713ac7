"""Quantiles, short lists and row counts over result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.config import TOP_CONSUMER_ROWS
from fleetlens.functions import descending, stable_round

# The fractions of the standard quantile tables.
STANDARD_FRACTIONS = (0.5, 0.9, 0.95, 0.99)
REPORT_FRACTIONS = (0.5, 0.75, 0.9, 0.95)


# Number of the range that a value lies in, in the order of values: 256 ranges
# between a number and its double, NaN last. Logarithms keep the order.
VALUE_RANGE = """CASE
    WHEN isnan(value) THEN 1000000
    WHEN abs(value) = double('infinity') THEN 999999 * CAST(sign(value) AS INT)
    WHEN value = 0 THEN 0
    ELSE CAST(sign(value) AS INT) * (300000 + CAST(floor(log2(abs(value)) * 256) AS INT)) END"""


def _label(fraction: float) -> str:
    return f"p{round(fraction * 100)}"


def quantiles(
    df: DataFrame,
    columns: Mapping[str, str],
    fractions: Sequence[float] = STANDARD_FRACTIONS,
    digits: int | None = None,
) -> DataFrame:
    """Exact interpolated quantiles, nulls left out: one row per column.

    ``columns`` maps a label to a column. Equal values are counted first, in
    parallel. The counts then go to narrow value ranges, whose totals tell which
    ranges hold the wanted ranks; only those are sorted, each by one task. A range is
    1/256 of an octave, so that values closer together than 0.27 % share it.
    """
    values = F.array(
        *[
            F.struct(F.lit(label).alias("metric"), F.col(name).cast("double").alias("value"))
            for label, name in columns.items()
        ]
    )
    counted = (
        df.select(F.inline(values))
        .filter(F.col("value").isNotNull())
        .groupBy("metric", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranged = counted.withColumn("range", F.expr(VALUE_RANGE))
    by_metric = Window.partitionBy("metric")
    up_to = by_metric.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = (
        ranged.groupBy("metric", "range")
        .agg(F.sum("n").alias("n_range"))
        .withColumn("behind", F.sum("n_range").over(up_to))
        .withColumn("total", F.sum("n_range").over(by_metric))
    )
    # Ranks count from 0; a value holds those from last - n + 1 to last.
    wanted = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                F.lit(float(fraction)).alias("fraction"),
                (F.lit(float(fraction)) * (F.col("total") - 1)).alias("place"),
            )
            for i, fraction in enumerate(fractions)
        ]
    )
    touched = (F.col("first") <= F.ceil("place")) & (F.floor("place") <= F.col("last"))
    ranges = (
        totals.select(
            "metric",
            "range",
            (F.col("behind") - F.col("n_range")).alias("first"),
            (F.col("behind") - 1).alias("last"),
            F.inline(wanted),
        )
        .filter(touched)
        .select("metric", "range", "i", "place", F.col("first").alias("before"))
    )
    in_range = Window.partitionBy("metric", "range").orderBy("value")
    needed = ranged.join(ranges.select("metric", "range").distinct(), ["metric", "range"], "left_semi")
    ranked = needed.withColumn("upto", F.sum("n").over(in_range)).join(ranges, ["metric", "range"])
    hits = ranked.select(
        "metric",
        "value",
        "i",
        "place",
        (F.col("before") + F.col("upto") - F.col("n")).alias("first"),
        (F.col("before") + F.col("upto") - 1).alias("last"),
    ).filter(touched)
    ends = hits.groupBy("metric", "i").agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.first("place").alias("place")
    )
    step = F.col("place") - F.floor("place")
    exact = ends.withColumn("q", F.col("low") + (F.col("high") - F.col("low")) * step)
    return exact.groupBy("metric").agg(
        *[
            stable_round(F.max(F.when(F.col("i") == i, F.col("q"))), digits).alias(_label(fraction))
            for i, fraction in enumerate(fractions)
        ]
    )


def top_cpu(utilization: DataFrame, limit: int = TOP_CONSUMER_ROWS) -> DataFrame:
    """Groups with the highest average CPU."""
    return _top(
        utilization,
        limit,
        "avg_cpu_utilization",
        "peak_cpu_utilization",
        "avg_memory_utilization",
    )


def top_memory(utilization: DataFrame, limit: int = TOP_CONSUMER_ROWS) -> DataFrame:
    """Groups with the highest average memory."""
    return _top(
        utilization,
        limit,
        "avg_memory_utilization",
        "peak_memory_utilization",
        "avg_cpu_utilization",
    )


def _top(utilization: DataFrame, limit: int, first: str, *others: str) -> DataFrame:
    shown = utilization.select("cluster_id", "driver", first, *others)
    return shown.orderBy(*descending(("cluster_id", "driver"), first)).limit(limit)


def present_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns the table has, in the wanted order."""
    return df.select(*[name for name in wanted if name in df.columns])


def metrics_summary(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per table of a bundle, and ``total_records`` over all."""
    counts = reduce(
        DataFrame.unionByName,
        [
            df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
            for name, df in frames.items()
        ],
    )
    return counts.rollup("table_name").agg(F.sum("n").alias("n_records")).select(
        F.coalesce("table_name", F.lit("total_records")).alias("table_name"), "n_records"
    )
