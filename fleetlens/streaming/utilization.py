"""Incremental node utilisation and alerts over the append-only timeline.

The operators take streaming and batch frames alike. State is one row of sums
and counts per open window and group, and readings merge into it before the
shuffle; the watermark closes windows and drops later readings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fleetlens.config import RefreshSettings, Thresholds
from fleetlens.operators.advise import row_issues
from fleetlens.operators.nodes import NODE_KEYS, ZERO_FIGURES, partials, readings, show
from fleetlens.schemas import SCHEMAS

# Date of the window, by which output is partitioned, and the tasks that write a trigger's.
DATE_COLUMN = "window_date"
FILES_PER_TRIGGER = 8

REFRESH = f"{RefreshSettings().refresh_interval_minutes} minutes"


def read_timeline(
    spark: SparkSession,
    path: str,
    schema: T.StructType = SCHEMAS["node_timeline"],
    max_files_per_trigger: int | None = None,
    glob: str | None = None,
) -> DataFrame:
    """A Parquet folder as a stream of new files."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def windowed_utilization(
    timeline: DataFrame,
    window: str = REFRESH,
    lateness: str = REFRESH,
    min_points: int = 1,
) -> DataFrame:
    """Utilisation per tumbling window, cluster and driver; missing readings count as 0."""
    # Watermarks need a timestamp with time zone.
    instants = timeline.withColumn("start_time", F.col("start_time").cast("timestamp"))
    grouped = (
        readings(instants, "zero", *NODE_KEYS, "start_time", "end_time")
        .withWatermark("start_time", lateness)
        .groupBy(F.window("start_time", window).alias("window"), *NODE_KEYS)
        .agg(*partials())
    )
    return grouped.filter(F.col("points") >= min_points).selectExpr(
        "window.start AS window_start",
        "window.end AS window_end",
        *NODE_KEYS,
        "points AS data_points",
        *show(ZERO_FIGURES, 2),
    )


def windowed_issues(windows: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Issues of each closed window."""
    return row_issues(windows, "window_start", "window_end", limits=limits)


def _writer(stream: DataFrame, path: str, checkpoint: str, files_per_trigger: int):
    """Append to folders per window date, with a bounded number of files per trigger and date.

    Adaptive execution does not coalesce a stateful query, whose closed windows would
    else end up in a file per state partition. Nearly all rows of a trigger have one date, so
    they are spread by cluster as well.
    """
    dated = stream.withColumn(DATE_COLUMN, F.to_date("window_start"))
    return (
        dated.repartition(files_per_trigger, DATE_COLUMN, "cluster_id")
        .writeStream.format("parquet")
        .outputMode("append")
        .partitionBy(DATE_COLUMN)
        .option("checkpointLocation", checkpoint)
        .option("path", path)
    )


def run_available(
    stream: DataFrame, path: str, checkpoint: str, files_per_trigger: int = FILES_PER_TRIGGER
) -> None:
    """Process everything that has arrived since the last run, then stop."""
    writer = _writer(stream, path, checkpoint, files_per_trigger)
    writer.trigger(availableNow=True).start().awaitTermination()


def start_periodic(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    interval: str = REFRESH,
    files_per_trigger: int = FILES_PER_TRIGGER,
) -> StreamingQuery:
    """Keep processing at a fixed interval."""
    writer = _writer(stream, path, checkpoint, files_per_trigger)
    return writer.trigger(processingTime=interval).start()
