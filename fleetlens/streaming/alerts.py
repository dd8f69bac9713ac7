"""Alerts with memory: one row when a group goes over a limit for good, and one when it is back."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import StructType

from fleetlens.operators.nodes import NODE_KEYS
from fleetlens.streaming.utilization import DATE_COLUMN

OPENED, CLOSED = "opened", "closed"


@dataclass(frozen=True)
class AlertRule:
    """An alert opens with the ``open_after``-th window in a row over the limit.

    It closes with the ``close_after``-th window in a row that is not over it. Windows without a value
    are passed over, as are times without windows. An alert of a group that is not heard of any more stays open.
    """

    metric: str = "avg_cpu_utilization"
    limit: float = 80.0
    open_after: int = 3
    close_after: int = 2

    def __post_init__(self) -> None:
        if min(self.open_after, self.close_after) < 1:
            raise ValueError("an alert needs one window or more")


def _schema(windows: DataFrame, rule: AlertRule) -> StructType:
    fields = {field.name: field for field in windows.schema}
    named = [fields[name] for name in (*NODE_KEYS, "window_start", "window_end", rule.metric)]
    return StructType(named).add("change", "string")


def read_windows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Windows that a stream of ``windowed_utilization`` writes, as a stream of their own."""
    dated = StructType(schema.fields).add(DATE_COLUMN, "date")
    return spark.readStream.schema(dated).parquet(path).select(schema.names)


def alert_episodes(windows: DataFrame, rule: AlertRule = AlertRule()) -> DataFrame:
    """The changes of alerts over a stream of closed windows, read by ``read_windows``.

    Windows come from what another stream wrote, as Spark keeps no state of one's own behind a windowed
    aggregate of the same stream. Returns the group, the window that decided, its value, and ``change``: ``opened`` or ``closed``. State is three
    fields for each group, in RocksDB (``session.prepare``), and survives restarts.
    """
    schema = _schema(windows, rule)

    def advance(
        key: tuple, frames: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        is_open, is_over, n = state.get if state.exists else (False, False, 0)
        changes = []
        # Closed windows come in order from batch to batch, but in any order within one.
        rows = pd.concat(list(frames)).sort_values("window_start")
        for row in rows[rows[rule.metric].notna()].to_dict("records"):
            over = row[rule.metric] > rule.limit
            n = n + 1 if over == is_over else 1
            is_over = over
            if over != is_open and n == (rule.open_after if over else rule.close_after):
                is_open = over
                changes.append(row | {"change": OPENED if over else CLOSED})
        state.update((is_open, is_over, n))
        if changes:
            yield pd.DataFrame(changes)[schema.names]

    wanted = windows.select(schema.names[:-1])
    return wanted.groupBy(*NODE_KEYS).applyInPandasWithState(
        advance, schema, "is_open BOOLEAN, is_over BOOLEAN, n INT", "append", "NoTimeout"
    )


def batch_alert_episodes(windows: DataFrame, rule: AlertRule = AlertRule()) -> DataFrame:
    """The same changes over a table of windows, by islands of windows over and not over the limit.

    The window that makes an island long enough is a signal; a signal is a change where the one before it
    said otherwise, and the first one only if it opens.
    """
    in_time = Window.partitionBy(*NODE_KEYS).orderBy("window_start")
    island = Window.partitionBy(*NODE_KEYS, "is_over", "island").orderBy("window_start")
    valued = windows.select(*NODE_KEYS, "window_start", "window_end", rule.metric).filter(
        F.col(rule.metric).isNotNull()
    )
    counted = (
        valued.withColumn("is_over", F.col(rule.metric) > rule.limit)
        .withColumn("turned", F.col("is_over") != F.lag("is_over", 1, False).over(in_time))
        .withColumn("island", F.sum(F.col("turned").cast("int")).over(in_time))
        .withColumn("n", F.row_number().over(island))
    )
    signals = counted.filter(F.expr(f"n = IF(is_over, {rule.open_after}, {rule.close_after})"))
    before = F.lag("is_over", 1, False).over(in_time)
    changes = signals.withColumn("before", before).filter("is_over <> before")
    return changes.select(
        *NODE_KEYS,
        "window_start",
        "window_end",
        rule.metric,
        F.when(F.col("is_over"), OPENED).otherwise(CLOSED).alias("change"),
    )
