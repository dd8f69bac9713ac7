"""Session settings the joins and aggregates count on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime settings. A join that feeds an aggregate on the join key
# is split on a hot key only if Spark may add a shuffle for it.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def prepare(spark: SparkSession) -> SparkSession:
    """Turn on run-time re-planning, the splitting of hot join keys and state on disk."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
