"""Writers: result tables, text reports, and tables staged between two steps."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

SHARED_DIR_KEY = "spark.checkpoint.dir"


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite"
) -> None:
    """Write a result as Parquet, optionally partitioned.

    With partition columns the rows are rebalanced on them first: each output
    directory then gets few files, and a directory that holds most of the rows
    is split over several tasks.
    """
    if partition_by:
        df.hint("rebalance", *partition_by).write.mode(mode).partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def write_report(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write report lines as text.

    The lines are range-partitioned, so the part files read in name order give
    the report, whether it is one small file or many.
    """
    lines.orderBy("ord", "rank", "line").select("line").write.mode(mode).text(path)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder that all executors can reach.

    It lies under ``spark.checkpoint.dir``. Only a session whose one process is driver
    and executor may go without that setting; then a temporary folder serves.
    """
    root = spark.conf.get(SHARED_DIR_KEY, None)
    if root is None:
        master = spark.conf.get("spark.master", None) or ""
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set {SHARED_DIR_KEY} to a folder that all executors can reach")
        root = tempfile.mkdtemp(prefix="fleetlens-")
    return f"{root.rstrip('/')}/fleetlens/{purpose}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Compute a frame once, write it to the shared folder and read it back.

    For results that several later steps use. Unlike a cache the copy outlives
    lost executors, keeps column pruning and carries its size for join planning.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_bucketed(df: DataFrame, name: str, column: str, n_buckets: int) -> DataFrame:
    """``stage``, the rows dealt to buckets by a column: groups of it need no shuffle afterwards.

    Buckets belong to a table. Its name is given up at once; its files stay.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    called = f"staged_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("path", path).option("compression", "zstd")
    writer.bucketBy(n_buckets, column).saveAsTable(called)
    staged = spark.table(called)
    spark.sql(f"DROP TABLE {called}")
    return staged
