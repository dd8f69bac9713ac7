"""Helpers shared by the text operators: words, Arrow batches and staged tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.sources.sinks import stage

# Most rows of a table that is sent whole to every task. Only for rows of a few
# numbers; above it, the same join shuffles both sides.
BROADCAST_ROWS = 200_000

# Rows of one key beyond which the facts of it are broadcast: this many, or this part of all
# rows, so that at most ``HOT_PARTS`` keys are ever broadcast.
HOT_ROWS = 1000
HOT_PARTS = 100_000

# Words end at these characters and at no others.
SPACES = r"[\x20\x09-\x0D]+"

# Most UTF-8 bytes that a Python worker looks at in one go. A longer text is a
# piece of its own.
PIECE_BYTES = 4 << 20

# Spark's setting for the bytes of rows that go to a Python worker at once.
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"

_WORD_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)


def byte_words(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text. ``bytes.split`` cuts at ASCII white space only."""
    return text.split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash for each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    values = (values ^ (values >> np.uint64(30))) * _WORD_MIX[0]
    values = (values ^ (values >> np.uint64(27))) * _WORD_MIX[1]
    return values ^ (values >> np.uint64(31))


def pieces(
    batch: pa.RecordBatch, column: str = "text", most: int = PIECE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a piece holds few bytes of text, but one row at least."""
    texts = batch.column(column)
    ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0), "int64"))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def bounded_batches(spark: SparkSession) -> None:
    """Have Spark send rows to Python workers by ``PIECE_BYTES``, unless the session says otherwise.

    Else a batch has rows by their number, which may be all texts of a task, and both
    the executor and the worker hold it whole.
    """
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, str(PIECE_BYTES))


def in_pieces(
    df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str
) -> DataFrame:
    """Map bounded pieces of a frame with a column ``text`` through a function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                yield function(piece)

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def find_code(spark: SparkSession) -> None:
    """Let Python workers on this machine find the package, wherever the driver was started.

    A cluster gets it as every Spark job gets its code, such as with ``--py-files``.
    """
    root = str(Path(__file__).resolve().parents[2])
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Write a frame to the shared folder; the copy and its number of rows."""
    staged = stage(df, name)
    return staged, staged.count()


def small(df: DataFrame, n_rows: int) -> DataFrame:
    """Broadcast a frame whose counted rows are few; else leave the join to shuffle."""
    return F.broadcast(df) if n_rows <= BROADCAST_ROWS else df


def joined_by_size(
    rows: DataFrame, facts: DataFrame, on: list[str], size: str, total: int, how: str = "inner"
) -> DataFrame:
    """Rows with the facts of their key, which are unique. ``size`` of the facts counts a key's rows.

    Keys of very many rows are few, by their counts; their facts go to all tasks. The
    other rows meet theirs by shuffle. ``how`` is ``inner`` or ``left``; no key may be null.
    """
    hot_size = max(HOT_ROWS, total // HOT_PARTS)
    hot = facts.filter(F.col(size) > hot_size)
    cold = facts.filter(F.col(size) <= hot_size)
    names = [c for c in facts.columns if c not in on]
    met = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), on, "left")
    of_hot = met.filter("_hot").drop("_hot")
    rest = met.filter("_hot IS NULL").drop("_hot", *names).join(cold, on, how)
    return of_hot.unionByName(rest)
