"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import zlib
from collections.abc import Mapping, Sequence
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.sources.sinks import stage

# Cells of the ring. A cell is the unit in which rows are counted and ranked, so
# this bounds what the plan holds, whatever the number of rows.
CELLS = 1 << 16
NODES_PER_SHARD = 64

Step = tuple[int, int, int, int]


def ring(n_shards: int, nodes_per_shard: int = NODES_PER_SHARD) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node in ring order.

    A node's cell depends on its shard and number alone, so a further shard only
    adds nodes. Of nodes that meet in a cell the lowest shard's stays.
    """
    nodes: dict[int, int] = {}
    for shard in range(n_shards):
        for node in range(nodes_per_shard):
            nodes.setdefault(zlib.crc32(f"shard {shard} node {node}".encode()) % CELLS, shard)
    return sorted(nodes.items())


def capacities(n_rows: int, n_shards: int) -> list[int]:
    """Loads at most one apart that hold all rows exactly."""
    return [n_rows // n_shards + (shard < n_rows % n_shards) for shard in range(n_shards)]


def plan(
    counts: Mapping[int, int], nodes: Sequence[tuple[int, int]], loads: Sequence[int]
) -> list[tuple[int, list[Step]]]:
    """Where the rows of each cell go: (cell, [(from rank, to rank, shard, first slot)]).

    All cells up to a node's, from the one behind the node before, are its arc. In
    turn t every arc offers what it has left to the shard of the t-th node
    clockwise; a shard takes in ring order until it is full, and the rest of the arc
    moves on. Ranks count the rows of an arc, then of a cell.
    """
    ends = [cell for cell, _ in nodes]
    arcs: list[list[int]] = [[] for _ in nodes]
    at = 0
    for cell in sorted(counts):
        while at < len(ends) and cell > ends[at]:
            at += 1
        arcs[at % len(ends)].append(cell)
    left = [sum(counts[cell] for cell in arc) for arc in arcs]
    totals, filled = list(left), [0] * len(loads)
    taken: list[list[Step]] = [[] for _ in nodes]
    for turn in range(len(nodes)):
        for arc, rest in enumerate(left):
            shard = nodes[(arc + turn) % len(nodes)][1]
            n = min(rest, loads[shard] - filled[shard])
            if n:
                start = totals[arc] - rest
                taken[arc].append((start, start + n, shard, filled[shard]))
                filled[shard] += n
                left[arc] -= n
        if not any(left):
            break
    steps = []
    for cells, intervals in zip(arcs, taken, strict=True):
        sizes = [counts[cell] for cell in cells]
        for cell, size, end in zip(cells, sizes, accumulate(sizes), strict=True):
            begin = end - size
            within = [
                (max(a, begin) - begin, min(b, end) - begin, shard, slot + max(a, begin) - a)
                for a, b, shard, slot in intervals
                if a < end and b > begin
            ]
            steps.append((cell, within))
    return steps


def shard_rows(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """Deal rows to shards whose counts are at most one apart.

    Returns doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, shard and slot
    (gapless from 0 in each shard). A row's place on the ring comes from its id and
    text. Rows are counted per cell of the ring; the counts, at most ``CELLS``
    however many rows there are, give each cell a short list of rank ranges. The rank
    within a cell then finds the shard.

    A null text has size 1 and the checksum of an empty one. Rows alike in all of this
    take neighbouring places. Building it stages (doc_id, size, text_crc32).
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint"),
        (F.octet_length(text).cast("bigint") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    place = F.xxhash64("doc_id", "size", "text_crc32")
    placed = stage(rows.withColumn("place", place), "ring-places").withColumn(
        "cell", F.shiftrightunsigned("place", 48).cast("int")
    )
    counts = {row["cell"]: row["n"] for row in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    loads = capacities(sum(counts.values()), n_shards)
    steps = docs.sparkSession.createDataFrame(
        plan(counts, ring(n_shards), loads),
        "cell INT, steps ARRAY<STRUCT<a BIGINT, b BIGINT, shard INT, slot BIGINT>>",
    )
    order = Window.partitionBy("cell").orderBy("place", "doc_id", "size", "text_crc32")
    ranked = placed.withColumn("rank", F.row_number().over(order).cast("bigint") - 1)
    chosen = F.expr("filter(steps, s -> rank >= s.a AND rank < s.b)[0]")
    return (
        ranked.join(F.broadcast(steps), "cell")
        .withColumn("step", chosen)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.col("step.shard").alias("shard"),
            (F.col("step.slot") + F.col("rank") - F.col("step.a")).alias("slot"),
        )
    )
