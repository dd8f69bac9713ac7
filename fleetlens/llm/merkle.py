"""Merkle manifest of documents: a tree per source, a root over all, and a witness per row."""

from __future__ import annotations

from collections.abc import Iterable
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.texts import small, stage_counted
from fleetlens.sources.sinks import stage

# Children of a node, and levels of the aligned blocks, each of which one task appends to.
ARITY = 16
LEVELS = 3

# Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

# Rows number themselves within a partition below this bit.
_ROW_BITS = 33

Step = tuple[int, str]
_WITNESS = "ARRAY<STRUCT<place: INT, siblings: STRING>>"
_STEP = pa.struct([("place", pa.int32()), ("siblings", pa.string())])


def leaf_digest(**changed: Column) -> Column:
    """SHA-256 of a row's fields, each as its byte count and value; ``changed`` replaces fields."""

    def told(name: str) -> Column:
        value = changed.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(told, FIELDS)), 256)


def depth(n: int) -> int:
    """Levels above ``n`` nodes, up to the one node that remains."""
    levels = 0
    while n > 1:
        n = -(-n // ARITY)
        levels += 1
    return levels


class BlockTree:
    """The subtree of one aligned block, to which nodes are appended from left to right.

    A run of siblings stays open until its ``ARITY``-th member comes. When it is complete,
    each member's witness is extended by its siblings, and the run's digest is appended
    one level up. A witness belongs to the subtree below the member, so that all leaves
    of it share the step.
    """

    def __init__(self, height: int) -> None:
        self._open: list[list[str]] = [[] for _ in range(height)]
        self._steps: list[list[Step]] = [[] for _ in range(height)]
        self.root = ""

    def append(self, digest: str, level: int = 0) -> None:
        if level == len(self._open):
            self.root = digest
            return
        self._open[level].append(digest)
        if len(self._open[level]) == ARITY:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self._open[level] = self._open[level], []
        joined = "".join(run)
        size = len(run[0])
        self._steps[level] += [
            (i, joined[: i * size] + joined[(i + 1) * size :]) for i in range(len(run))
        ]
        self.append(sha256(joined.encode()).hexdigest(), level + 1)

    def close(self) -> None:
        """Complete the runs that are still open, from the leaves up."""
        for level, run in enumerate(self._open):
            if run:
                self._complete(level)

    def witness(self, place: int) -> list[Step]:
        """The steps from a node of the block to the block's root."""
        return [steps[place // ARITY**level] for level, steps in enumerate(self._steps)]


def _appended(digests: Iterable[str], n: int, levels: int) -> BlockTree:
    tree = BlockTree(min(levels, depth(n)))
    for digest in digests:
        tree.append(digest)
    tree.close()
    return tree


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add ``pos``, the place of a row in its ``tree`` by ``order`` from 0, and ``n``, the tree's rows.

    Rows are sorted over ranges of all trees, so that a large tree takes many tasks.
    Only one count for each range and tree is summed up. The sorted rows are staged.
    """
    row = F.monotonically_increasing_id().bitwiseAND((1 << _ROW_BITS) - 1)
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ranged = stage(
        ranged.withColumn("part", F.spark_partition_id()).withColumn("row", row), f"{name}-sorted"
    )
    counts = ranged.groupBy("tree", "part").agg(F.count("*").alias("size"), F.min("row").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.sum("size").over(tree.orderBy("part")) - F.col("size")
    offsets, n_offsets = stage_counted(
        counts.select(
            "tree", "part", (before - F.col("first")).alias("offset"), F.sum("size").over(tree).alias("n")
        ),
        f"{name}-offsets",
    )
    placed = ranged.join(small(offsets, n_offsets), ["tree", "part"])
    return placed.withColumn("pos", F.col("row") + F.col("offset")).drop("part", "row", "offset")


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {ARITY**levels}"))


def block_roots(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(tree, pos, n, digest): the root of each aligned block of nodes, as the nodes to append next."""

    def root(block: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        n = block["n"][0].as_py()
        made = {
            "tree": block["tree"][:1],
            "pos": block["block"][:1],
            "n": [-(-n // ARITY**levels)],
            "digest": [_appended(block["digest"].to_pylist(), n, levels).root],
        }
        return pa.table(made, schema=_NODES)

    wanted = _blocks(nodes.select("tree", "pos", "n", "digest"), levels)
    return wanted.groupBy("tree", "block").applyInArrow(
        root, "tree STRING, pos BIGINT, n BIGINT, digest STRING"
    )


_NODES = pa.schema(
    [("tree", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.string())]
)


def appended_rounds(nodes: DataFrame, name: str, levels: int = LEVELS) -> list[DataFrame]:
    """The nodes, then the roots of their blocks, and so on up to one node for each tree.

    Each round has as many times fewer nodes as a block has leaves. Only the size of the
    largest tree reaches the driver.
    """
    rounds = [nodes]
    while True:
        rounds.append(stage(block_roots(rounds[-1], levels), f"{name}-roots"))
        if (rounds[-1].agg(F.max("n")).first()[0] or 1) == 1:
            return rounds


def extended(nodes: DataFrame, above: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Add to each node its witness up to the top, and the ``subroot`` and ``root`` there.

    ``above`` has (tree, pos, witness, subroot, root) of the block roots. A task sees
    the nodes of one block, and a row for their root.
    """
    columns = [c for c in nodes.columns if c != "n"]

    def extend(block: pa.Table, root: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        tree = _appended(block["digest"].to_pylist(), block["n"][0].as_py(), levels)
        onwards = [(step["place"], step["siblings"]) for step in root["witness"][0].as_py()]
        steps = [
            {"place": place, "siblings": siblings}
            for i in range(block.num_rows)
            for place, siblings in (*tree.witness(i), *onwards)
        ]
        each = len(steps) // block.num_rows
        offsets = pa.array(range(0, len(steps) + 1, each) if each else [0] * (block.num_rows + 1), pa.int32())
        made = block.select(columns)
        made = made.append_column(
            "witness", pa.ListArray.from_arrays(offsets, pa.array(steps, _STEP))
        )
        for top in ("subroot", "root"):
            made = made.append_column(top, pa.array(root[top].to_pylist() * block.num_rows, pa.string()))
        return made

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema if f.name in columns)
    onto = above.select("tree", F.col("pos").alias("block"), "witness", "subroot", "root")
    return (
        _blocks(nodes, levels)
        .groupBy("tree", "block")
        .cogroup(onto.groupBy("tree", "block"))
        .applyInArrow(extend, f"{types}, witness {_WITNESS}, subroot STRING, root STRING")
    )


def _witnessed(rounds: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    for nodes in reversed(rounds[:-1]):
        above = extended(nodes, above, levels)
    return above


def manifest(docs: DataFrame, levels: int = LEVELS, **carried: Column) -> DataFrame:
    """Merkle trees of documents, with a witness for every row.

    Returns doc_id, source, leaf, subroot (of the source's tree), root (of all),
    witness, and the ``carried`` columns, computed where the texts are read. A witness has a step
    for each level from the leaf to the root: the node's place among its siblings, and
    the siblings' digests, joined from left to right. A node alone in its run has a step without
    siblings.

    Leaves of a source ascend by doc_id, null first; rows with the same id by digest, so that
    repeated rows each are a leaf. Every ``ARITY`` consecutive nodes become one until one is
    left. Sources come null first, then by bytes; an empty source is not null. An empty table
    has no rows. Texts are read once and never shuffled. Blocks of ``ARITY ** levels``
    leaves are the units of tasks, however many rows a source has.
    """
    fields = [F.col(name) for name in FIELDS]
    rows = docs.select(*fields).select(
        F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit("")).alias("tree"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        leaf_digest().alias("digest"),
        *(column.alias(name) for name, column in carried.items()),
    )
    leaves = numbered(stage(rows, "merkle-leaves"), ["doc_id", "digest"], "merkle")
    rounds = appended_rounds(leaves, "merkle", levels)
    tops = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest")
    upper = appended_rounds(numbered(tops, ["of"], "merkle-tops"), "merkle-tops", levels)
    start = upper[-1].select(
        "tree",
        "pos",
        F.expr(f"CAST(array() AS {_WITNESS}) AS witness"),
        F.lit(None).cast("string").alias("subroot"),
        F.col("digest").alias("root"),
    )
    subroots = _witnessed(upper, start, levels).select(
        F.col("of").alias("tree"), F.lit(0).cast("bigint").alias("pos"), "witness",
        F.col("digest").alias("subroot"), "root",
    )
    return _witnessed(rounds, subroots, levels).select(
        "doc_id",
        F.expr("IF(tree = '', NULL, substring(tree, 2)) AS source"),
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        "witness",
        *carried,
    )


def folded(node: str, witness: str = "witness") -> Column:
    """The root that a leaf's digest and a witness lead to."""
    size = 64
    return F.expr(
        f"aggregate({witness}, {node}, (node, step) -> sha2(concat("
        f"substring(step.siblings, 1, {size} * step.place), node, "
        f"substring(step.siblings, {size} * step.place + 1)), 256))"
    )


def proof_digest(witness: str = "witness") -> Column:
    """SHA-256 of all digests of a witness, from the leaf up."""
    return F.expr(f"sha2(array_join(transform({witness}, step -> step.siblings), ''), 256)")
