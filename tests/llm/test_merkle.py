from __future__ import annotations

import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import merkle

DOCS = "doc_id BIGINT, source STRING, lang STRING, n_chars INT, text STRING"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf(row: tuple) -> str:
    told = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row]
    return digest("".join(told))


def tree(nodes: list[str]) -> tuple[str, list[list[tuple[int, str]]]]:
    """The root, and each node's steps, level by level over the whole list."""
    steps: list[list[tuple[int, str]]] = [[] for _ in nodes]
    below = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = range(0, len(nodes), 16)
        for i in range(len(nodes)):
            first = i // 16 * 16
            others = nodes[first:i] + nodes[i + 1 : first + 16]
            for member in below[i]:
                steps[member].append((i - first, "".join(others)))
        below = [sum(below[i : i + 16], []) for i in runs]
        nodes = [digest("".join(nodes[i : i + 16])) for i in runs]
    return nodes[0], steps


def expected(rows: list[tuple]) -> list[tuple]:
    by_source: dict = {}
    for row in rows:
        by_source.setdefault(row[1], []).append(row)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        order = sorted(by_source[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((order, *tree([leaf(r) for r in order])))
    root, tops = tree([subroot for _, subroot, _ in trees])
    return [
        (r[0], r[1], leaf(r), subroot, root, [*path, *tops[k]])
        for k, (order, subroot, steps) in enumerate(trees)
        for r, path in zip(order, steps, strict=True)
    ]


def found(spark, rows, levels=merkle.LEVELS):
    frame = merkle.manifest(spark.createDataFrame(rows, DOCS), levels)
    return [
        (r.doc_id, r.source, r.leaf, r.subroot, r.root, [(s.place, s.siblings) for s in r.witness])
        for r in frame.collect()
    ]


def by_text(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=repr)


def some_rows(n: int, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    sources = ["a"] * 6 + ["b", "", None, "é", "z", "\U0001f600"]
    return [
        (i, rng.choice(sources), rng.choice(["en", None]), rng.choice([None, 5]), f"Text {i} é")
        for i in rng.sample(range(10 * n), n)
    ]


@pytest.mark.parametrize("sizes", [{"s": 1}, {"s": 16}, {"s": 17}, {"s": 257, "t": 1}, {"s": 4097}])
def test_sizes_around_full_runs(spark, sizes):
    rows = [(i, name, "en", 1, f"{name}{i}") for name, n in sizes.items() for i in range(n)]
    assert by_text(found(spark, rows)) == by_text(expected(rows))


def test_many_sources(spark):
    rows = some_rows(400) + [(i, f"one{i}", None, None, None) for i in range(40)]
    assert by_text(found(spark, rows)) == by_text(expected(rows))


def test_roots_of_blocks_are_appended_in_turn(spark):
    rows = [(i, "s", "en", 1, str(i)) for i in range(600)] + some_rows(60)
    rows += [(i, f"one{i}", None, None, None) for i in range(40)]
    assert by_text(found(spark, rows, levels=1)) == by_text(expected(rows))


def test_nulls_repeats_and_empty_texts(spark):
    rows = [(None, None, None, None, None), (1, None, "", 0, ""), (1, "s", "en", 1, "x")]
    rows += [(1, "s", "en", 1, "x"), (1, "s", "en", 1, "y"), (-5, "s", "en", 1, "y"), (None, "s", None, 2, "z")]
    assert by_text(found(spark, rows)) == by_text(expected(rows))
    assert found(spark, []) == []


def test_long_text(spark):
    rows = [(1, "s", "en", 1, "wörd " * 1_000_000), (2, "s", "en", 1, "")]
    assert by_text(found(spark, rows)) == by_text(expected(rows))


def test_witnesses_fold_to_the_root_and_show_changes(spark):
    rows = some_rows(300)
    docs = spark.createDataFrame(rows, DOCS).withColumn("digest", F.lit(1)).withColumn("tree", F.lit(2))
    changed = merkle.leaf_digest(text=F.lower("text"))
    checked = (
        merkle.manifest(docs, changed=changed)
        .select(
            (merkle.folded("leaf") == F.col("root")).alias("whole"),
            (merkle.folded("changed") == F.col("root")).alias("after"),
            merkle.proof_digest().alias("proof"),
            "witness",
        )
        .collect()
    )
    assert len(checked) == 300
    assert all(r.whole and not r.after for r in checked)
    assert all(r.proof == digest("".join(s.siblings for s in r.witness)) for r in checked)


def test_append_in_two_parts_keeps_complete_subtrees(spark):
    """Steps inside complete runs do not change when rows follow."""
    rows = [(i, "s", "en", 1, str(i)) for i in range(300)]
    before = {r[0]: r[5] for r in found(spark, rows[:256])}
    after = {r[0]: r[5] for r in found(spark, rows)}
    assert all(after[i][: len(path)] == path for i, path in before.items())
