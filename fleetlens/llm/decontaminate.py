"""Benchmark decontamination: SimHash of item-sized windows, then exact similarity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.texts import SPACES, small, stage_counted
from fleetlens.sources.sinks import stage

FINGERPRINT_BITS = 64


@dataclass(frozen=True)
class LeakRules:
    """Shingle width in words, least similarity in percent, and the Hamming radius.

    A window at similarity 0.8 differs from its item in about 10 of 64 bits; one in
    a thousand differs in more than 19.
    """

    width: int = 5
    min_percent: int = 80
    radius: int = 19


def words(text: Column) -> Column:
    """The words of a text, lower case; A-Z only, as other letters depend on the locale."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), upper, lower), SPACES)
    return F.filter(parts, lambda w: w != "")


def shingle_hashes(found: str, width: int) -> Column:
    """Hash of each run of ``width`` words of an array column, in order."""
    run = ", ".join(f"get({found}, i + {k})" for k in range(width))
    return F.expr(
        f"IF(size({found}) < {width}, array(), "
        f"transform(sequence(0, size({found}) - {width}), i -> xxhash64({run})))"
    )


def simhash(hashes: str) -> Column:
    """SimHash: each bit is the majority of the shingles' bits, counted with repeats."""
    bits = [
        f"IF(2 * aggregate({hashes}, 0, (n, h) -> n + getbit(h, {b})) > size({hashes}), "
        f"shiftleft(1L, {b}), 0L)"
        for b in range(FINGERPRINT_BITS)
    ]
    return F.expr(" | ".join(bits))


def blocks(fingerprint: str, radius: int) -> Column:
    """The fingerprint cut into radius + 1 blocks, as (number, bits).

    Two fingerprints within the radius differ in at most ``radius`` bits, so one block
    at least is equal.
    """
    n = radius + 1
    starts = [FINGERPRINT_BITS * i // n for i in range(n + 1)]
    parts = [
        f"named_struct('no', {i}, 'bits', shiftrightunsigned({fingerprint}, {a}) & {(1 << (b - a)) - 1}L)"
        for i, (a, b) in enumerate(zip(starts, starts[1:], strict=False))
    ]
    return F.expr(f"array({', '.join(parts)})")


def numbered(hashes: str) -> Column:
    """Shingles with their occurrence number, so that sets of them are multisets."""
    return F.expr(
        f"transform({hashes}, (h, i) -> "
        f"xxhash64(h, size(filter(slice({hashes}, 1, i + 1), g -> g = h))))"
    )


def least_shared(n: str, size: str, min_percent: int) -> Column:
    """Least shingles shared at ``min_percent`` by an item of n and a window of it in a text of size."""
    both = f"{min_percent} * ({n} + least({n}, {size}))"
    return F.expr(f"greatest(1, int(ceil({both} / {100 + min_percent})))")


def window_starts(at: str, least: str, n: str, size: str) -> Column:
    """Starts of the windows of n shingles that hold ``least`` or more of the sorted places ``at``.

    A text of ``size`` below n has one window, at 0. The starts for the run of places that
    begins with the i-th end at that place; those up to the place before it are of the runs
    before. So each start is given once, and none is left out.
    """
    first = (
        f"greatest(0, {at}[i + {least} - 1] - {n} + 1, IF(i = 0, 0, get({at}, i - 1) + 1))"
    )
    last = f"least({at}[i], greatest(0, {size} - {n}))"
    return F.expr(
        f"flatten(transform(sequence(0, size({at}) - {least}), "
        f"i -> IF({first} > {last}, array(), sequence({first}, {last}))))"
    )


def benchmark_items(benchmark: DataFrame, rules: LeakRules) -> DataFrame:
    """(item_id, width, shingles) of each item that has words.

    An item of fewer words than a shingle is one shingle of all its words.
    """
    found = benchmark.select(
        F.col("item_id").alias("item_id"), words(F.col("text").cast("string")).alias("found")
    ).filter("size(found) > 0")
    width = F.least(F.size("found"), F.lit(rules.width))
    choices = F.when(width == rules.width, shingle_hashes("found", rules.width))
    for k in range(1, rules.width):
        choices = choices.when(width == k, shingle_hashes("found", k))
    return found.select("item_id", width.alias("width"), choices.alias("shingles"))


def benchmark_leaks(
    docs: DataFrame, benchmark: DataFrame, rules: LeakRules = LeakRules()
) -> DataFrame:
    """Passages of documents that are a benchmark item or close to one.

    Returns (doc_id, item_id, n_windows, similarity): for each document and item the
    windows found and the best similarity, that is the shared shingles over all
    shingles of window and item, both counted with repeats.

    A window has as many shingles as the item; a text shorter than the item is one window.
    Every place of a text can start a window. Left out are only windows that hold fewer
    shingles of items of that size than the least similarity needs, whatever their order.
    Only documents with a window are read again for fingerprints. Windows meet items of
    their size in blocks of the fingerprint; pairs within the radius are then compared
    exactly.

    ``similarity`` is the best of all windows. ``n_windows`` counts the similar windows
    with a shingle where the item has it, as all others near them are shifted views; only
    if there is none, it counts the others.

    Null and empty texts, and texts shorter than a shingle, have no window; rows that
    repeat a doc_id count together. Items of equal text are each reported. Building it
    stages the items, the windows and the fingerprints of windows.
    """
    items, _ = stage_counted(benchmark_items(benchmark, rules), "leak-items")
    widths = sorted(row["width"] for row in items.select("width").distinct().collect())
    marks, n_marks = stage_counted(
        items.select("width", F.size("shingles").alias("n"), F.explode("shingles").alias("mark")).distinct(),
        "leak-marks",
    )
    gate, n_gate = stage_counted(marks.select("width", "mark").distinct(), "leak-gate")

    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
    )

    def hashed(frame: DataFrame) -> DataFrame:
        """(doc_id, row, width, hashes) for each width that items have."""
        per_width = [
            F.struct(F.lit(k).alias("width"), shingle_hashes("found", k).alias("hashes"))
            for k in widths
        ]
        both = F.struct(F.xxhash64("text").alias("row"), F.array(*per_width).alias("of"))
        found = frame.withColumn("found", words(F.col("text")))
        return found.select("doc_id", both.alias("b")).select(
            "doc_id", F.col("b.row").alias("row"), F.inline("b.of")
        )

    empty = "doc_id BIGINT, item_id BIGINT, n_windows BIGINT, similarity DOUBLE"
    if not widths:
        return docs.sparkSession.createDataFrame([], empty)

    places = hashed(texts).select(
        "doc_id", "row", "width", F.size("hashes").alias("size"), F.posexplode("hashes").alias("place", "mark")
    )
    hits = places.join(small(gate, n_gate), ["width", "mark"])
    starts = (
        hits.join(small(marks, n_marks), ["width", "mark"])
        .groupBy("doc_id", "row", "width", "n", "size")
        .agg(F.array_sort(F.collect_set("place")).alias("at"))
        .withColumn("least", least_shared("n", "size", rules.min_percent))
        .filter("size(at) >= least")
        .select("doc_id", "row", "width", "n", window_starts("at", "least", "n", "size").alias("starts"))
        .filter("size(starts) > 0")
    )
    windows, _ = stage_counted(starts, "leak-windows")
    ids, n_ids = stage_counted(windows.select("doc_id").distinct(), "leak-ids")
    again = hashed(texts.join(small(ids, n_ids), "doc_id", "left_semi"))
    cut = (
        again.dropDuplicates(["doc_id", "row", "width"])
        .join(windows, ["doc_id", "row", "width"])
        .select("doc_id", "row", "width", "n", F.expr("inline(transform(starts, s -> struct(s AS start, slice(hashes, s + 1, n) AS w)))"))
    )
    fingerprint = simhash("w").alias("fp")
    seen = stage(cut.select("*", fingerprint), "leak-fingerprints")
    known = items.select(
        "item_id", "width", F.size("shingles").alias("n"), F.col("shingles").alias("w")
    ).select("*", fingerprint)

    left = seen.select("doc_id", "row", "start", "width", "n", "w", "fp", F.inline(blocks("fp", rules.radius)))
    right = known.select(
        "item_id",
        "width",
        "n",
        F.col("w").alias("v"),
        F.col("fp").alias("item_fp"),
        F.inline(blocks("fp", rules.radius)),
    )
    near = left.join(right, ["width", "n", "no", "bits"]).filter(
        F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= rules.radius
    )
    shared = F.size(F.array_intersect(numbered("w"), numbered("v")))
    union = F.size("w") + F.size("v") - shared
    aligned = F.expr("exists(zip_with(w, v, (a, b) -> a <=> b), same -> same)")
    return (
        near.dropDuplicates(["doc_id", "row", "start", "item_id"])
        .select("doc_id", "item_id", shared.alias("shared"), union.alias("total"), aligned.alias("aligned"))
        .filter(100 * F.col("shared") >= rules.min_percent * F.col("total"))
        .groupBy("doc_id", "item_id")
        .agg(
            F.expr("IF(any(aligned), count_if(aligned), count(*))").alias("n_windows"),
            F.max(F.col("shared") / F.col("total")).alias("similarity"),
        )
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, rules: LeakRules = LeakRules()) -> DataFrame:
    """The documents without a leak, with all their columns. A null doc_id never leaks."""
    leaks, n = stage_counted(benchmark_leaks(docs, benchmark, rules).select(F.col("doc_id").alias("leak_id")).distinct(), "leaks")
    return docs.join(small(leaks, n), F.col("doc_id") == F.col("leak_id"), "left_anti")
