"""Removal of long byte strings that occur more than once, by suffix arrays over shards."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.suffix_array import common_prefixes, suffix_array
from fleetlens.llm.texts import in_pieces, joined_by_size, mixed, small, stage_counted
from fleetlens.llm.texts import pieces as bounded
from fleetlens.sources.sinks import stage

# Ends a segment in a shard. No UTF-8 text holds this byte.
SEPARATOR = 0xFF

# Bytes of a text that are looked at together, and bits of a place among them.
_CHUNK_BITS = 20
_CHUNK = 1 << _CHUNK_BITS

# Most partitions that shards are dealt to.
MAX_PARTITIONS = 20_000

# Most windows of a segment.
_SEGMENT = 512

_GRAM_SEED = 12
_ODD = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class RepeatRules:
    """Strings of ``width`` bytes that start twice are repeats.

    A window of ``width`` bytes has as its key the least hash of the ``gram``-byte strings in it.
    Shards hold about ``shard_bytes``. A key with more than ``key_bytes`` of different
    segments is compared window by window instead of in one shard.
    """

    width: int = 400
    gram: int = 128
    shard_bytes: int = 2 << 20
    key_bytes: int = 8 << 20


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte, and powers of an odd number and of its inverse, modulo 2^64."""
    values = np.random.default_rng(_GRAM_SEED).integers(0, 1 << 64, 256, dtype=np.uint64)
    powers = []
    for base in (_ODD, pow(_ODD, -1, 1 << 64)):
        row = np.full(size, base, np.uint64)
        row[0] = 1
        powers.append(np.cumprod(row))
    return values, *powers


def window_keys(data: np.ndarray, rules: RepeatRules) -> tuple[np.ndarray, np.ndarray]:
    """The key of each window of a chunk, and the place of the leftmost gram that has it.

    Equal windows have equal keys, wherever they stand.
    """
    n, gram = len(data), rules.gram
    values, powers, inverses = _powers(_CHUNK)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[data] * powers[:n])])
    hashes = mixed((sums[gram:] - sums[:-gram]) * inverses[: n - gram + 1])
    place_mask = np.uint64(_CHUNK - 1)
    least = (hashes & ~place_mask) | np.arange(len(hashes), dtype=np.uint64)
    span, covered = rules.width - gram + 1, 1
    while covered < span:
        step = min(covered, span - covered)
        least = np.minimum(least[:-step], least[step:])
        covered += step
    places = (least & place_mask).astype(np.int64)
    return hashes[places].view(np.int64), places


def segments_of(text: bytes, rules: RepeatRules) -> Iterator[tuple[int, int, int, bool]]:
    """(start, windows, key, inner) of runs of neighbouring windows with one key.

    Every window is in one segment. ``inner`` tells that windows of a segment may equal
    each other: the gram with the key stands in it twice.
    """
    step = _CHUNK - rules.width + 1
    for offset in range(0, len(text) - rules.width + 1, step):
        data = np.frombuffer(text, np.uint8, min(_CHUNK, len(text) - offset), offset)
        keys, places = window_keys(data, rules)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for first, end in zip(cuts, cuts[1:], strict=False):
            inner = bool(places[first] != places[end - 1])
            for start in range(first, end, _SEGMENT):
                yield offset + start, min(_SEGMENT, end - start), int(keys[first]), inner


_SKETCH = (
    "id BIGINT, mark BIGINT, "
    "segments ARRAY<STRUCT<start: INT, n: INT, key: BIGINT, hi: BIGINT, lo: BIGINT, inner: BOOLEAN>>"
)
_SEGMENTS = pa.list_(
    pa.struct(
        [("start", pa.int32()), ("n", pa.int32()), ("key", pa.int64())]
        + [("hi", pa.int64()), ("lo", pa.int64()), ("inner", pa.bool_())]
    )
)


def _digest(data: bytes) -> tuple[int, int]:
    both = xxhash.xxh3_128_intdigest(data)
    return _signed(both >> 64), _signed(both & (1 << 64) - 1)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _marked(docs: DataFrame) -> DataFrame:
    """(doc_id, id, mark, text): rows with equal id and mark have equal texts. No id is null."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).select(
        "doc_id", F.expr("coalesce(doc_id, 0) AS id"), F.xxhash64("text").alias("mark"), "text"
    )


def sketch(docs: DataFrame, rules: RepeatRules) -> DataFrame:
    """The segments of every text that has a window, by key and digest, without their bytes."""
    width = rules.width

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for text in batch.column("text").to_pylist():
            raw = text.encode()
            found.append(
                [
                    (start, n, key, *_digest(raw[start : start + n + width - 1]), inner)
                    for start, n, key, inner in segments_of(raw, rules)
                ]
            )
        flat = [segment for segments in found for segment in segments]
        columns = list(zip(*flat, strict=True)) or [()] * 6
        fields = _SEGMENTS.value_type
        arrays = [pa.array(c, fields[i].type) for i, c in enumerate(columns)]
        ends = np.cumsum([0, *map(len, found)])
        lists = pa.ListArray.from_arrays(
            pa.array(ends, pa.int32()), pa.StructArray.from_arrays(arrays, fields=list(fields))
        )
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("mark"), lists], names=["id", "mark", "segments"]
        )

    return in_pieces(docs.filter(F.octet_length("text") >= width), cut, _SKETCH)


_RANGES = "ARRAY<STRUCT<a: INT, b: INT>>"
_VERDICT = f"key BIGINT, hi BIGINT, lo BIGINT, ranges {_RANGES}"
_VERDICT_TYPES = pa.schema(
    [("key", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64())]
    + [("ranges", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))]
)


def repeated_windows(segments: list[bytes], width: int) -> np.ndarray:
    """Which places of the joined segments start a window that starts elsewhere too.

    The segments stand one behind the other, each with a separator.
    """
    text = np.frombuffer(b"".join(s + bytes([SEPARATOR]) for s in segments), np.uint8)
    sizes = np.array([len(s) + 1 for s in segments])
    left = np.repeat(np.cumsum(sizes) - 1, sizes) - np.arange(len(text))
    neighbour, prefix = common_prefixes(text, suffix_array(text, 256), left)
    repeated = prefix >= width
    repeated[neighbour[repeated]] = True
    return repeated


def ranges_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """The stretches of places that are set, as (first, end)."""
    change = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(change[::2].tolist(), change[1::2].tolist(), strict=True))


def _sorted_shards(bytes_of: DataFrame, n_shards: int, width: int) -> DataFrame:
    """The repeated windows of each segment, from a suffix array for each shard of keys."""

    def sort(shard: pa.Table) -> pa.Table:
        ids = list(zip(*(shard[c].to_pylist() for c in ("key", "hi", "lo")), strict=True))
        data = dict(zip(ids, shard["data"].to_pylist(), strict=True))
        copied = dict(zip(ids, shard["copied"].to_pylist(), strict=True))
        flags = repeated_windows(list(data.values()), width)
        rows, end = [], 0
        for name, raw in data.items():
            start, end = end, end + len(raw) + 1
            n = len(raw) - width + 1
            ranges = [(0, n)] if copied[name] else ranges_of(flags[start : start + n])
            if ranges:
                rows.append((*name, [{"a": a, "b": b} for a, b in ranges]))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.table(
            [pa.array(c, f.type) for c, f in zip(columns, _VERDICT_TYPES, strict=True)], schema=_VERDICT_TYPES
        )

    dealt = bytes_of.withColumn("shard", F.expr(f"pmod(xxhash64(key), {n_shards}L)"))
    dealt = dealt.repartition(min(n_shards, MAX_PARTITIONS), "shard")
    return dealt.groupBy("shard").applyInArrow(sort, _VERDICT)


def _texts_with(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(text, segments) of the texts that stand for segments."""
    lists = wanted.groupBy("id", "mark").agg(
        F.collect_list(F.struct("start", "n", "key", "hi", "lo", "copied")).alias("segments")
    )
    lists, n_rows = stage_counted(lists, "repeats-wanted")
    some = docs.join(small(lists.select("id", "mark"), n_rows), ["id", "mark"], "left_semi")
    once = some.select("id", "mark", "text").dropDuplicates(["id", "mark"])
    return once.join(lists, ["id", "mark"]).select("text", "segments")


def _cut_out(texts: DataFrame, width: int) -> DataFrame:
    """(key, hi, lo, copied, data) of the wanted segments."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in bounded(batch):
                rows = []
                for text, segments in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                    raw = text.encode()
                    rows += [
                        (s["key"], s["hi"], s["lo"], s["copied"], raw[s["start"] : s["start"] + s["n"] + width - 1])
                        for s in segments
                    ]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.record_batch(
                    [pa.array(c, f.type) for c, f in zip(columns, _DATA_TYPES, strict=True)], schema=_DATA_TYPES
                )

    return texts.mapInArrow(cut, "key BIGINT, hi BIGINT, lo BIGINT, copied BOOLEAN, data BINARY")


_DATA_TYPES = pa.schema(
    [("key", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("copied", pa.bool_()), ("data", pa.binary())]
)


def _single_windows(bytes_of: DataFrame, width: int) -> DataFrame:
    """(key, hi, lo, at, copied, w_hi, w_lo) of each window of the segments."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["data"]) - width + 1
                digests = [_digest(row["data"][i : i + width]) for i in range(n)]
                yield pa.RecordBatch.from_pydict(
                    {
                        **{c: [row[c]] * n for c in ("key", "hi", "lo", "copied")},
                        "at": range(n),
                        "w_hi": [hi for hi, _ in digests],
                        "w_lo": [lo for _, lo in digests],
                    },
                    schema=_WINDOW_TYPES,
                )

    return bytes_of.mapInArrow(
        each, "key BIGINT, hi BIGINT, lo BIGINT, copied BOOLEAN, at INT, w_hi BIGINT, w_lo BIGINT"
    )


_WINDOW_TYPES = pa.schema(
    [("key", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("copied", pa.bool_())]
    + [("at", pa.int32()), ("w_hi", pa.int64()), ("w_lo", pa.int64())]
)


def _compared_windows(bytes_of: DataFrame, width: int) -> DataFrame:
    """The verdicts of ``_sorted_shards`` for keys too large for one shard, by digests of windows."""
    windows, total = stage_counted(
        _single_windows(bytes_of.dropDuplicates(["key", "hi", "lo"]), width), "repeats-windows"
    )
    counts = windows.groupBy("w_hi", "w_lo").agg(
        F.count("*").alias("rows"), (F.count("*") + F.count_if("copied")).alias("places")
    )
    repeated = joined_by_size(windows, counts.filter("places > 1").drop("places"), ["w_hi", "w_lo"], "rows", total)
    return repeated.groupBy("key", "hi", "lo").agg(
        F.expr(f"CAST(collect_list(struct(at AS a, at + 1 AS b)) AS {_RANGES}) AS ranges")
    )


def repeated_starts(docs: DataFrame, rules: RepeatRules = RepeatRules()) -> DataFrame:
    """(id, mark, ranges): where repeated windows start in each text that has some.

    1. Each text is cut into segments of neighbouring windows with one key.
    2. Keys of one segment only, whose gram stands in it once, cannot repeat. Equal segments are
       counted: one of them stands for all.
    3. Segments of a key go to one shard. A shard's suffix array and its permuted common prefixes
       give the windows that start twice. A key with too many different
       segments for a shard has its windows compared by 128-bit digests instead.
    4. Verdicts go back to all places of a segment.

    ``docs`` are rows as ``_marked`` gives them.
    """
    width = rules.width
    segment = ["key", "hi", "lo"]
    sketched = stage(sketch(docs, rules), "repeats-sketch")
    rows = sketched.select("id", "mark", F.inline("segments"))
    keys = rows.groupBy("key").agg(F.count("*").alias("key_rows"), F.max("inner").alias("key_inner"))
    keys, _ = stage_counted(keys.filter("key_rows > 1 OR key_inner").drop("key_inner"), "repeats-keys")
    total = keys.agg(F.sum("key_rows")).first()[0] or 0
    places = stage(joined_by_size(rows, keys, ["key"], "key_rows", total).drop("key_rows"), "repeats-places")

    different = places.groupBy(*segment).agg(
        F.count("*").alias("copies"),
        F.max("inner").alias("inner"),
        *(F.first(c).alias(c) for c in ("id", "mark", "start", "n")),
    )
    different = stage(different, "repeats-segments")
    by_key = different.groupBy("key").agg(
        F.count("*").alias("key_rows"),
        F.max("inner").alias("key_inner"),
        F.sum(F.col("n") + width - 1).alias("key_bytes"),
    )
    by_key, n_keys = stage_counted(
        by_key.filter("key_rows > 1 OR key_inner").drop("key_inner"), "repeats-shared"
    )
    copied = (F.col("copies") > 1).alias("copied")
    wanted = joined_by_size(
        different.select(*segment, "id", "mark", "start", "n", copied), by_key, ["key"], "key_rows", total
    )
    whole = different.filter("copies > 1").select(
        *segment, F.expr(f"CAST(array(struct(0 AS a, n AS b)) AS {_RANGES}) AS ranges")
    )
    verdicts = whole.join(by_key.select("key"), "key", "left_anti") if n_keys else whole
    sums = by_key.agg(
        F.sum(F.when(F.col("key_bytes") <= rules.key_bytes, F.col("key_bytes"))),
        F.count_if(F.col("key_bytes") > rules.key_bytes),
    ).first()
    for is_large, needed in ((False, sums[0]), (True, sums[1])):
        if needed:
            chosen = wanted.filter((F.col("key_bytes") > rules.key_bytes) == F.lit(is_large))
            bytes_of = _cut_out(_texts_with(docs, chosen), width)
            if is_large:
                found = _compared_windows(bytes_of, width)
            else:
                found = _sorted_shards(bytes_of, -(-needed // rules.shard_bytes), width)
            verdicts = verdicts.unionByName(found)
    sized = verdicts.join(different.select(*segment, "copies"), segment)
    sized = stage(sized, "repeats-verdicts")
    ranged = joined_by_size(places.drop("inner", "n"), sized, segment, "copies", total)
    spread = ranged.select("id", "mark", "start", F.inline("ranges")).select(
        "id", "mark", F.expr("struct(start + a AS a, start + b AS b) AS range")
    )
    return spread.groupBy("id", "mark").agg(F.collect_set("range").alias("ranges"))


_KEPT = "doc_id BIGINT, n_bytes BIGINT, spans ARRAY<STRUCT<start: BIGINT, end: BIGINT>>, kept BINARY"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def without_repeats(docs: DataFrame, rules: RepeatRules = RepeatRules()) -> DataFrame:
    """Every text without the bytes that a repeated string of ``width`` bytes covers.

    Returns doc_id, n_bytes, spans (maximal removed stretches of bytes, end exclusive)
    and kept (the other bytes, joined; these may cut a character). A string is repeated if it
    starts at another place of any text as well, the same text included, overlaps too; all
    are judged on the texts as given, so no copy is spared. Matches lie within a
    text. A null text counts as an empty one. Texts shorter than ``width`` stay whole.
    Repeated rows each give a row, and repeat each other; so do rows with null ids.
    """
    marked = _marked(docs)
    found = repeated_starts(marked, rules)
    joined = marked.join(found, ["id", "mark"], "left").select("doc_id", "text", "ranges")

    def remove(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, spans, kept = [], [], []
        for text, ranges in zip(*(batch.column(c).to_pylist() for c in ("text", "ranges")), strict=True):
            raw = (text or "").encode()
            gone = _covered(ranges or [], rules.width)
            edges = [0, *(place for span in gone for place in span), len(raw)]
            sizes.append(len(raw))
            spans.append([{"start": a, "end": b} for a, b in gone])
            kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, _SPANS), pa.array(kept, pa.binary())],
            names=["doc_id", "n_bytes", "spans", "kept"],
        )

    return in_pieces(joined, remove, _KEPT)


def _covered(ranges: list[dict], width: int) -> list[tuple[int, int]]:
    """The stretches of bytes that windows starting in the ranges cover."""
    spans: list[tuple[int, int]] = []
    for a, b in sorted((r["a"], r["b"] - 1 + width) for r in ranges):
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    return spans


def removal_counts(cleaned: DataFrame) -> DataFrame:
    """How much was removed of each text, and a checksum of the rest."""
    return cleaned.select(
        "doc_id",
        "n_bytes",
        F.expr("n_bytes - octet_length(kept) AS n_removed"),
        F.expr("CAST(size(spans) AS BIGINT) AS n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
