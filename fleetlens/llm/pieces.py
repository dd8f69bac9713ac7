"""SentencePiece encoding and decoding over a relational lattice of pieces."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from fleetlens.llm.texts import bounded_batches
from fleetlens.llm.texts import pieces as bounded
from fleetlens.sources.sinks import stage, stage_bucketed

BLANK = "▁"

# Longest segment that the lattice takes: one bit for each place between its
# characters must fit a signed 64-bit number.
LATTICE_CHARS = 62

# A part of the texts ends behind so many bytes; so many are cut together.
PART_BYTES = 12 << 20
_CUT_BYTES = 1 << 20

# Segments of parts for each partition that they are dealt to, and most partitions.
PARTITION_WORDS = 50_000
MAX_PARTITIONS = 20_000

# Segments with ids that are packed together.
_PACKED_WORDS = 1 << 19


@cache
def _vocabulary(path: str) -> tuple[list[str], list[float], dict[int, int], dict[int, int]]:
    """Pieces by id, scores by id, byte -> id and id -> byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.vocab_size())]
    scores = [model.get_score(i) for i in range(len(names))]
    bytes_of = {i: int(names[i][3:5], 16) for i in range(len(names)) if model.is_byte(i)}
    for i in range(len(names)):
        if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            names[i] = ""
    return names, scores, {b: i for i, b in bytes_of.items()}, bytes_of


@cache
def _ranked(path: str) -> dict[str, tuple[float, int]]:
    """piece -> (score, id)"""
    names, scores, _, _ = _vocabulary(path)
    return {name: (scores[i], i) for i, name in enumerate(names) if name}


# Bits of an edge, low to high: id (or a code point and a mark), late, start, rank. So
# edges sort by rank, then from the left.
_CODE_POINT = 1 << 21
_LATE_AT, _START_AT, _RANK_AT = 22, 23, 29


def piece_rows(path: str) -> list[tuple[str, int]]:
    """(piece, code) of every ordinary piece; the code is its edge without a place.

    Ranks number the scores from the best one down. ``late`` marks a piece that is a part
    of another one with an equal or better score. Where such a piece is made, a better
    one may become possible afterwards.
    """
    known = _ranked(path)
    late = set()
    for piece, (score, _) in known.items():
        for cut in range(1, len(piece)):
            parts = piece[:cut], piece[cut:]
            if all(len(part) == 1 or part in known for part in parts):
                late.update(p for p in parts if len(p) > 1 and known[p][0] <= score)
    best_first = sorted({score for score, _ in known.values()}, reverse=True)
    ranks = {score: rank for rank, score in enumerate(best_first)}
    return [
        (p, ranks[score] << _RANK_AT | (p in late) << _LATE_AT | i)
        for p, (score, i) in known.items()
    ]


@cache
def _joints(path: str) -> tuple[np.ndarray, np.ndarray]:
    """A class for each character, and which classes stand side by side in some piece.

    Characters in no piece are of class 0.
    """
    pairs = {(ord(a), ord(b)) for piece in _ranked(path) for a, b in zip(piece, piece[1:], strict=False)}
    seen = sorted({code for pair in pairs for code in pair})
    classes = np.zeros(0x110000, np.int32)
    classes[seen] = np.arange(1, len(seen) + 1)
    joined = np.zeros((len(seen) + 1, len(seen) + 1), bool)
    for a, b in pairs:
        joined[classes[a], classes[b]] = True
    return classes, joined


def segments(texts: list[str | None], path: str) -> tuple[pa.StringArray, np.ndarray]:
    """Cut texts, with blanks marked, between characters that no piece holds together.

    No piece reaches over such a cut, so the segments are encoded one by one. Returns the
    segments of all texts, in order, and their number in each text.
    """
    marked = [BLANK + text.replace(" ", BLANK) if text else "" for text in texts]
    ends = np.cumsum([0, *map(len, marked)])
    whole = "".join(marked)
    codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    classes, joined = _joints(path)
    of = classes[codes]
    is_cut = np.ones(len(codes) + 1, bool)
    is_cut[1:-1] = ~joined.ravel()[of[:-1] * len(joined) + of[1:]]
    is_cut[ends] = True
    cuts = np.flatnonzero(is_cut[:-1])
    raw = np.frombuffer(whole.encode(), np.uint8)
    first_bytes = np.flatnonzero((raw & 0xC0) != 0x80)
    offsets = np.append(first_bytes[cuts], len(raw)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(cuts), pa.py_buffer(offsets), pa.py_buffer(raw))
    return words, np.diff(np.searchsorted(cuts, ends))


_PARTS = (
    "part BIGINT, doc_ids ARRAY<BIGINT>, sizes ARRAY<INT>, codes BINARY, first INT, words ARRAY<STRING>"
)
_PART_TYPES = pa.schema(
    [
        ("part", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("sizes", pa.list_(pa.int32())),
        ("codes", pa.binary()),
        ("first", pa.int32()),
        ("words", pa.list_(pa.string())),
    ]
)


def _packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers as planes of bytes, compressed."""
    planes = np.asarray(numbers, "<i4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(planes.tobytes())


def _unpacked(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, len(planes) // 4).T).view("<i4").ravel()


def _part_rows(
    part: int, doc_ids: list[list], sizes: list[np.ndarray], found: list[pa.DictionaryArray]
) -> Iterator[pa.RecordBatch]:
    """The rows of a part: its texts as numbers, and its segments, the most frequent first.

    ``found`` has the segments that were cut together, each time with a dictionary of their own.
    """
    coded = pa.concat_arrays([some.dictionary for some in found]).dictionary_encode()
    words, numbers = coded.dictionary, np.asarray(coded.indices)
    ends = np.cumsum([0, *(len(some.dictionary) for some in found)])
    numbers = [numbers[a:b][np.asarray(f.indices)] for a, b, f in zip(ends, ends[1:], found, strict=False)]
    found.clear()
    counts = sum(np.bincount(some, minlength=len(words)) for some in numbers)
    counted = pa.table({"count": counts, "word": words})
    order = pa.compute.sort_indices(counted, [("count", "descending"), ("word", "ascending")])
    rank = np.empty(len(words), np.int32)
    rank[np.asarray(order)] = np.arange(len(words), dtype=np.int32)
    for ids, lengths, some in zip(doc_ids, sizes, numbers, strict=True):
        row = {"part": part, "doc_ids": ids, "sizes": lengths, "codes": _packed(rank[some])}
        yield pa.RecordBatch.from_pylist([row], schema=_PART_TYPES)
    words = words.take(order)
    for first in range(0, len(words), PARTITION_WORDS):
        row = {"part": part, "first": first, "words": words.slice(first, PARTITION_WORDS).to_pylist()}
        yield pa.RecordBatch.from_pylist([row], schema=_PART_TYPES)


def _in_parts(docs: DataFrame, path: str) -> DataFrame:
    """Texts as numbers of their segments, a row for about a megabyte, and the numbered segments.

    Numbers hold within a part, which is texts of one task up to ``PART_BYTES``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        doc_ids, sizes, found, n_bytes = [], [], [], 0
        for batch in batches:
            for piece in bounded(batch, most=_CUT_BYTES):
                words, lengths = segments(piece.column("text").to_pylist(), path)
                doc_ids.append(piece.column("doc_id").to_pylist())
                sizes.append(lengths)
                found.append(words.dictionary_encode())
                n_bytes += piece.column("text").nbytes
                if n_bytes >= PART_BYTES:
                    yield from _part_rows(part, doc_ids, sizes, found)
                    pa.default_memory_pool().release_unused()
                    part += 1
                    doc_ids, sizes, found, n_bytes = [], [], [], 0
        if found:
            yield from _part_rows(part, doc_ids, sizes, found)

    bounded_batches(docs.sparkSession)
    columns = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return columns.mapInArrow(run, _PARTS)


def lattice(words: DataFrame, table: DataFrame, keys: list[str], longest: int) -> DataFrame:
    """Edges of each word: (keys, edges), an edge being three numbers.

    ``words`` has the keys, ``word`` and ``n``, its 1 to ``LATTICE_CHARS`` characters. Every
    substring of up to ``longest`` characters meets the piece table; a single
    character without a piece stays as an edge with its code point. Places are bits:
    ``ends`` has those of the edge's two ends, ``inner`` those between. The table is that
    of one model file, some ten thousand rows, and is sent to all tasks.
    """
    spans = (
        words.withColumn("a", F.expr("explode(sequence(0, n - 1))"))
        .withColumn("size", F.expr(f"explode(sequence(1, least({longest}, n - a)))"))
        .withColumn("piece", F.expr("substring(word, a + 1, size)"))
    )
    met = spans.join(F.broadcast(table), "piece", "left").filter("code IS NOT NULL OR size = 1")
    end = "(a + size)"
    edges = met.select(
        *keys,
        F.expr(
            f"coalesce(code, ascii(piece) | {_CODE_POINT}L) | "
            f"shiftleft(CAST(a AS BIGINT), {_START_AT}) AS edge"
        ),
        F.expr(f"(shiftleft(1L, {end}) - 1) & ~(shiftleft(2L, a) - 1) AS inner"),
        F.expr(f"shiftleft(1L, a) | shiftleft(1L, {end}) AS ends"),
    )
    return edges.groupBy(*keys).agg(
        F.collect_list(F.struct("edge", "inner", "ends")).alias("edges")
    )


def folded(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ids): the path through each word's lattice that the merges end in.

    The state of the fold is the set of places between pieces, at first all of them. An
    edge can be taken if both its ends are such places and exactly one lies between
    them; it removes that one. Edges go by score, then from the left. One pass takes
    each edge once; only where it made a ``late`` piece is the fold done again
    by steps that each look for the best edge anew. A code point without a piece
    becomes a negative id, its value negated, less one.
    """
    can = "(s.b & e.ends) = e.ends AND bit_count(s.b & e.inner) = 1"
    once = (
        "aggregate(merges, named_struct('b', full, 'again', false), (s, e) -> "
        f"IF({can}, named_struct('b', s.b & ~e.inner, 'again', s.again OR getbit(e.edge, {_LATE_AT}) = 1), s))"
    )
    best = "filter(merges, e -> (b & e.ends) = e.ends AND bit_count(b & e.inner) = 1)"
    steps = (
        "aggregate(merges, full, (b, i) -> "
        f"b & ~coalesce(get({best}, 0).inner, 0L))"
    )
    taken = "filter(edges, e -> (places & e.ends) = e.ends AND (places & e.inner) = 0)"
    id_of = (
        f"IF(getbit(e.edge, 21) = 1, -1 - CAST(e.edge & {_CODE_POINT - 1} AS INT), "
        f"CAST(e.edge & {_CODE_POINT - 1} AS INT))"
    )
    return (
        edges.withColumn("merges", F.expr("sort_array(filter(edges, e -> e.inner <> 0))"))
        .withColumn("full", F.expr("aggregate(edges, 0L, (b, e) -> b | e.ends)"))
        .withColumn("once", F.expr(once))
        .withColumn("places", F.expr(f"IF(once.again, {steps}, once.b)"))
        .select(
            *keys,
            F.expr(
                f"transform(sort_array(transform({taken}, e -> struct(e.ends, {id_of} AS id))), x -> x.id)"
            ).alias("ids"),
        )
    )


def merged(word: str, path: str) -> list[int]:
    """The same path for one word longer than the lattice takes: best pair first."""
    import heapq

    known = _ranked(path)
    parts = list(word)
    before = list(range(-1, len(parts) - 1))
    behind = list(range(1, len(parts) + 1))
    waiting: list[tuple[float, int, str]] = []

    def offer(i: int) -> None:
        j = behind[i]
        if i >= 0 and j < len(parts):
            both = parts[i] + parts[j]
            if both in known:
                heapq.heappush(waiting, (-known[both][0], i, both))

    for i in range(len(parts)):
        offer(i)
    while waiting:
        _, i, both = heapq.heappop(waiting)
        j = behind[i]
        if not parts[i] or j >= len(parts) or parts[i] + parts[j] != both:
            continue
        parts[i], parts[j] = both, ""
        behind[i] = behind[j]
        if behind[j] < len(parts):
            before[behind[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [known[p][1] if p in known else -1 - ord(p) for p in parts if p]


def _with_bytes(ids: np.ndarray, sizes: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Replace negated code points in lists of ids, joined, by the ids of their UTF-8 bytes."""
    unknown = ids < 0
    if not unknown.any():
        return ids, sizes
    byte_ids = _vocabulary(path)[2]
    made = [[byte_ids[b] for b in chr(-1 - i).encode()] for i in ids[unknown].tolist()]
    widths = np.ones(len(ids), np.int64)
    widths[unknown] = [len(m) for m in made]
    longer = np.repeat(ids, widths)
    longer[np.repeat(unknown, widths)] = [i for m in made for i in m]
    reached, ends = np.append(0, np.cumsum(widths)), np.cumsum(np.append(0, sizes))
    return longer, np.diff(reached[ends])


def _piece_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame(piece_rows(path), "piece STRING, code BIGINT")


_IDS = pa.list_(pa.int32())
_KNOWN = "of BIGINT, at BINARY, sizes BINARY, ids BINARY"


def _packed_known(known: DataFrame, path: str) -> DataFrame:
    """(of, at, ids) rows as few rows: of each part some places, and the ids for each of them.

    A word without ids is too long for the lattice and is merged here.
    """

    def pack(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(some)
        if table["ids"].null_count:
            long = table.filter(table["word"].is_valid())
            ids = pa.array([merged(word, path) for word in long["word"].to_pylist()], _IDS)
            long = long.set_column(2, "ids", ids)
            table = pa.concat_tables([table.filter(table["word"].is_null()), long])
        table = table.take(pa.compute.sort_indices(table, [("of", "ascending"), ("at", "ascending")]))
        table = table.combine_chunks()
        of, at = np.asarray(table["of"]), np.asarray(table["at"])
        lists = table["ids"].combine_chunks()
        sizes = np.asarray(pa.compute.list_value_length(lists))
        ids, sizes = _with_bytes(np.asarray(lists.flatten()), sizes, path)
        reached = np.cumsum(np.append(0, sizes))
        cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
        rows = [
            (
                int(of[a]),
                _packed(np.diff(at[a:b], prepend=0)),
                _packed(sizes[a:b]),
                _packed(ids[reached[a] : reached[b]]),
            )
            for a, b in zip(cuts, cuts[1:], strict=False)
        ]
        return pa.RecordBatch.from_pylist(
            [dict(zip(("of", "at", "sizes", "ids"), row, strict=True)) for row in rows]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, n_rows = [], 0
        for batch in batches:
            some.append(batch)
            n_rows += batch.num_rows
            if n_rows >= _PACKED_WORDS:
                yield pack(some)
                some, n_rows = [], 0
        if n_rows:
            yield pack(some)

    too_long = F.when(F.col("ids").isNull(), F.col("word")).alias("word")
    return known.select("of", "at", "ids", too_long).mapInArrow(run, _KNOWN)


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every text under a SentencePiece BPE model file.

    Texts are cut where no piece can reach over. The distinct segments of all texts are the
    words of the lattice; each is looked up, grouped and folded into ids once. Texts are kept as numbers of
    their segments, by parts of bounded size; a word meets a part at most once, so that
    no word is frequent enough to be hot. Each part then gets the ids of its words, and its texts are
    put together from them. Parts are staged in buckets and do not move again. Characters
    without a piece become the pieces of their UTF-8 bytes.

    A null or empty text has no ids. Repeated rows each give a row. A segment of more
    than ``LATTICE_CHARS`` characters, which is rare, is merged by a plain helper. The
    model file must be at the same path on all machines. Building it stages the numbered texts.
    """
    spark = docs.sparkSession
    table = stage(_piece_table(spark, model_path), "pieces")
    longest = max(len(row[0]) for row in piece_rows(model_path))
    n_buckets = min(MAX_PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = stage_bucketed(_in_parts(docs, model_path), "piece-parts", "part", n_buckets)
    n_words = parts.agg(F.sum(F.size("words"))).first()[0] or 0
    n_partitions = min(MAX_PARTITIONS, -(-n_words // PARTITION_WORDS)) or 1
    places = (
        parts.filter("words IS NOT NULL")
        .select("part", "first", F.posexplode("words").alias("at", "word"))
        .select(F.col("part").alias("of"), F.expr("first + at AS at"), "word")
        .filter("word IS NOT NULL")
        .repartition(n_partitions, "word")
    )
    # The least places are never below zero. They keep the columns that the join below reads,
    # so that one shuffle serves both.
    words = places.groupBy("word").agg(
        F.max(F.char_length("word")).alias("n"),
        F.min("of").alias("of"),
        F.min("at").alias("at"),
    )
    words = words.filter(f"of >= 0 AND at >= 0 AND n <= {LATTICE_CHARS}").select("word", "n")
    coded = folded(lattice(words, table, ["word"], longest), ["word"])
    known = _packed_known(places.join(coded.hint("shuffle_hash"), "word", "left"), model_path)
    texts = parts.filter("codes IS NOT NULL").select("part", "doc_ids", "sizes", "codes")

    def assemble(numbered: pa.Table, words: pa.Table) -> pa.Table:
        packed = [[_unpacked(x) for x in words[c].to_pylist()] for c in ("at", "sizes", "ids")]
        at = np.concatenate([np.empty(0, np.int64), *map(np.cumsum, packed[0])])
        lengths = np.concatenate([np.empty(0, np.int64), *packed[1]])
        sizes, starts = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        sizes[at] = lengths
        starts[at] = np.cumsum(lengths) - lengths
        ids = np.concatenate([np.empty(0, np.int32), *packed[2]])
        made = [_assembled(row, starts, sizes, ids) for row in numbered.to_pylist()]
        return pa.Table.from_batches(made)

    return (
        texts.groupBy("part")
        .cogroup(known.groupBy("of"))
        .applyInArrow(assemble, "doc_id BIGINT, n_tokens BIGINT, ids ARRAY<INT>")
    )


def _assembled(row: dict, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """Some texts as ids: those of word k are ``sizes[k]`` from ``starts[k]`` on."""
    codes = _unpacked(row["codes"])
    n_ids = sizes[codes]
    reached = np.append(0, np.cumsum(n_ids))
    where = np.repeat(starts[codes] - reached[:-1], n_ids) + np.arange(reached[-1])
    tokens = ids[where]
    counts = np.asarray(row["sizes"], np.int64)
    bounds = reached[np.append(0, np.cumsum(counts))]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(row["doc_ids"], pa.int64()),
            pa.array(np.diff(bounds), pa.int64()),
            pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(tokens, pa.int32())),
        ],
        names=["doc_id", "n_tokens", "ids"],
    )


def decoded_text(ids: list[int], path: str) -> str:
    """The text of ids: pieces joined, bytes put together, blanks unmarked.

    The blank that encoding puts in front is taken away. Bytes that are no UTF-8 become
    replacement characters.
    """
    names, _, _, bytes_of = _vocabulary(path)
    if bytes_of.keys().isdisjoint(ids):
        text = "".join(map(names.__getitem__, ids))
    else:
        raw = b"".join(
            bytes([bytes_of[i]]) if i in bytes_of else names[i].encode("utf-8") for i in ids
        )
        text = raw.decode("utf-8", "replace")
    return text.replace(BLANK, " ").removeprefix(" ")


# Ids that are decoded together.
_DECODED_IDS = 1 << 20


@cache
def _raw_pieces(path: str) -> pa.BinaryArray:
    """The UTF-8 bytes of each piece by id."""
    names, _, _, bytes_of = _vocabulary(path)
    raw = [bytes([bytes_of[i]]) if i in bytes_of else name.encode() for i, name in enumerate(names)]
    return pa.array(raw, pa.binary())


def _texts(lists: pa.ListArray, path: str) -> pa.Array:
    """The texts of lists of ids, as ``decoded_text`` gives them."""
    lengths = pa.compute.fill_null(pa.compute.list_value_length(lists), 0)
    ends = np.append(0, np.cumsum(np.asarray(lengths, np.int64)))
    taken = _raw_pieces(path).take(lists.flatten())
    # The pieces stand one behind the other already; only the ends of texts are left.
    _, offsets, data = taken.buffers()
    places = np.frombuffer(offsets, np.int32, len(taken) + 1, taken.offset * 4)[ends]
    raw = pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(places), data])
    raw = pa.compute.replace_substring(raw, BLANK.encode(), b" ")
    try:
        texts = raw.cast(pa.string())
    except pa.ArrowInvalid:
        texts = pa.array([text.decode("utf-8", "replace") for text in raw.to_pylist()], pa.string())
    stripped = pa.compute.utf8_slice_codeunits(texts, 1)
    texts = pa.compute.if_else(pa.compute.starts_with(texts, " "), stripped, texts)
    return pa.compute.if_else(lists.is_null(), pa.scalar(None, pa.string()), texts)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """Add ``text``, the text that the ids stand for; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pa.compute.fill_null(pa.compute.list_value_length(batch.column("ids")), 0)
            ends = np.cumsum(np.asarray(lengths, np.int64))
            start = 0
            while start < batch.num_rows:
                before = ends[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(ends, before + _DECODED_IDS, "right")))
                some = batch.slice(start, end - start)
                texts = _texts(some.column("ids"), model_path)
                yield pa.RecordBatch.from_arrays(
                    [*some.columns, texts], names=[*some.schema.names, "text"]
                )
                start = end

    kept = encoded.drop("text") if "text" in encoded.columns else encoded
    schema = StructType([*kept.schema.fields, StructField("text", StringType())])
    return kept.mapInArrow(run, schema)
