"""Quality rules: figures of a text, and a log-likelihood ratio of hashed n-grams."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.texts import byte_words, in_pieces, mixed

# The base rules of the query's contract.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# Most trusted ids that go to all tasks: 32 MB of numbers.
BROADCAST_IDS = 4_000_000

_SYMBOLS = re.compile(rb"[#*$%&|<>]")
_BLANK_LIKE = np.zeros(256, bool)
_BLANK_LIKE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_BASE = ", ".join(f"{name} BIGINT" for name in _NAMES)


@dataclass(frozen=True)
class QualityRules:
    """Parameters of the ratio.

    ``gram`` is the length of the n-grams in bytes of UTF-8 and ``buckets`` the size
    of both multinomials (a power of two, which bounds all that reaches the driver).
    ``smoothing`` is added to the count that each bucket has in the target and to the
    one that the raw multinomial lets expect there, so rare n-grams say little. Texts
    whose mean log ratio per n-gram is below ``min_ratio`` are rejected.
    """

    gram: int = 3
    buckets: int = 1 << 16
    smoothing: float = 1.0
    min_ratio: float = -0.6


def _repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words which occurs twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    pairs = np.unique(at[:-1] * len(ids) + at[1:], return_inverse=True)[1]
    triples = pairs[:-1] * len(ids) + at[2:]
    _, where, times = np.unique(triples, return_inverse=True, return_counts=True)
    again = times[where] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + n] |= again
    return int(covered.sum())


def _figures(text: bytes) -> tuple[int, int, int, int, int]:
    words = byte_words(text)
    lines = [line for line in text.split(b"\n") if line.split()]
    chars = sum(len(w) for w in words) - sum(map(_continuations, words))
    return (
        len(words),
        chars,
        len(_SYMBOLS.findall(text)),
        len(lines) - len(set(lines)),
        _repeated_words(words),
    )


def _continuations(word: bytes) -> int:
    """Bytes of a word that do not begin a code point."""
    return 0 if word.isascii() else len(word) - len(word.decode())


def _grams(text: bytes, rules: QualityRules) -> np.ndarray:
    """Bucket of each n-gram of the text, with white space as one blank."""
    codes = np.frombuffer(b" ".join([b"", *byte_words(text), b""]), np.uint8).astype(np.uint64)
    n = len(codes) - rules.gram + 1
    if n < 1 or not text.strip():
        return np.empty(0, np.int64)
    gram = np.zeros(n, np.uint64)
    for shift in range(rules.gram):
        gram = (gram << np.uint64(8)) | codes[shift : shift + n]
    return (mixed(gram) & np.uint64(rules.buckets - 1)).astype(np.int64)


def _bucket_counts(docs: DataFrame, rules: QualityRules) -> DataFrame:
    """(bucket, raw, target): n-grams of all texts and of the trusted ones."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums = np.zeros((2, rules.buckets), np.int64)
        flags = batch.column("trusted").to_pylist()
        for text, flag in zip(batch.column("text").to_pylist(), flags, strict=True):
            found = np.bincount(_grams(text.encode(), rules), minlength=rules.buckets)
            sums[0] += found
            if flag:
                sums[1] += found
        used = np.flatnonzero(sums[0])
        arrays = [pa.array(x, pa.int64()) for x in (used, sums[0][used], sums[1][used])]
        return pa.RecordBatch.from_arrays(arrays, names=["bucket", "raw", "target"])

    parts = in_pieces(docs, count, "bucket BIGINT, raw BIGINT, target BIGINT")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def _counted(docs: DataFrame, trusted: DataFrame, rules: QualityRules) -> DataFrame:
    """(bucket, raw, target) of all texts, of which the trusted ids name some."""
    ids = trusted.select(F.col("doc_id").cast("bigint").alias("id")).filter("id IS NOT NULL").distinct()
    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("id"), F.coalesce("text", F.lit("")).alias("text")
    )
    if ids.count() <= BROADCAST_IDS:
        marked = texts.join(F.broadcast(ids.withColumn("trusted", F.lit(True))), "id", "left")
        return _bucket_counts(marked.select("text", F.expr("trusted IS NOT NULL AS trusted")), rules)
    # The raw counts need no ids; only the trusted texts are looked for, and counted apart.
    raw = _bucket_counts(texts.select("text", F.lit(False).alias("trusted")), rules)
    found = texts.join(ids, "id", "left_semi").select("text", F.lit(True).alias("trusted"))
    target = _bucket_counts(found, rules)
    none = F.lit(0).cast("bigint")
    both = raw.select("bucket", "raw", none.alias("target")).union(
        target.select("bucket", none.alias("raw"), "target")
    )
    return both.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(
    docs: DataFrame, trusted: DataFrame, rules: QualityRules = QualityRules()
) -> np.ndarray | None:
    """Smoothed log(p_target / p_raw) of each bucket; None if no trusted text is found.

    The raw multinomial counts every text, the target every trusted one. One row per
    bucket reaches the driver. Up to ``BROADCAST_IDS`` trusted ids go to all tasks, and no text is
    shuffled; more are joined by a shuffle for the target, but not for the raw counts.
    """
    counts = np.zeros((2, rules.buckets))
    for bucket, raw, target in _counted(docs, trusted, rules).collect():
        counts[:, bucket] = raw, target
    if not counts[1].any():
        return None
    raw, target = counts
    expected = raw * (target.sum() / raw.sum())
    return np.log(target + rules.smoothing) - np.log(expected + rules.smoothing)


def _weights(docs: DataFrame, trusted: DataFrame, rules: QualityRules) -> np.ndarray:
    ratios = log_ratios(docs, trusted, rules)
    return np.zeros(rules.buckets, np.float32) if ratios is None else ratios.astype(np.float32)


def _verdicts(batch: pa.RecordBatch, weights: np.ndarray, rules: QualityRules) -> pa.RecordBatch:
    figures, scores = [], []
    for text in batch.column("text").to_pylist():
        encoded = (text or "").encode()
        figures.append(_figures(encoded))
        grams = _grams(encoded, rules)
        scores.append(float(weights[grams].mean(dtype=np.float64)) if len(grams) else 0.0)
    columns = np.array(figures, np.int64).reshape(-1, 5)
    n_words, repeated = columns[:, 0], columns[:, 4]
    failed = (n_words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n_words)
    score = np.array(scores)
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"),
            *(pa.array(column) for column in columns.T),
            pa.array(failed),
            pa.array(score),
            pa.array(~failed & (score >= rules.min_ratio)),
        ],
        names=["doc_id", *_NAMES, "base_failed", "score", "kept"],
    )


def quality_rules(
    docs: DataFrame, trusted: DataFrame, rules: QualityRules = QualityRules()
) -> DataFrame:
    """Figures, score and verdict of every text.

    ``trusted`` holds the ids of documents known to be good. Returns doc_id,
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score
    (mean log ratio per n-gram) and kept. Building it counts the n-grams of all
    texts, which is one pass; the result is a second, lazy one.

    A null or empty text has no words and fails the base rules; its score is 0. With
    no trusted text the score is 0 and only the base rules decide. Repeated rows
    each give a row.
    """
    weights = _weights(docs, trusted, rules)

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        return _verdicts(batch, weights, rules)

    schema = f"doc_id BIGINT, {_BASE}, base_failed BOOLEAN, score DOUBLE, kept BOOLEAN"
    columns = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return in_pieces(columns, judge, schema)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of the documents that the labels call good."""
    return labels.filter("quality = 1").select("doc_id")


def accepted(docs: DataFrame, trusted: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows that are kept, with all their columns. The verdict is a function of the text."""
    weights = _weights(docs, trusted, rules)

    def choose(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(_verdicts(batch, weights, rules).column("kept"))

    return in_pieces(docs, choose, docs.schema)
