"""Token counts of texts under a tokenizer file."""

from __future__ import annotations

import os
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.texts import in_pieces

# Units after which a worker forgets what it has encoded, and the longest unit
# that it remembers beyond a piece. Both only bound memory.
REMEMBERED_UNITS = 400_000
REMEMBERED_CHARS = 64

# UTF-8 bytes, about, that the library encodes in one call. It keeps some
# hundred bytes for each token until the call ends.
ENCODE_BYTES = 256 << 10

_COUNTS = "doc_id BIGINT, n_bytes BIGINT, n_tokens BIGINT"


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def split_safely(text: str) -> list[str]:
    """Cut a text where its token counts add up.

    Every unit but the first begins with a blank that follows another character
    than white space. Byte-level pre-tokens hold white space at their start only,
    so none spans such a place, and neither does a special string without blanks.
    The units joined are the text.
    """
    first, *rest = text.split(" ")
    units = [first]
    for part in rest:
        last = units[-1][-1:]
        if last and not last.isspace():
            units.append(" " + part)
        else:
            units[-1] += " " + part
    return units


def _encode_lengths(path: str, units: list[str]) -> list[int]:
    """Token counts of units, encoded in batches of about equal bytes."""
    encode = _tokenizer(path).encode_batch_fast
    lengths: list[int] = []
    batch: list[str] = []
    size = 0
    for unit in units:
        batch.append(unit)
        size += len(unit)
        if size >= ENCODE_BYTES:
            lengths += [len(e.ids) for e in encode(batch, add_special_tokens=False)]
            batch, size = [], 0
    if batch:
        lengths += [len(e.ids) for e in encode(batch, add_special_tokens=False)]
    return lengths


def token_counts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every text, for a byte-level BPE file.

    Texts are cut at blanks where counts add up. A unit that occurs often is
    encoded once per worker and batch, and only its length is kept. Special strings
    inside a text count as the library counts them by default; none are added.
    A null text counts as an empty one, a null ``doc_id`` stays null, and
    repeated rows each give a row. A text without a blank is one unit.
    The tokenizer file must be at the same path on all machines.
    """

    known: dict[str, int] = {}

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [text or "" for text in batch.column("text").to_pylist()]
        units = [split_safely(text) for text in texts]
        if len(known) > REMEMBERED_UNITS:
            known.clear()
        new = list({unit for of_text in units for unit in of_text if unit not in known})
        known.update(zip(new, _encode_lengths(tokenizer_path, new), strict=True))
        n_tokens = [sum(map(known.__getitem__, of_text)) for of_text in units]
        for unit in new:
            if len(unit) > REMEMBERED_CHARS:
                del known[unit]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(text.encode()) for text in texts], pa.int64()),
                pa.array(n_tokens, pa.int64()),
            ],
            names=["doc_id", "n_bytes", "n_tokens"],
        )

    columns = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return in_pieces(columns, count, _COUNTS)


def with_limit(counts: DataFrame, limit: int) -> DataFrame:
    """Mark the texts that hold more tokens than a limit."""
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
