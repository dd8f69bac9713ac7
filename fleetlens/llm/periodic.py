"""Periodic runs: stretches of words that repeat themselves at a fixed lag."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.texts import byte_words, in_pieces

# A run has this many words and this many of its periods, or more.
MIN_WORDS = 6
MIN_PERIODS = 4

_SCHEMA = (
    "doc_id BIGINT, n_words BIGINT, "
    "runs ARRAY<STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>>, collapsed STRING"
)


def runs_of(names: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of several sequences that stand one behind the other.

    A sparse diagonal DP. A lag between g/2 and g is followed on the scale of g words, g
    a power of two: each place looks up the nearest earlier place with the same g words.
    If its lag is that of the place before, the diagonal grows by one word, else the
    diagonal ends and, if long enough, is a run. Inside a run of period d <= g the same g
    words stand at multiples of d only, so the nearest earlier place is at lag d all
    along, whereas a multiple of a shorter period never shows. So all runs are found, each once,
    by one active lag per scale, where a look at all earlier places of a word would be
    quadratic. Places whose words stand nowhere else in their sequence drop out of the
    larger scales.
    """
    ends = np.cumsum(sizes)
    sequence = np.repeat(np.arange(len(sizes)), sizes)
    end_of = ends[sequence]
    size_of = np.asarray(sizes)[sequence]
    places = np.arange(len(names))
    keys = (sequence << 32) | names
    found = []
    g = 1
    while True:
        wanted = size_of[places] >= MIN_PERIODS * (g // 2 + 1)
        places, keys = places[wanted], keys[wanted]
        if not len(places):
            break
        order = np.argsort(keys, kind="stable")
        seen = np.zeros(len(keys), bool)
        seen[1:] = keys[order[1:]] == keys[order[:-1]]
        lags = np.zeros(len(places), np.int64)
        lags[order[1:]] = np.where(seen[1:], places[order[1:]] - places[order[:-1]], 0)
        found.append(_ended(places, lags, g))

        again = seen.copy()
        again[:-1] |= seen[1:]
        scale_names = np.empty(len(keys), np.int64)
        scale_names[order] = np.cumsum(~seen)
        kept = np.zeros(len(keys), bool)
        kept[order] = again
        name_at = np.full(len(names), -1, np.int64)
        name_at[places[kept]] = scale_names[kept]
        places = places[kept]
        places = places[places + 2 * g <= end_of[places]]
        places = places[name_at[places + g] >= 0]
        keys = (name_at[places] << 32) | name_at[places + g]
        g *= 2
    if not found:
        return (np.empty(0, np.int64),) * 3
    start, length, period = (np.concatenate(column) for column in zip(*found, strict=True))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _ended(
    places: np.ndarray, lags: np.ndarray, g: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs whose diagonals end on the scale of g words: (start, length, period)."""
    grows = np.zeros(len(places) + 1, bool)
    grows[1:-1] = (places[1:] == places[:-1] + 1) & (lags[1:] == lags[:-1])
    bounds = np.flatnonzero(~grows)
    first, last = bounds[:-1], bounds[1:] - 1
    period = lags[first]
    length = places[last] - places[first] + g + period
    long = length >= np.maximum(MIN_WORDS, MIN_PERIODS * period)
    is_run = (2 * period > g) & (period <= g) & long
    return (places[first] - period)[is_run], length[is_run], period[is_run]


def periodic_runs(docs: DataFrame) -> DataFrame:
    """The runs of every text, and the text without their repetitions.

    Words end at ASCII white space. A run is a stretch of words of ``MIN_WORDS`` words
    and ``MIN_PERIODS`` periods or more with its smallest period, extended as far as the
    period holds. Returns doc_id, n_words, runs (start in words from 0, length, period,
    by start, then period) and collapsed: the words, joined by one blank, but for those
    behind the first period of any run. A null or empty text has no words, no runs and
    an empty ``collapsed``. Repeated rows each give a row, as do null ids. Texts are read
    whole; work grows with n log n in the words of a text, however repetitive it is.
    """

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = [byte_words((text or "").encode()) for text in batch.column("text").to_pylist()]
        words = [word for found in lists for word in found]
        numbers = {word: i for i, word in enumerate(dict.fromkeys(words))}
        names = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        sizes = np.array([len(found) for found in lists], np.int64)
        ends = np.cumsum(sizes)
        start, length, period = runs_of(names, sizes)
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, start + period, 1)
        np.add.at(change, start + length, -1)
        dropped = np.cumsum(change) > 0
        collapsed = []
        for found, end in zip(lists, ends.tolist(), strict=True):
            gone = dropped[end - len(found) : end]
            if gone.any():
                found = [found[i] for i in np.flatnonzero(~gone).tolist()]
            collapsed.append(b" ".join(found).decode())
        owner = np.searchsorted(ends, start, "right")
        offsets = np.searchsorted(owner, np.arange(len(lists) + 1))
        rows = pa.StructArray.from_arrays(
            [pa.array(start - (ends - sizes)[owner]), pa.array(length), pa.array(period)],
            names=["start", "length", "period"],
        )
        runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes), runs, pa.array(collapsed, pa.string())],
            names=["doc_id", "n_words", "runs", "collapsed"],
        )

    columns = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return in_pieces(columns, find, _SCHEMA)


def with_repeats(docs: DataFrame) -> DataFrame:
    """The same documents, a tenth of them with a tail that repeats itself: a test of the operator.

    With h the CRC-32 of the decimal id and g = h div 10: where h ends in 0 and the text
    has n > 0 words, word i >= a becomes word a + (i - a) % p of the text, a = g % n and
    p = 1 + (n - a) div (3 + g % 8). Null ids and texts stay as they are.
    """
    repeated = r"""
        transform(
            array(filter(split(text, '[\\x20\\x09-\\x0D]+'), word -> word <> '')),
            words -> IF(size(words) = 0, text, transform(
                array(struct(g % size(words) AS a,
                             1 + (size(words) - g % size(words)) div (3 + g % 8) AS p)),
                cut -> array_join(transform(words, (word, i) ->
                    IF(i < cut.a, word, get(words, CAST(cut.a + (i - cut.a) % cut.p AS INT)))), ' ')
            )[0])
        )[0]"""
    return (
        docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
        .withColumn("h", F.expr("crc32(CAST(doc_id AS STRING))"))
        .withColumn("g", F.expr("h div 10"))
        .select("doc_id", F.expr(f"CASE WHEN h % 10 = 0 THEN {repeated} ELSE text END AS text"))
    )


def run_digests(found: DataFrame) -> DataFrame:
    """The number of runs, the longest one and checksums of what ``periodic_runs`` found."""
    listed = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')"
    longest = "array_min(transform(runs, r -> struct(-r.length AS less, r.start AS start, r.period AS period)))"
    return found.select(
        "doc_id",
        F.expr("CAST(size(runs) AS BIGINT) AS n_runs"),
        F.expr(f"{longest} AS best"),
        F.expr(f"sha2({listed}, 256) AS runs_sha256"),
        F.expr("sha2(collapsed, 256) AS collapsed_sha256"),
    ).select(
        "doc_id",
        "n_runs",
        F.expr("best.start AS start"),
        F.expr("-best.less AS length"),
        F.expr("best.period AS period"),
        F.expr("1000 * -best.less div best.period AS exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
