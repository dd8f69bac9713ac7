from __future__ import annotations

import random
import re
import zlib
from hashlib import sha256

import pytest

from fleetlens.llm import periodic
from fleetlens.llm.registry import op13_periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words: list[str]) -> list[tuple[int, int, int]]:
    """(start, length, period) by trying every lag at every place."""
    found = []
    for lag in range(1, len(words) // 4 + 1):
        i = lag
        while i < len(words):
            first = i
            while i < len(words) and words[i] == words[i - lag]:
                i += 1
            start, length = first - lag, i - first + lag
            if i > first and length >= max(6, 4 * lag):
                smaller = (
                    all(words[k] == words[k - q] for k in range(start + q, i)) for q in range(1, lag)
                )
                if not any(smaller):
                    found.append((start, length, lag))
            i = max(i, first + 1)
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(word for i, word in enumerate(words) if i not in gone)


def edited(doc_id: int, text: str | None) -> list[str]:
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g = h // 10
    a = g % len(words)
    p = 1 + (len(words) - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))]


def found(frame) -> dict:
    return {
        row.doc_id: ([(r.start, r.length, r.period) for r in row.runs], row.collapsed)
        for row in periodic.periodic_runs(frame).collect()
    }


def random_words(seed: int) -> list[str]:
    rng = random.Random(seed)
    words: list[str] = []
    while len(words) < 60:
        part = [rng.choice("abc") for _ in range(rng.randint(1, 7))]
        words += part * rng.choice([1, 1, 3, 4, 5, 9])
        words += rng.choices("abcxyz", k=rng.randint(0, 3))
    return words


def test_random_texts_equal_brute_force(docs_of):
    texts = {i: random_words(i) for i in range(300)}
    result = found(docs_of(*((i, " ".join(w)) for i, w in texts.items()), extra=True))
    for i, words in texts.items():
        runs = brute(words)
        assert result[i] == (runs, collapsed(words, runs))


@pytest.mark.parametrize(
    ("text", "runs", "left"),
    [
        (None, [], ""),
        ("", [], ""),
        (" \t\n", [], ""),
        ("a a a a a", [], "a a a a a"),
        ("a a a a a a", [(0, 6, 1)], "a"),
        ("x a b a b a b a b y", [(1, 8, 2)], "x a b y"),
        ("a b a b a b a", [], "a b a b a b a"),
        ("a b a b a b a b a", [(0, 9, 2)], "a b"),
        ("a a b a a b a a b a a b", [(0, 12, 3)], "a a b"),
        ("a" + " a" * 5 + " b" + " a" * 5 + " a b", [(0, 6, 1), (7, 6, 1)], "a b a b"),
        ("é é é é é é é é é é é é", [(0, 6, 1)], "é é"),
    ],
)
def test_small_cases(docs_of, text, runs, left):
    assert found(docs_of((1, text))) == {1: (runs, left)}


def test_runs_of_runs_are_kept_apart(docs_of):
    words = ("a a a a a a b " * 4).split()
    runs = brute(words)
    assert {q for _, _, q in runs} == {1, 7}
    assert found(docs_of((1, " ".join(words)))) == {1: (runs, collapsed(words, runs))}


def test_long_repetitive_text(docs_of):
    result = found(docs_of((1, "a " * 300_000), (2, "a b c " * 100_000)))
    assert result == {1: ([(0, 300_000, 1)], "a"), 2: ([(0, 300_000, 3)], "a b c")}


def test_repeated_rows_null_ids_and_empty_tables(docs_of):
    rows = periodic.run_digests(
        periodic.periodic_runs(periodic.with_repeats(docs_of((1, "a b"), (1, "a b"), (None, "c"))))
    ).collect()
    assert sorted(row.doc_id or 0 for row in rows) == [0, 1, 1]
    assert {row.n_runs for row in rows} == {0}
    assert periodic.periodic_runs(docs_of()).count() == 0


def test_query_equals_brute_force_on_whole_sample(spark, sf_dir, sample):
    rows = {row.doc_id: row for row in op13_periodic_runs(spark, sf_dir).collect()}
    assert rows.keys() == sample.keys()
    with_runs = 0
    for doc_id, text in sample.items():
        words = edited(doc_id, text)
        row = rows[doc_id]
        if len(words) > 400:
            continue  # quadratic; the SQL covers them
        runs = brute(words)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert row.n_runs == len(runs)
        assert row.runs_sha256 == sha256(listed.encode()).hexdigest()
        assert row.collapsed_sha256 == sha256(collapsed(words, runs).encode()).hexdigest()
        if runs:
            with_runs += 1
            start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]))
            assert (row.start, row.length, row.period) == (start, length, period)
            assert row.exponent_milli == 1000 * length // period
        else:
            assert (row.start, row.length, row.period, row.exponent_milli) == (None,) * 4
    assert with_runs > 20
