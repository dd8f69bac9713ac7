from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from fleetlens.llm import repeats, suffix_array, texts

SMALL = repeats.RepeatRules(width=12, gram=5)


def brute(texts: list[str | None], width: int) -> list[tuple[int, list, bytes]]:
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + width] for r in raws for i in range(len(r) - width + 1))
    result = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - width + 1):
            if seen[r[i : i + width]] > 1:
                gone[i : i + width] = True
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        result.append((len(r), repeats.ranges_of(gone), kept))
    return result


def found(frame, rules) -> list[tuple]:
    rows = repeats.without_repeats(frame, rules).collect()
    return [(r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in rows]


def check(docs_of, pairs, rules, extra=False):
    expected = [
        (i, *row) for (i, _), row in zip(pairs, brute([t for _, t in pairs], rules.width), strict=True)
    ]
    assert sorted(found(docs_of(*pairs, extra=extra), rules), key=repr) == sorted(expected, key=repr)
    return expected


def mixed_texts(n: int, seed: int) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    words = ["alpha", "béta", "gamma", "δ", "epsilon", "zeta", "\U0001f600", "eta", "theta"]
    parts = [" ".join(rng.choices(words, k=rng.randint(2, 12))) for _ in range(n)]
    return [
        (i, " ".join(rng.choice(parts) if rng.random() < 0.5 else rng.choice(words) for _ in range(rng.randint(0, 9))))
        for i in range(n)
    ]


@pytest.mark.parametrize("dense", [0, 64, 10**9])
def test_suffix_array_sorts_suffixes(monkeypatch, dense):
    monkeypatch.setattr(suffix_array, "_DENSE", dense)
    rng = random.Random(dense)
    for _ in range(400):
        data = bytes(rng.choices(range(rng.randint(1, 4)), k=rng.randint(0, 40))) * rng.randint(1, 3)
        order = suffix_array.suffix_array(np.frombuffer(data, np.uint8), 4).tolist()
        assert order == sorted(range(len(data)), key=lambda i: data[i:])


def test_common_prefixes_end_at_separators():
    data = b"abcab\xffbcab\xffab\xff"
    text = np.frombuffer(data, np.uint8)
    left = np.array([data.index(0xFF, i) - i for i in range(len(data))])
    order = suffix_array.suffix_array(text, 256)
    neighbour, prefix = suffix_array.common_prefixes(text, order, left)
    for r in range(1, len(data)):
        i, j = order[r], order[r - 1]
        same = 0
        while same < min(left[i], left[j]) and data[i + same] == data[j + same]:
            same += 1
        assert (neighbour[i], prefix[i]) == (j, same)


@pytest.mark.parametrize(
    "rules",
    [SMALL, repeats.RepeatRules(width=12, gram=12), repeats.RepeatRules(width=12, gram=5, shard_bytes=200),
     repeats.RepeatRules(width=12, gram=5, key_bytes=0), repeats.RepeatRules(width=12, gram=5, key_bytes=60)],
)
def test_random_texts_equal_brute_force(docs_of, rules):
    pairs = mixed_texts(150, rules.key_bytes % 97)
    expected = check(docs_of, pairs, rules, extra=True)
    assert any(0 < len(kept) < n for _, n, _, kept in expected)


def test_edges(docs_of):
    pairs = [
        (1, None),
        (2, ""),
        (3, "short"),
        (4, "0123456789ab"),
        (5, "x0123456789aby"),
        (6, "0123456789a"),
        (7, "é" * 6),
        (8, "zé" * 3 + "é" * 3),
        (9, "once only, this"),
    ]
    check(docs_of, pairs, SMALL)


def test_repeats_within_one_text(docs_of):
    check(docs_of, [(1, "a" * 30), (2, "bcd" * 20), (3, "e" * 12), (4, "once only, this")], SMALL)
    check(docs_of, [(1, "a" * 13)], SMALL)
    check(docs_of, [(1, "abcdefghijklmnop" + "-" + "abcdefghijklmnop")], SMALL)


def test_matches_do_not_cross_texts(docs_of):
    pairs = [(1, "abcdefgh"), (2, "ijklmnop"), (3, "abcdefghijklmnop"), (4, "zzabcdefghijklyy")]
    check(docs_of, pairs, SMALL)


def test_repeated_rows_and_null_ids(docs_of):
    text = "a text that is long enough"
    pairs = [(1, text), (1, text), (1, "another text, long enough"), (None, text), (0, text), (None, "and one more, alone")]
    check(docs_of, pairs, SMALL)
    check(docs_of, [(1, text)], SMALL)
    assert found(docs_of(), SMALL) == []


def test_many_copies_take_the_broadcast_path(docs_of, monkeypatch):
    monkeypatch.setattr(texts, "HOT_ROWS", 5)
    shared = "a passage that a third of all texts hold"
    pairs = [(i, f"{i:04d} own words {i * 7919 % 9973:05d} " + (shared if i % 3 else "")) for i in range(90)]
    pairs += [(i, shared) for i in range(90, 120)]
    for rules in (SMALL, repeats.RepeatRules(width=12, gram=5, key_bytes=0)):
        check(docs_of, pairs, rules)


def test_texts_longer_than_a_chunk(docs_of):
    rng = random.Random(3)
    own = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=1_200_000))
    at = (1 << 20) - 300  # across the end of the first chunk
    passage = own[at : at + 900]
    rows = {r[0]: r[1:] for r in found(docs_of((1, own), (2, "before " + passage + " behind")), repeats.RepeatRules())}
    assert rows[1] == (len(own), [(at, at + 900)], (own[:at] + own[at + 900 :]).encode())
    assert rows[2][1:] == ([(7, 907)], b"before  behind")


def test_whole_sample_equals_brute_force(docs_of, sample):
    check(docs_of, sorted(sample.items()), repeats.RepeatRules())
