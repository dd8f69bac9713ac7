from __future__ import annotations

import random
import re

import numpy as np
import pytest

from fleetlens.llm import near_dup, texts
from fleetlens.llm.near_dup import NearDupRules


def shingle_set(text, width):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", folded)
    if not words:
        return set()
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(pairs, width=2):
    """doc_id -> (size, component), by comparing all pairs."""
    sets = {i: shingle_set(t, width) for i, t in pairs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    by_shingle = {}
    for i in ids:
        for s in sets[i]:
            by_shingle.setdefault(s, []).append(i)
    near = {(a, b) for group in by_shingle.values() for a in group for b in group if a < b}
    for a, b in near:
        shared = len(sets[a] & sets[b])
        if 100 * shared >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def found(docs, rules=NearDupRules()):
    rows = near_dup.near_duplicates(docs, rules).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows if r["doc_id"] is not None)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}


def test_edge_cases(docs_of):
    words = " ".join(f"w{i}" for i in range(60))
    pairs = [
        (1, None),
        (2, ""),
        (3, " \n"),
        (4, "one"),
        (5, "ONE "),
        (6, "one two"),
        (7, words),
        (9, words.upper().replace(" ", "\n")),
        (8, words + " x"),
        (10, " ".join(f"v{i}" for i in range(50_000))),
        (11, "É a"),
        (12, "é a"),
    ]
    assert found(docs_of(*pairs, extra=True)) == brute(pairs)
    assert found(docs_of()) == {}
    assert found(docs_of((1, None))) == {1: (0, 1)}
    repeated = near_dup.near_duplicates(docs_of((3, words), (3, words), (None, words))).collect()
    assert len(repeated) == 3 and {r["component_id"] for r in repeated} == {3}


def test_an_id_may_name_several_texts(docs_of, monkeypatch):
    """Links of each text count, and all rows of an id share its least document."""
    monkeypatch.setattr(texts, "HOT_ROWS", 1)
    a, b = (" ".join(f"{c}{i}" for i in range(100)) for c in "ab")
    rows = near_dup.near_duplicates(docs_of((1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, "own words"))).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in rows) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]
    rows = near_dup.near_duplicates(docs_of((5, a), (7, a + " x"), (7, b), (6, b + " y"), (9, b + " y"))).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in rows) == [(5, 5), (6, 6), (7, 5), (7, 6), (9, 6)]


def test_chains_and_borderline_groups_equal_brute_force(docs_of):
    """A drifting chain, a star of edits near the limit, and copies."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(100)]
    pairs, words = [], list(base)
    for i in range(40):
        pairs.append((500 - i, " ".join(words)))
        for _ in range(3):
            words[rng.randrange(100)] = f"c{i}x{rng.random()}"
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice((2, 5, 6))):
            words[rng.randrange(100)] = f"d{i}x{rng.random()}"
        pairs.append((1000 + i, " ".join(words)))
    pairs += [(2000 + i, " ".join(base)) for i in range(30)]
    assert found(docs_of(*pairs)) == brute(pairs)


@pytest.mark.parametrize("width", [2, 5])
def test_sample_equals_brute_force(docs_of, sample, width):
    pairs = list(sample.items())
    assert found(docs_of(*pairs), NearDupRules(width=width)) == brute(pairs, width)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 500).astype(np.uint64)
    b = np.concatenate([a[:400], rng.integers(0, 2**63, 100).astype(np.uint64)])
    same = (near_dup.signature(a, 400) == near_dup.signature(b, 400)).mean()
    assert abs(same - 400 / 600) < 0.1


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 90), (90, 95)], "a BIGINT, b BIGINT")
    rows = near_dup.components(links).collect()
    assert {r["id"]: r["component"] for r in rows} == {**{i: 0 for i in range(1, 61)}, 100: 90, 95: 90}


def test_one_document_of_each_group_stays(docs_of):
    words = " ".join(f"w{i}" for i in range(60))
    docs = docs_of((2, words), (1, words + " x"), (3, ""), (4, None), extra=True)
    rest = near_dup.deduplicated(docs)
    assert rest.columns == docs.columns
    assert sorted(r["doc_id"] for r in rest.collect()) == [1, 3, 4]
