from __future__ import annotations

import re
from collections import Counter

from fleetlens.llm import decontaminate


def words(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", folded)


def runs(found, width):
    return [tuple(found[i : i + width]) for i in range(len(found) - width + 1)]


def brute(docs, items):
    """{(doc, item): (windows, best)} over all windows of the item's size on a shared diagonal."""
    result = {}
    for item, text in items:
        wanted = words(text)
        if not wanted:
            continue
        width = min(5, len(wanted))
        target = runs(wanted, width)
        places = {}
        for at, s in enumerate(target):
            places.setdefault(s, []).append(at)
        for doc, body in docs:
            have = runs(words(body), width)
            starts = {i - at for i, s in enumerate(have) for at in places.get(s, ())}
            best = []
            for start in starts:
                window = have[start : start + len(target)] if start >= 0 else []
                if len(window) == len(target):
                    a, b = Counter(window), Counter(target)
                    shared = sum((a & b).values())
                    if 100 * shared >= 80 * (2 * len(target) - shared):
                        best.append(shared / (2 * len(target) - shared))
            if best:
                result[doc, item] = (len(best), round(max(best), 9))
    return result


def found(spark, docs, items):
    benchmark = spark.createDataFrame(items, "item_id BIGINT, text STRING").selectExpr("*", "1 AS n", "2 AS start")
    rows = decontaminate.benchmark_leaks(docs, benchmark).collect()
    return {(r["doc_id"], r["item_id"]): (r["n_windows"], round(r["similarity"], 9)) for r in rows}


def test_planted_passages(spark, docs_of):
    passage = " ".join(f"p{i}" for i in range(40))
    edited = passage.replace("p1 ", "other ")
    longer = passage.replace("p37 ", "p37 more ")
    changed = passage.replace("p10 ", "x ").replace("p20 ", "y ").replace("p30 ", "z ")
    half = " ".join(f"p{i}" for i in range(20))
    filler = " ".join(f"f{i}" for i in range(300))
    items = [(1, passage), (2, passage), (3, "a b c"), (4, None), (5, ""), (6, "r r r r r r r r r r")]
    docs = [
        (1, f"{filler} {passage.upper()} {filler}"),
        (2, f"{edited}"),
        (3, f"{filler} {longer} {filler}"),
        (4, f"{half} {filler}"),
        (5, "x A b\nC y"),
        (6, None),
        (7, ""),
        (8, "r " * 30),
        (9, f"{passage} {filler} {passage}"),
        (10, filler * 200),
        (11, f"{filler} {changed} {filler}"),
    ]
    got = found(spark, docs_of(*docs, extra=True), items)
    assert got == brute(docs, items)
    assert {d for d, _ in got} == {1, 2, 3, 5, 8, 9}


def test_sample_equals_brute_force(spark, docs_of, sample, duck):
    items = duck.sql("SELECT item_id, text FROM benchmark").fetchall()
    pairs = list(sample.items())
    assert found(spark, docs_of(*pairs), items) == brute(pairs, items)


def all_windows(docs, items):
    """{(doc, item): best} over every window, and over whole texts shorter than the item."""
    result = {}
    for item, text in items:
        wanted = words(text)
        width = min(5, len(wanted))
        target = Counter(runs(wanted, width))
        n = target.total()
        for doc, body in docs:
            have = runs(words(body), width)
            windows = [Counter(have[i : i + n]) for i in range(max(1, len(have) - n + 1))]
            best = max((target & w).total() / (target | w).total() for w in windows)
            if best >= 0.8:
                result[doc, item] = round(best, 9)
    return result


def test_windows_at_the_edges_of_a_text(spark, docs_of):
    cut = [f"p{i}" for i in range(50)]
    passage, filler = " ".join(cut), " ".join(f"f{i}" for i in range(70))
    docs = [
        (1, " ".join(cut[1:]) + " " + filler),
        (2, filler + " " + " ".join(cut[:-1])),
        (3, " ".join(cut[1:])),
        (4, " ".join(cut[2:-2])),
        (5, " ".join(cut[:30])),
        (6, "p0 p1 p2"),
    ]
    got = found(spark, docs_of(*docs), [(1, passage)])
    assert {key: best for key, (_, best) in got.items()} == all_windows(docs, [(1, passage)])
    assert {d for d, _ in got} == {1, 2, 3, 4}


def test_reordered_passages(spark, docs_of):
    parts = [f"p{i}" for i in range(50)]
    thirds = parts[34:] + parts[17:34] + parts[:17]
    filler = " ".join(f"f{i}" for i in range(70))
    again = " ".join(parts[:25] + ["new"] + parts[25:])
    docs = [
        (1, " ".join([filler, *parts[25:], *parts[:25], filler])),
        (2, " ".join([*parts[20:], *parts[:20]])),
        (3, " ".join([filler, *thirds, filler])),
        (4, f"{filler} {again} {filler} {again}"),
        (5, " ".join([filler, *parts[:12], filler, *parts[:12], filler])),
        (6, " ".join([*parts[30:], filler])),
    ]
    items = [(1, " ".join(parts)), (2, " ".join(parts[:44]))]
    got = found(spark, docs_of(*docs), items)
    expected = all_windows(docs, items)
    assert {key: best for key, (_, best) in got.items()} == expected
    assert {(1, 1), (2, 1), (4, 1)} <= set(expected)


def test_every_window_that_can_be_similar_starts_once(spark):
    cases = [
        ([0, 1, 2, 5, 9], 2, 4, 12),
        ([3], 1, 4, 10),
        ([0, 1, 2], 3, 8, 3),
        ([7, 8, 9], 3, 3, 10),
        ([0, 9], 2, 4, 10),
        (list(range(30)), 1, 6, 30),
    ]
    frame = spark.createDataFrame(cases, "at ARRAY<INT>, least INT, n INT, size INT")
    rows = frame.select(decontaminate.window_starts("at", "least", "n", "size")).collect()
    expected = [
        [s for s in range(max(0, size - n) + 1) if sum(s <= p < s + n for p in at) >= least]
        for at, least, n, size in cases
    ]
    assert [list(row[0]) for row in rows] == expected


def test_empty_tables(spark, docs_of):
    assert found(spark, docs_of(), [(1, "a b c d e f")]) == {}
    assert found(spark, docs_of((1, "a b c d e f")), []) == {}


def test_clean_documents_stay(spark, docs_of):
    benchmark = spark.createDataFrame([(1, "a b c d e f g")], "item_id BIGINT, text STRING")
    docs = docs_of((1, "x a b c d e f g"), (2, "clean"), (None, "clean"), (3, None), extra=True)
    rest = decontaminate.decontaminated(docs, benchmark)
    assert rest.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in rest.collect()) == [0, 2, 3]


def test_blocks_guarantee_the_radius(spark):
    a, radius = 0x123456789ABCDEF0, 19
    flipped = [a ^ sum(1 << (b * 3) for b in range(k)) for k in range(radius + 1)]
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in flipped]
    rows = spark.createDataFrame([(x,) for x in signed], "fp BIGINT").select(decontaminate.blocks("fp", radius)).collect()
    first = set(map(tuple, rows[0][0]))
    assert all(first & set(map(tuple, row[0])) for row in rows)
