from __future__ import annotations

import math
import re
from collections import Counter

import pytest

from fleetlens.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = set()
    for i, window in enumerate(zip(words, words[1:], words[2:], strict=False)):
        if windows[window] > 1:
            inside |= {i, i + 1, i + 2}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, dups, len(inside), failed


TEXTS = [
    (1, None),
    (2, ""),
    (3, " \n\t"),
    (4, "a b c a b c"),
    (5, "x x x x"),
    (6, "é b #|#\n\nsame\nsame\n same\nsame"),
    (7, "w " * 300),
    (8, " ".join(f"w{i}" for i in range(60))),
    (8, " ".join(f"w{i}" for i in range(60))),
    (9, "y" * 100_000 + " z" * 20_000),
    (None, "null id"),
]


def rows_of(df):
    return {(r["doc_id"], r["n_words"]): r for r in df.collect()}


def test_base_figures_equal_brute_force(docs_of, spark):
    none = spark.createDataFrame([], "doc_id BIGINT")
    found = quality.quality_rules(docs_of(*TEXTS, extra=True), none).collect()
    assert len(found) == len(TEXTS)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    expected = Counter((i, *brute(t)) for i, t in TEXTS)
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in found) == expected
    assert all(r["score"] == 0 and r["kept"] == (not r["base_failed"]) for r in found)


def test_ratio_rejects_what_trusted_texts_never_show(docs_of, spark):
    clean = [(i, " ".join(f"word{i}and{k}" for k in range(80))) for i in range(20)]
    junk = [(100 + i, " ".join(f"$$|{k}##" for k in range(80))) for i in range(5)]
    trusted = spark.createDataFrame([(i,) for i in range(10)], "doc_id BIGINT")
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_rules(docs_of(*clean, *junk), trusted).collect()}
    assert all(kept[i] for i, _ in clean)
    assert not any(kept[i] for i, _ in junk)


def test_every_trusted_text_counts(docs_of, spark):
    docs = docs_of(*((i, f"only{i * i} here{i}") for i in range(16)))
    there = spark.range(12).toDF("doc_id")
    many = spark.range(60_000).selectExpr("IF(id < 12, id, id + 1000000) AS doc_id")
    assert (quality.log_ratios(docs, many) == quality.log_ratios(docs, there)).all()


def brute_scores(pairs, trusted, rules):
    """Mean log ratio per n-gram of each text, with counts in plain dictionaries."""

    def bucket(gram: bytes) -> int:
        value = int.from_bytes(gram, "big")
        value = (value ^ value >> 30) * 0x9E3779B97F4A7C15 % 2**64
        value = (value ^ value >> 27) * 0xC2B2AE3D27D4EB4F % 2**64
        return (value ^ value >> 31) % rules.buckets

    def grams(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        line = " ".join(["", *words, ""]).encode() if words else b""
        return [bucket(line[i : i + rules.gram]) for i in range(len(line) - rules.gram + 1)]

    raw, target = Counter(), Counter()
    for i, text in pairs:
        found = grams(text)
        raw.update(found)
        if i in trusted:
            target.update(found)
    share = sum(target.values()) / max(1, sum(raw.values()))

    def weight(b):
        return math.log(target[b] + rules.smoothing) - math.log(raw[b] * share + rules.smoothing)

    scores = []
    for _, text in pairs:
        found = grams(text)
        scores.append(sum(map(weight, found)) / len(found) if found and target else 0.0)
    return scores


@pytest.mark.parametrize("broadcast_ids", [quality.BROADCAST_IDS, 0])
def test_scores_and_verdicts_equal_brute_force(docs_of, spark, sample, monkeypatch, broadcast_ids):
    monkeypatch.setattr(quality, "BROADCAST_IDS", broadcast_ids)
    rules = quality.QualityRules()
    pairs = [(i, t) for i, t in TEXTS if i != 8] + [(10_000 + i, t) for i, t in list(sample.items())[:150]]
    pairs += [(20_000 + i, " ".join(f"$$|{k}##" for k in range(80))) for i in range(3)]
    trusted = [i for i, _ in pairs if i and (i in (4, 6) or 10_000 <= i < 10_100)]
    ids = spark.createDataFrame([(i,) for i in [*trusted, trusted[0], None, 5_000_000]], "doc_id BIGINT")
    scores = dict(zip([i for i, _ in pairs], brute_scores(pairs, set(trusted), rules), strict=True))
    found = quality.quality_rules(docs_of(*pairs), ids, rules).collect()
    assert len(found) == len(pairs)
    for row in found:
        assert row["score"] == pytest.approx(scores[row["doc_id"]], abs=1e-5)
        assert row["kept"] == (not row["base_failed"] and row["score"] >= rules.min_ratio)
    assert {row["kept"] for row in found if not row["base_failed"]} == {True, False}


def test_no_text_is_shuffled_for_many_trusted_ids(docs_of, spark):
    docs = docs_of(*((i, f"text {i}") for i in range(20))).repartition(4).persist()
    many = spark.range(300_000).toDF("doc_id")
    counted = quality._counted(docs, many, quality.QualityRules())
    plan = counted._jdf.queryExecution().executedPlan().toString()
    docs.unpersist()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    exchanged = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan.split("InMemoryTableScan")[0])
    assert exchanged and all("bucket" in keys for keys in exchanged)


def test_empty_table(docs_of, spark):
    none = spark.createDataFrame([], "doc_id BIGINT")
    assert quality.quality_rules(docs_of(), none).count() == 0


def test_sample_agrees_with_labels(spark, sf_dir, duck, sample):
    from fleetlens.llm.registry import queries

    found = queries()["op1_quality_rules"](spark, sf_dir).collect()
    assert len(found) == len(sample)
    for row in found:
        assert (row["n_words"], row["word_chars"]) == brute(sample[row["doc_id"]])[:2]
    verdicts = {r["doc_id"]: r for r in found}
    labels = duck.sql("SELECT doc_id, quality FROM labels").fetchall()
    good = [verdicts[i]["kept"] for i, q in labels if q == 1 and not verdicts[i]["base_failed"]]
    bad = [verdicts[i]["kept"] for i, q in labels if q == 0]
    assert all(good)
    assert sum(bad) <= 0.02 * len(bad)


@pytest.mark.parametrize("gram", [1, 2, 4])
def test_gram_lengths(gram):
    rules = quality.QualityRules(gram=gram)
    assert len(quality._grams(b"ab  cd", rules)) == len(b" ab cd ") - gram + 1
    assert not len(quality._grams(b" \n", rules))
