from __future__ import annotations

import zlib

import numpy as np

from fleetlens.llm import toxicity
from fleetlens.llm.registry import queries
from fleetlens.llm.toxicity import ToxicityRules


def is_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_held_out_accuracy(spark, sf_dir, duck, sample):
    rows = {r["doc_id"]: r for r in queries()["op6_toxicity"](spark, sf_dir).collect()}
    assert len(rows) == len(sample)
    assert all(r["held_out"] == is_held_out(i) for i, r in rows.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows.values())
    labels = [(rows[i], t) for i, t in duck.sql("SELECT doc_id, toxic FROM labels").fetchall() if is_held_out(i)]
    right = [r["predicted"] == t for r, t in labels]
    assert np.mean(right) >= 0.93
    assert np.mean([t for r, t in labels if r["predicted"]]) >= 0.9


def test_separates_planted_words(spark, docs_of):
    docs = [(i, f"plain text {i} about things" + (" vile" if i % 4 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id BIGINT, toxic INT")
    edge = [(1001, None), (1002, ""), (None, "vile"), (1003, "vile " * 50_000)]
    scored = toxicity.toxicity_scores(docs_of(*docs, *edge, extra=True), labels).collect()
    by_id = {r["doc_id"]: r for r in scored}
    assert all(by_id[i]["predicted"] == (i % 4 == 0) for i, _ in docs)
    assert by_id[1001]["score"] == by_id[1002]["score"] < 0.5 < by_id[None]["score"]
    assert by_id[1003]["predicted"] == 1 and by_id[None]["held_out"] is False


def test_nothing_to_learn_from(spark, docs_of):
    none = spark.createDataFrame([], "doc_id BIGINT, toxic INT")
    assert [r["score"] for r in toxicity.toxicity_scores(docs_of((1, "a")), none).collect()] == [0.0]
    assert toxicity.toxicity_scores(docs_of(), none).count() == 0
    labels = spark.createDataFrame([(7, 1), (None, 1), (8, None)], "doc_id BIGINT, toxic INT")
    assert toxicity.toxicity_scores(docs_of((1, "a"), (7, "b")), labels).count() == 2


def test_risk_stays_non_negative():
    """With positives hidden among the unlabelled, they still score above the rest."""
    rng = np.random.default_rng(0)
    rules = ToxicityRules(features=64, epochs=20, batch=100)

    def text(toxic):
        words = {int(w) for w in rng.integers(8, 64, 10)}
        return np.array(sorted(words | ({int(rng.integers(0, 4))} if toxic else set())))

    positive = [text(True) for _ in range(200)]
    unlabelled = [text(k % 5 == 0) for k in range(1000)]
    model = toxicity.train_non_negative_pu(positive, unlabelled, 0.2, rules)
    hidden = [model.logit(f) > 0 for f in unlabelled]
    truth = [k % 5 == 0 for k in range(1000)]
    assert np.mean(np.array(hidden) == truth) > 0.95
