from __future__ import annotations

import corpus_pipeline
import public_tokenizers
import sentencepiece
from fleetlens.llm import near_dup, secret_scan
from fleetlens.llm.registry import queries

from tests.llm import test_decontaminate, test_near_dup, test_secret_scan


def test_stages_equal_brute_force(spark, sf_dir, duck, sample):
    """Quality verdicts come from their own query, all later stages from brute force."""
    verdicts = queries()["op1_quality_rules"](spark, sf_dir).filter("kept").collect()
    kept = {r["doc_id"]: sample[r["doc_id"]] for r in verdicts}
    groups = test_near_dup.brute(list(kept.items()), width=5)
    kept = {i: t for i, t in kept.items() if groups[i][1] == i}
    items = duck.sql("SELECT item_id, text FROM benchmark").fetchall()
    leaks = {doc for doc, _ in test_decontaminate.brute(list(kept.items()), items)}
    kept = {i: t for i, t in kept.items() if i not in leaks}
    meter, rule = secret_scan.NoveltyMeter(test_secret_scan.RULE), test_secret_scan.RULE
    kept = {i: secret_scan.redacted(t, secret_scan.scan(t, meter, rule)[1]) for i, t in kept.items()}
    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert rows == {i: model.encode(t) for i, t in kept.items()}


def test_stages_keep_columns_and_take_odd_rows(spark, sf_dir, docs_of):
    words = " ".join(f"w{i}" for i in range(80))
    docs = docs_of((1, None), (2, ""), (None, words), (4, words), (5, words), (6, "x " * 3), extra=True)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for frame in (docs, docs.limit(0)):
            out = stage(spark, frame, sf_dir)
            assert out.schema.names == docs.schema.names, name
            assert out.count() <= 6
    assert near_dup.deduplicated(docs).filter("text IS NOT NULL AND doc_id IS NOT NULL").count() == 3
