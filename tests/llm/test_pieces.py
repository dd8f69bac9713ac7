from __future__ import annotations

import public_tokenizers
import pyarrow as pa
import sentencepiece

from fleetlens.llm import pieces
from fleetlens.llm.texts import BATCH_KEY, PIECE_BYTES, in_pieces

PATH = str(public_tokenizers.path("piece_bpe_32k.model"))
TEXTS = [
    (1, None),
    (2, ""),
    (3, " "),
    (4, "  lead,   inner  and trailing   "),
    (5, "a\tb\n\n c <s> </s> <unk> <0x41>"),
    (6, "日本語テキスト привет 🙂🙂 \x00 é"),
    (7, "x" * 3000),
    (8, "abcdefghij" * 300 + " " * 200),
    (9, "{\n" + " " * 20 + "why: return {}\n" + "    " * 9 + "(raise)"),
    (9, "{\n" + " " * 20 + "why: return {}\n" + "    " * 9 + "(raise)"),
    (10, "ordinary words, repeated words. " * 3000),
    (None, "null id"),
]


def check(docs, pairs):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    encoded = pieces.encode(docs, PATH)
    rows = pieces.decode(encoded, PATH).collect()
    got = sorted((repr(r["doc_id"]), list(r["ids"]), r["n_tokens"], r["text"]) for r in rows)
    expected = []
    for i, text in pairs:
        ids = model.encode(text or "")
        expected.append((repr(i), ids, len(ids), text or ""))
    assert got == sorted(expected)


def test_ids_and_round_trip_equal_the_library(docs_of):
    check(docs_of(*TEXTS, extra=True), TEXTS)


def test_sample_equals_the_library(docs_of, sample):
    pairs = list(sample.items())[:300]
    check(docs_of(*pairs), pairs)


def test_empty_table(docs_of):
    assert pieces.encode(docs_of(), PATH).count() == 0


def test_only_empty_texts(docs_of):
    pairs = [(1, None), (2, ""), (2, "")]
    check(docs_of(*pairs), pairs)


def test_words_of_many_parts(docs_of, monkeypatch):
    monkeypatch.setattr(pieces, "PARTITION_WORDS", 7)
    pairs = [(i, f"shared words and number {i} " + "y" * (i % 90)) for i in range(200)]
    check(docs_of(*pairs).repartition(6), pairs)


def test_decode_of_null_and_broken_bytes(spark):
    frame = spark.createDataFrame([(1, None), (2, [])], "doc_id BIGINT, ids ARRAY<INT>")
    assert {r["doc_id"]: r["text"] for r in pieces.decode(frame, PATH).collect()} == {1: None, 2: ""}
    assert pieces.decoded_text([3 + 0xFF], PATH) == "�"


def test_long_word_helper_equals_the_library():
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text in ("hello" * 40, "aab" * 100, "zqxj" * 50, "e" * 500):
        assert pieces.merged(pieces.BLANK + text, PATH) == model.encode(text)


def test_texts_are_staged_once_and_not_shuffled(docs_of):
    """Texts as numbers, half the size of the input, once moved on top of being staged."""
    pairs = [(i, f"some words of text {i}") for i in range(50)]
    plan = pieces.encode(docs_of(*pairs), PATH)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert not [line for line in exchanges if "hashpartitioning(part#" in line]
    # Words and their ids meet where the words are dealt to: both uses read one exchange.
    assert len([line for line in exchanges if "hashpartitioning(word#" in line]) == 2
    assert len(exchanges) == 3


def test_parts_of_many_pieces(docs_of, monkeypatch):
    monkeypatch.setattr(pieces, "PART_BYTES", 400)
    monkeypatch.setattr(pieces, "_CUT_BYTES", 90)
    monkeypatch.setattr(pieces, "_PACKED_WORDS", 5)
    pairs = [(i, f"part {i % 7}\n" * (i % 5) + "é\x00🙂" * (i % 3) + "z" * (i % 80)) for i in range(60)]
    pairs += [(60, None), (61, "")]
    check(docs_of(*pairs).repartition(2), pairs)


def test_segments_hold_the_text_and_no_piece_reaches_over():
    texts = ["a b", None, "", "  x\t\n", "日本 é🙂z", "don't STOP"]
    words, sizes = pieces.segments(texts, PATH)
    ends = sizes.cumsum()
    pairs = {(a, b) for p in pieces._ranked(PATH) for a, b in zip(p, p[1:], strict=False)}
    for text, start, end in zip(texts, ends - sizes, ends, strict=True):
        some = words.to_pylist()[start:end]
        assert "".join(some) == (pieces.BLANK + text.replace(" ", pieces.BLANK) if text else "")
        assert all((a[-1], b[0]) not in pairs for a, b in zip(some, some[1:], strict=False))
        assert all(pair in pairs for word in some for pair in zip(word, word[1:], strict=False))


def test_decode_of_bytes_in_many_texts(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    broken = [3 + 0xE2, 3 + 0x96, *model.encode("x\ny")]
    lists = [model.encode("a\nb"), [], broken, None, model.encode("🙂 \x00"), [3 + 0xFF]]
    frame = spark.createDataFrame(list(enumerate(lists)), "doc_id BIGINT, ids ARRAY<INT>").coalesce(1)
    found = {r["doc_id"]: r["text"] for r in pieces.decode(frame, PATH).collect()}
    assert found == {i: None if ids is None else pieces.decoded_text(ids, PATH) for i, ids in enumerate(lists)}


def test_python_workers_get_bounded_batches(spark):
    def whole(piece):
        behind = piece.column("text").buffers()[2]
        return pa.RecordBatch.from_pylist([{"n": behind.size, "texts": piece.num_rows}])

    texts = spark.range(0, 2400, 1, 1).selectExpr("repeat(chr(97 + id % 26), 10000) AS text")
    row = in_pieces(texts, whole, "n BIGINT, texts BIGINT").selectExpr("max(n)", "sum(texts)").first()
    assert row[0] <= 2 * PIECE_BYTES and row[1] == 2400


def test_texts_in_batches_of_few_bytes(spark, docs_of, monkeypatch):
    monkeypatch.setattr(pieces, "_CUT_BYTES", 4000)
    monkeypatch.setattr(pieces, "PARTITION_WORDS", 50)
    spark.conf.set(BATCH_KEY, "2000")
    try:
        check(docs_of(*TEXTS), TEXTS)
        assert spark.conf.get(BATCH_KEY) == "2000"
    finally:
        spark.conf.unset(BATCH_KEY)
