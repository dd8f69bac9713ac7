from __future__ import annotations

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fleetlens.llm import token_counts

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
TEXTS = [
    (1, None),
    (2, ""),
    (3, "<|endoftext|> a <|endoftext|>"),
    (4, "  two  blanks \n and 'll it's "),
    (5, "z" * 50_000),
    (6, "long text " * 30_000),
    (7, "　wide   blank 🙂 é"),
    (7, "　wide   blank 🙂 é"),
    (None, "x"),
]


def lengths(texts):
    encoded = Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)
    return [len(e.ids) for e in encoded]


def test_counts_equal_the_library(docs_of, sample):
    pairs = TEXTS + list(sample.items())
    counted = token_counts.token_counts(docs_of(*pairs, extra=True), PATH)
    rows = token_counts.with_limit(counted, 1024).collect()
    texts = [t or "" for _, t in pairs]
    expected = [
        (i, len(t.encode()), n, n > 1024)
        for (i, _), t, n in zip(pairs, texts, lengths(texts), strict=True)
    ]
    key = repr
    assert sorted(map(tuple, rows), key=key) == sorted(expected, key=key)


def test_empty_table(docs_of):
    assert token_counts.token_counts(docs_of(), PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab \n\t'st1!é 　 \u0085\x1c<|endoftext|>"), max_size=40))
def test_units_add_up(text):
    units = token_counts.split_safely(text)
    assert "".join(units) == text
    assert sum(lengths(units)) == lengths([text])[0]
