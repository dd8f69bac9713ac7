from __future__ import annotations

import pytest

from fleetlens.llm.texts import find_code

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


@pytest.fixture(scope="session", autouse=True)
def code(spark):
    find_code(spark)


@pytest.fixture(scope="session")
def docs_of(spark):
    """(doc_id, text) pairs as a documents table, with columns whose names clash."""

    def make(*pairs, extra: bool = False):
        rows = [(i, t, None, None, None if t is None else len(t)) for i, t in pairs]
        frame = spark.createDataFrame(rows, DOCS)
        if extra:
            for name in ("id", "n", "at", "chunk", "bucket", "start", "row", "shingles", "component"):
                frame = frame.selectExpr("*", f"'x' AS {name}")
        return frame

    return make


@pytest.fixture(scope="session")
def sample(duck):
    """Texts of the test documents by id."""
    return dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
