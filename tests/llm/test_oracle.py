"""Registered queries against their SQL, over whole tables."""

from __future__ import annotations

import pytest

from fleetlens.llm.oracle import oracle_sql
from fleetlens.llm.registry import queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    result = queries()[name](spark, sf_dir)
    columns = sorted(result.columns)
    cursor = duck.execute(oracle_sql()[name])
    positions = {column[0]: i for i, column in enumerate(cursor.description)}
    assert sorted(positions) == columns
    expected = [tuple(row[positions[c]] for c in columns) for row in cursor.fetchall()]
    found = [tuple(row[c] for c in columns) for row in result.collect()]
    assert found
    assert sorted(found, key=repr) == sorted(expected, key=repr)
