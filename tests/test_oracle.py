"""Every registered query of the package's own operators against its SQL, over whole tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from fleetlens.checks import oracle, registry

QUERIES = registry.queries()
ORACLE = oracle.oracle_sql()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    result = QUERIES[name](spark, sf_dir)
    columns = sorted(result.columns)
    cursor = duck.execute(ORACLE[name])
    positions = {column[0]: i for i, column in enumerate(cursor.description)}
    assert sorted(positions) == columns
    expected = [tuple(row[positions[c]] for c in columns) for row in cursor.fetchall()]
    found = [tuple(row[c] for c in columns) for row in result.collect()]
    assert found
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_entry_point(spark):
    result = entry_points.entry(spark)
    assert result.columns[:3] == ["workspace_id", "job_id", "job_name"]
    assert result.count() > 0


@pytest.mark.parametrize("name", ["job_runtime_metrics", "job_runtime_active"])
def test_durations_are_ordered(spark, sf_dir, name):
    columns = ["min", "median", "p90", "p95", "max"]
    names = [f"{c}_duration_seconds" for c in columns]
    broken = " OR ".join(f"{a} > {b}" for a, b in zip(names, names[1:], strict=False))
    assert QUERIES[name](spark, sf_dir).filter(broken).count() == 0


def test_parts_do_not_exceed_totals(spark, sf_dir):
    failures = QUERIES["job_failure_analysis"](spark, sf_dir)
    assert failures.filter("successful_runs > total_runs OR failed_runs > total_runs").count() == 0
