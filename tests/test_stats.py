from __future__ import annotations

import numpy as np
import pytest
from frames import utilization

from conftest import rows
from fleetlens.functions import stable_round
from fleetlens.operators import stats
from pyspark.sql import functions as F


def test_quantiles_equal_linear_interpolation(spark):
    values = [float(v) for v in np.random.default_rng(7).integers(0, 200, 5000)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v DOUBLE")
    found = rows(stats.quantiles(df, {"v": "v"}))
    assert found[0][0] == "v"
    assert found[0][1:] == pytest.approx(np.quantile(values, stats.STANDARD_FRACTIONS))


def test_quantiles_of_several_columns(spark):
    df = utilization(spark, ("a", 0.0, 10.0, 0.0), ("b", 100.0, 30.0, 0.0))
    found = stats.quantiles(
        df, {"cpu": "avg_cpu_utilization", "mem": "avg_memory_utilization"}, stats.REPORT_FRACTIONS
    )
    assert found.columns == ["metric", "p50", "p75", "p90", "p95"]
    assert {row.metric: row.p50 for row in found.collect()} == {"cpu": 50.0, "mem": 20.0}


def test_top_lists(spark):
    df = utilization(spark, *[(f"c{i:02}", float(i), float(-i), 0.0) for i in range(12)])
    assert [r[0] for r in rows(stats.top_cpu(df), "cluster_id")] == [
        f"c{i:02}" for i in range(11, 1, -1)
    ]
    assert rows(stats.top_memory(df, 1), "cluster_id") == [("c00",)]


def test_summary_counts_each_table_and_all(spark):
    found = stats.metrics_summary({"a": spark.range(3), "b": spark.range(4), "none": spark.range(0)})
    assert dict(rows(found)) == {"a": 3, "b": 4, "none": 0, "total_records": 7}


def test_present_columns(spark):
    df = spark.createDataFrame([(1, 2)], "a INT, b INT")
    assert stats.present_columns(df, ["b", "missing", "a"]).columns == ["b", "a"]


@pytest.mark.parametrize(
    "value, expected",
    [(36.535, 36.54), (36.535 - 1e-13, 36.54), (0.005, 0.01), (-0.005, -0.01), (float("nan"), None)],
)
def test_rounding_is_half_up_and_ignores_noise(spark, value, expected):
    df = spark.createDataFrame([(value,)], "v DOUBLE")
    assert rows(df.select(stable_round(F.col("v")))) == [(expected,)]


def test_quantiles_of_spread_and_signed_values(spark):
    rng = np.random.default_rng(3)
    values = [*(rng.standard_normal(3000) * 10.0 ** rng.integers(-9, 9, 3000)), 0.0, -0.0, 1e300, -1e300]
    df = spark.createDataFrame([(float(v),) for v in values], "v DOUBLE")
    found = rows(stats.quantiles(df, {"v": "v"}, (0.0, 0.25, 0.5, 0.75, 1.0)))
    assert found[0][1:] == pytest.approx(np.quantile(values, (0.0, 0.25, 0.5, 0.75, 1.0)), rel=1e-9)
    assert rows(stats.quantiles(df.limit(1), {"v": "v"}))[0][1:] == (values[0],) * 4
    assert stats.quantiles(df.limit(0), {"v": "v"}).count() == 0
