"""Random small tables, with missing keys and values, against plain SQL."""

from __future__ import annotations

from datetime import timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest
from frames import AS_OF

from fleetlens.operators import jobs, nodes
from fleetlens.schemas import SCHEMAS

N = 4000
SINCE = "TIMESTAMP '2024-01-08 00:00:00'"
FAILED = "('FAILED', 'TIMEOUT', 'CANCELLED')"


def same(spark_df, sql):
    columns = sorted(spark_df.columns)
    cursor = duckdb.sql(sql)
    expected = [tuple(r[cursor.columns.index(c)] for c in columns) for r in cursor.fetchall()]
    found = [tuple(row[c] for c in columns) for row in spark_df.collect()]

    def key(row):
        return [(v is not None, str(type(v)), v if v is not None else 0) for v in row]

    found, expected = sorted(found, key=key), sorted(expected, key=key)
    assert len(found) == len(expected)
    for a, b in zip(found, expected, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == (pytest.approx(y, abs=0.011) if isinstance(y, float) else y)


@pytest.fixture(scope="module")
def slices(spark):
    rng = np.random.default_rng(11)

    def pick(values, size=N):
        return rng.choice(np.array(values, dtype=object), size)

    start = [AS_OF - timedelta(minutes=int(m)) for m in rng.integers(0, 10 * 1440, N)]
    table = pd.DataFrame(
        {
            "workspace_id": pick(["a", "b", None]),
            "job_id": pick(["1", "2", "3", None]),
            "run_id": pick([*map(str, range(60)), None]),
            "period_start_time": start,
            "period_end_time": [s + timedelta(seconds=int(x)) for s, x in zip(start, rng.integers(0, 9000, N), strict=True)],
            "result_state": pick(["SUCCESS", "FAILED", "TIMEOUT", "CANCELLED", "SKIPPED", None]),
        }
    )
    duckdb.register("slices", table)
    rows = [tuple(None if v is None else v for v in row) for row in table.itertuples(index=False)]
    rows = [(*r[:3], r[3].to_pydatetime(), r[4].to_pydatetime(), r[5]) for r in rows]
    return spark.createDataFrame(rows, SCHEMAS["job_run_timeline"])


@pytest.fixture(scope="module")
def names(spark):
    rows = [(w, j, f"{w}{j}", AS_OF) for w in "ab" for j in "12"]
    duckdb.register("names", pd.DataFrame(rows, columns=["workspace_id", "job_id", "name", "t"]))
    return spark.createDataFrame(rows, SCHEMAS["jobs"])


def test_failures(slices, names):
    same(
        jobs.job_failure_analysis(slices, names, 7, AS_OF).select(
            "workspace_id", "job_id", "job_name", "total_runs", "successful_runs", "failed_runs"
        ),
        f"""SELECT s.workspace_id, s.job_id, coalesce(name, 'Job_' || s.job_id) AS job_name,
                   count(DISTINCT run_id) AS total_runs,
                   count(DISTINCT run_id) FILTER (result_state = 'SUCCESS')
                       AS successful_runs,
                   count(DISTINCT run_id) FILTER (result_state IN {FAILED}) AS failed_runs
            FROM slices s LEFT JOIN names n
              ON s.workspace_id = n.workspace_id AND s.job_id = n.job_id
            WHERE period_start_time >= {SINCE} AND result_state IS NOT NULL
            GROUP BY ALL""",
    )


def test_runtime(slices, names):
    same(
        jobs.job_runtime_metrics(slices, names, 7, AS_OF).select(
            "workspace_id", "job_id", "total_runs", "avg_duration_seconds", "min_duration_seconds",
            "max_duration_seconds", "median_duration_seconds",
        ),
        f"""SELECT workspace_id, job_id, count(DISTINCT run_id) AS total_runs,
                   avg(d) AS avg_duration_seconds, min(d) AS min_duration_seconds,
                   max(d) AS max_duration_seconds,
                   quantile_disc(d, 0.5) AS median_duration_seconds
            FROM (SELECT workspace_id, job_id, run_id,
                         CAST(epoch(max(period_end_time)) - epoch(min(period_start_time)) AS BIGINT)
                             AS d
                  FROM slices WHERE period_start_time >= {SINCE} GROUP BY 1, 2, 3)
            GROUP BY 1, 2""",
    )


def test_active_runtime(slices, names):
    same(
        jobs.job_runtime_active(slices, names, 7, AS_OF).drop("job_name"),
        """SELECT workspace_id, job_id, count(DISTINCT run_id) AS total_runs,
                  avg(d) AS avg_duration_seconds, min(d) AS min_duration_seconds,
                  max(d) AS max_duration_seconds,
                  quantile_cont(d, 0.5) AS median_duration_seconds,
                  quantile_cont(d, 0.9) AS p90_duration_seconds,
                  quantile_cont(d, 0.95) AS p95_duration_seconds
           FROM (SELECT workspace_id, job_id, run_id,
                        CAST(sum(epoch(period_end_time - period_start_time)) AS BIGINT) AS d
                 FROM slices WHERE period_start_time > TIMESTAMP '2024-01-08 13:00:00'
                 GROUP BY 1, 2, 3)
           GROUP BY 1, 2""",
    )


def test_simple_data(slices):
    same(
        jobs.simple_job_data(slices, 7, AS_OF, limit=None),
        f"""SELECT workspace_id, job_id, count(DISTINCT run_id) AS total_runs,
                   count(DISTINCT CAST(period_start_time AS DATE)) AS active_days,
                   min(period_start_time) AS first_run, max(period_end_time) AS last_run
            FROM slices WHERE period_start_time >= {SINCE} GROUP BY 1, 2""",
    )


def test_activity(slices):
    same(
        jobs.recent_job_activity(slices, 7, AS_OF),
        f"""SELECT CAST(period_start_time AS DATE) AS job_date,
                   count(DISTINCT job_id) AS unique_jobs, count(DISTINCT run_id) AS total_runs,
                   count(DISTINCT run_id) FILTER (result_state = 'SUCCESS')
                       AS successful_runs,
                   count(DISTINCT run_id) FILTER (result_state IN {FAILED}) AS failed_runs
            FROM slices WHERE period_start_time >= {SINCE} AND result_state IS NOT NULL
            GROUP BY 1""",
    )


@pytest.mark.parametrize("policy", ["skip", "zero"])
def test_utilization(spark, policy):
    rng = np.random.default_rng(5)
    numbers = ["cpu_user_percent", "cpu_system_percent", "cpu_wait_percent", "mem_used_percent"]

    def maybe(value):
        return None if rng.random() < 0.2 else float(round(value, 3))

    rows = [
        (
            rng.choice(["x", "y"]) if rng.random() < 0.9 else None,
            f"i{rng.integers(3)}",
            bool(rng.integers(2)),
            AS_OF - timedelta(minutes=int(rng.integers(10 * 1440))),
            AS_OF,
            *[maybe(rng.random() * 100) for _ in numbers],
            int(rng.integers(10**9)),
            None,
        )
        for _ in range(2000)
    ]
    df = spark.createDataFrame(rows, SCHEMAS["node_timeline"])
    duckdb.register("nodes_table", pd.DataFrame(rows, columns=SCHEMAS["node_timeline"].names))
    num = {
        c: f"coalesce({c}, 0)" if policy == "zero" else c
        for c in [*numbers, "network_received_bytes"]
    }
    cpu = f"{num['cpu_user_percent']} + {num['cpu_system_percent']}"
    rollup = nodes.regroup(nodes.node_rollup(df, 7, AS_OF, policy), nodes.NODE_KEYS)
    figures = [
        "avg_cpu_utilization",
        "min_cpu_utilization",
        "max_cpu_wait",
        "avg_memory_utilization",
        "avg_network_mb_received_per_minute",
    ]
    same(
        nodes.utilization_view(rollup, figures, digits=6),
        f"""SELECT cluster_id, driver, count(*) AS data_points,
                   avg({cpu}) AS avg_cpu_utilization, min({cpu}) AS min_cpu_utilization,
                   max({num['cpu_wait_percent']}) AS max_cpu_wait,
                   avg({num['mem_used_percent']}) AS avg_memory_utilization,
                   avg({num['network_received_bytes']}) / 1048576
                       AS avg_network_mb_received_per_minute
            FROM nodes_table WHERE start_time >= {SINCE} GROUP BY 1, 2""",
    )
