"""The registered queries in DuckDB SQL over the raw test tables.

Written independently of the DataFrame code: distinct counts instead of flags
per run, joins before aggregation, unions of rules instead of arrays.
"""

from __future__ import annotations

import re

from fleetlens import wording

# The logical tables over the test tables; see ``bindings.py``.
VIEWS = {
    "job_run_timeline": """
        SELECT c_nationkey AS workspace_id, o_custkey AS job_id, o_orderkey AS run_id,
               o_orderdate + to_minutes((l_linenumber - 1) * 10) AS period_start_time,
               o_orderdate + to_minutes((l_linenumber - 1) * 10)
                           + to_minutes(CAST(l_quantity AS INTEGER)) AS period_end_time,
               CASE WHEN o_orderstatus = 'P' OR l_linestatus = 'O' THEN NULL
                    WHEN o_orderstatus = 'O' OR l_returnflag = 'R' THEN 'SUCCESS'
                    WHEN o_orderpriority = '1-URGENT' THEN 'FAILED'
                    WHEN o_orderpriority = '2-HIGH' THEN 'TIMEOUT'
                    WHEN o_orderpriority = '3-MEDIUM' THEN 'CANCELLED'
                    WHEN o_orderpriority = '5-LOW' THEN 'SKIPPED'
                    ELSE 'SUCCESS' END AS result_state
        FROM lineitem
        JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey""",
    "jobs": """
        SELECT c_nationkey AS workspace_id, c_custkey AS job_id,
               c_name || '/' || o_orderpriority AS name,
               o_orderdate + to_microseconds(o_orderkey) AS change_time
        FROM orders JOIN customer ON o_custkey = c_custkey
        WHERE c_custkey % 10 <> 0""",
    "keyed_events": """
        SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
               'c-' || lpad(CAST(user_id % 20 AS VARCHAR), 2, '0') AS cluster_id
        FROM events""",
    "node_timeline": """
        SELECT cluster_id, 'i-' || user_id AS instance_id,
               (user_id // 20) % 3 = 0 AS driver,
               ts AS start_time, ts + to_minutes(1) AS end_time,
               CASE WHEN event_type = 'error' AND k < 25 THEN NULL
                    ELSE (user_id % 20) * CAST(5.0 AS DOUBLE) + value / 50 END AS cpu_user_percent,
               k / 20 AS cpu_system_percent,
               CASE WHEN event_type = 'view' AND k < 25 THEN NULL
                    ELSE k / 4 + (user_id % 20) / CAST(4.0 AS DOUBLE) END AS cpu_wait_percent,
               CASE WHEN event_type = 'signup' AND k < 10 THEN NULL
                    ELSE least(CAST(99.0 AS DOUBLE),
                               (user_id * 7 % 20) * CAST(5.0 AS DOUBLE) + k / 20)
                    END AS mem_used_percent,
               CAST(round(value * 100) AS BIGINT) * 10000 AS network_received_bytes,
               CASE WHEN event_type = 'click' THEN NULL
                    ELSE CAST(round(value * 100) AS BIGINT) * 5000 END AS network_sent_bytes
        FROM keyed_events""",
    "clusters": """
        SELECT cluster_id, 'cluster-' || (user_id % 20) || '-v' || event_id AS cluster_name,
               CASE WHEN k < 50 THEN 'JOB' ELSE 'UI' END AS cluster_source,
               ts AS change_time, 'd' || (user_id % 4) AS driver_node_type_id,
               'w' || (user_id % 5) AS node_type_id, CAST(k AS BIGINT) % 8 AS num_workers
        FROM keyed_events WHERE event_type = 'signup' AND user_id % 20 <> 13""",
    "node_types": """
        SELECT DISTINCT p_type || '-' || p_size AS node_type,
               CAST(p_size * 1024 AS BIGINT) AS memory_mb,
               CAST(p_size % 16 + 1 AS DOUBLE) AS core_count,
               CAST(p_size % 3 AS BIGINT) AS gpu_count
        FROM part""",
    "billing_usage": """
        SELECT struct_pack(cluster_id := CASE WHEN event_type = 'view' THEN NULL
                                              ELSE cluster_id END) AS usage_metadata,
               'SKU_' || event_type AS sku_name, 'DBU' AS usage_unit,
               CAST(value AS DECIMAL(18, 2)) AS usage_quantity, CAST(ts AS DATE) AS usage_date
        FROM keyed_events""",
}

# Look-back bounds of the registered queries.
SINCE_DAY = "DATE '2001-08-01' - 365"
SINCE_INSTANT = "TIMESTAMP '2001-08-01 13:00:00' - to_days(365)"
NODES_SINCE = "DATE '2024-01-31' - 7"
INFO_SINCE = "DATE '2024-01-31' - 30"

FAILED = "('FAILED', 'TIMEOUT', 'CANCELLED')"
BY_CPU = "ORDER BY avg_cpu_utilization DESC NULLS LAST"
CPU = "cpu_user_percent + cpu_system_percent"
CPU0 = "coalesce(cpu_user_percent, 0) + coalesce(cpu_system_percent, 0)"
MB = "(1024 * 1024)"


def _r(value: str, digits: int = 2) -> str:
    return f"CAST(round(CAST({value} AS DECIMAL(38, 6)), {digits}) AS DOUBLE)"


def _percent(part: str, whole: str) -> str:
    return _r(f"({part}) * CAST(100 AS DOUBLE) / ({whole})")


def _found_issues(table: str, keys: str) -> str:
    return f"""
        SELECT {keys}, 1 AS rule_no, 'High CPU' AS rule,
               CASE WHEN avg_cpu_utilization > 90 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
               avg_cpu_utilization AS value
        FROM {table} WHERE avg_cpu_utilization > 80
        UNION ALL
        SELECT {keys}, 2, 'High Memory',
               CASE WHEN avg_memory_utilization > 95 THEN 'HIGH' ELSE 'MEDIUM' END,
               avg_memory_utilization
        FROM {table} WHERE avg_memory_utilization > 85
        UNION ALL
        SELECT {keys}, 3, 'High CPU Wait', 'MEDIUM', avg_cpu_wait
        FROM {table} WHERE avg_cpu_wait > 15
        UNION ALL
        SELECT {keys}, 4, 'Underutilized', 'LOW', avg_cpu_utilization
        FROM {table} WHERE avg_cpu_utilization < 20"""


def _worded_issues(table: str) -> str:
    return f"""
        SELECT *, '[' || severity || '] ' || message AS issue
        FROM (SELECT *, rule || ': Cluster ' || cluster_id || ' - '
                        || CASE WHEN rule_no = 4 THEN 'Only ' ELSE '' END
                        || printf('%.1f%%', {_r("value", 1)})
                        || CASE WHEN rule_no = 4 THEN ' CPU' ELSE '' END AS message
              FROM {table})"""


def _sweep(intervals: str, keys: str) -> str:
    """Instants at which intervals open or close, with the number that is active from there on."""
    by = f"PARTITION BY {keys} ORDER BY at_time" if keys else "ORDER BY at_time"
    also = f"{keys}, " if keys else ""
    return f"""
        SELECT *, sum(delta) OVER ({by}) AS active, lead(at_time) OVER ({by}) AS next_time
        FROM (SELECT {also}at_time, sum(delta) AS delta, sum(opened) AS opened
              FROM (SELECT {also}start_time AS at_time, 1 AS delta, 1 AS opened FROM {intervals}
                    UNION ALL SELECT {also}end_time, -1, 0 FROM {intervals})
              GROUP BY ALL)"""


def _peaks(sweep: str, keys: str) -> str:
    also = f"{keys}, " if keys else ""
    return f"""
        SELECT {also}CAST(max(active) AS BIGINT) AS peak_runs,
               min(at_time) FILTER (active = top) AS peak_start,
               CAST(sum(epoch_us(next_time) - epoch_us(at_time)) FILTER (active = top) AS BIGINT)
                   // 1000000 AS peak_seconds,
               CAST(sum(epoch_us(next_time) - epoch_us(at_time)) FILTER (active > 0) AS BIGINT)
                   // 1000000 AS busy_seconds,
               CAST(sum(active * (epoch_us(next_time) - epoch_us(at_time))) AS BIGINT)
                   // 1000000 AS run_seconds,
               {_r("""CAST(sum(active * (epoch_us(next_time) - epoch_us(at_time))) AS DOUBLE)
                      / sum(epoch_us(next_time) - epoch_us(at_time)) FILTER (active > 0)""", 4)}
                   AS avg_active_runs
        FROM (SELECT *, max(active) OVER ({f"PARTITION BY {keys}" if keys else ""}) AS top
              FROM {sweep})
        WHERE next_time IS NOT NULL {f"GROUP BY {keys}" if keys else ""}"""


def _usage(condition: str) -> str:
    return f"""
        SELECT workspace_id, job_id, job_name, measured_runs, n_readings, node_seconds,
               {_r("cpu_node_seconds", 4)} AS cpu_node_seconds,
               {_r("cpu_mean", 4)} AS avg_cpu_utilization, {_r("mem_mean", 4)} AS avg_memory_utilization,
               {_r("mem_peak", 4)} AS peak_memory_utilization
        FROM usage {condition}"""


def _schedules(condition: str) -> str:
    return f"""
        SELECT workspace_id, job_id, job_name, n_starts, {_r("period", 4)} AS period_seconds,
               {_r("mad", 4)} AS gap_mad_seconds, {_r("mad / period", 4)} AS gap_spread,
               {_r("concentration", 4)} AS phase_concentration
        FROM schedules {condition}"""


def _segmented(series: str, rounds: int) -> dict[str, str]:
    """Binary segmentation: the stretches, and the best split of each, round by round."""
    steps = {"stretch1": f"SELECT workspace_id, 1 AS part, day, v FROM {series}"}
    for n in range(1, rounds + 1):
        steps[f"sums{n}"] = f"""
        SELECT *, row_number() OVER w AS i, sum(v) OVER w AS behind, count(*) OVER p AS n,
               sum(v) OVER p AS total, sum(CAST(v AS DOUBLE) * v) OVER p AS squares,
               lead(day) OVER w AS next_day
        FROM stretch{n}
        WINDOW w AS (PARTITION BY workspace_id, part ORDER BY day), p AS (PARTITION BY workspace_id, part)"""
        steps[f"splits{n}"] = f"""
        SELECT *, abs(n * behind - i * total) / sqrt(n * squares - CAST(total AS DOUBLE) * total) / sqrt(n) AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id, part
                                           ORDER BY abs(n * behind - i * total) DESC, i) AS place
              FROM sums{n} WHERE i < n AND n >= 10)
        WHERE place = 1 AND n * squares > CAST(total AS DOUBLE) * total"""
        steps[f"changes{n}"] = f"SELECT * FROM splits{n} WHERE score > 0.8"
        steps[f"stretch{n + 1}"] = f"""
        SELECT workspace_id, 2 * s.part + CAST(s.i > c.i AS INTEGER) AS part, s.day, s.v
        FROM sums{n} s JOIN changes{n} c USING (workspace_id, part)"""
    return steps


# Steps shared by several queries; each may use the views and earlier steps.
STEPS = {
    "latest_job": """
        SELECT workspace_id, job_id, name, change_time FROM (
            SELECT *, row_number() OVER (PARTITION BY workspace_id, job_id
                                         ORDER BY change_time DESC, name DESC) AS rn
            FROM jobs) WHERE rn = 1""",
    "latest_cluster": """
        SELECT * EXCLUDE (rn, cluster_source) FROM (
            SELECT *, row_number() OVER (PARTITION BY cluster_id
                                         ORDER BY change_time DESC, cluster_name DESC) AS rn
            FROM clusters) WHERE rn = 1""",
    "envelopes": f"""
        SELECT workspace_id, job_id, run_id,
               CAST(epoch(max(period_end_time)) - epoch(min(period_start_time)) AS BIGINT)
                   AS duration_seconds
        FROM job_run_timeline WHERE period_start_time >= {SINCE_DAY} GROUP BY ALL""",
    "runs": f"""
        SELECT workspace_id, job_id, run_id, min(period_start_time) AS start_time,
               max(period_end_time) AS end_time,
               bool_or(coalesce(result_state = 'SUCCESS', false)) AS succeeded,
               bool_or(coalesce(result_state IN {FAILED}, false)) AS failed
        FROM job_run_timeline WHERE period_start_time >= {SINCE_DAY} GROUP BY ALL""",
    "named_runs": """
        SELECT r.*, coalesce(j.name, 'Job_' || r.job_id) AS job_name, j.change_time AS version_time
        FROM runs r ASOF LEFT JOIN jobs j
          ON r.workspace_id = j.workspace_id AND r.job_id = j.job_id
             AND r.start_time >= j.change_time""",
    "versioned_readings": f"""
        SELECT t.cluster_id, t.instance_id, t.driver, t.start_time, {CPU} AS cpu_percent,
               t.mem_used_percent, c.cluster_name, c.node_type_id AS node_type,
               CAST(c.num_workers AS DOUBLE) AS num_workers, c.change_time AS version_time
        FROM (SELECT * FROM node_timeline WHERE start_time >= {NODES_SINCE}) t
        ASOF LEFT JOIN clusters c ON t.cluster_id = c.cluster_id AND t.start_time >= c.change_time""",
    "run_sweep": _sweep("runs", "workspace_id"),
    "fleet_sweep": _sweep("runs", ""),
    "since_slices": f"""
        SELECT workspace_id, period_start_time AS start_time, period_end_time AS end_time
        FROM job_run_timeline WHERE period_start_time >= {SINCE_DAY}""",
    "slice_sweep": _sweep("since_slices", "workspace_id"),
    "run_spans": """
        SELECT workspace_id, job_id, run_id, 'c-' || lpad(CAST(job_id % 20 AS VARCHAR), 2, '0') AS cluster_id,
               min(moved + (period_start_time - date_trunc('day', period_start_time))) AS from_time,
               max(moved + (period_end_time - date_trunc('day', period_start_time))) AS to_time
        FROM (SELECT *, TIMESTAMP '2024-01-01' + to_minutes(run_id * 7919 % 41760) AS moved
              FROM job_run_timeline)
        WHERE moved + (period_start_time - date_trunc('day', period_start_time)) >= DATE '2024-01-31' - 7
        GROUP BY ALL""",
    "overlapping": f"""
        SELECT r.workspace_id, r.job_id, r.run_id, {CPU} AS cpu, t.mem_used_percent AS mem,
               epoch_us(least(to_time, end_time)) - epoch_us(greatest(from_time, start_time)) AS us
        FROM run_spans r JOIN node_timeline t
          ON r.cluster_id = t.cluster_id AND t.start_time < r.to_time AND r.from_time < t.end_time
        WHERE t.start_time >= DATE '2024-01-31' - 8""",
    "usage": f"""
        SELECT o.*, coalesce(j.name, 'Job_' || o.job_id) AS job_name
        FROM (SELECT workspace_id, job_id, count(DISTINCT run_id) AS measured_runs, count(*) AS n_readings,
                     coalesce(CAST(sum(us) FILTER (cpu IS NOT NULL) AS BIGINT), 0) // 1000000 AS node_seconds,
                     sum(us * cpu) / 1e8 AS cpu_node_seconds,
                     sum(us * cpu) / sum(us) FILTER (cpu IS NOT NULL) AS cpu_mean,
                     sum(us * mem) / sum(us) FILTER (mem IS NOT NULL) AS mem_mean,
                     max(mem) AS mem_peak
              FROM overlapping GROUP BY workspace_id, job_id) o
        LEFT JOIN latest_job j ON o.workspace_id = j.workspace_id AND o.job_id = j.job_id""",
    "starts": """
        SELECT workspace_id, job_id, start, lead(start) OVER (PARTITION BY workspace_id, job_id ORDER BY start) - start AS gap
        FROM (SELECT DISTINCT workspace_id, job_id, CAST(floor(epoch(start_time)) AS BIGINT) AS start FROM runs)""",
    "spread_gaps": """
        SELECT workspace_id, job_id, median(gap) AS period, mad(gap) AS mad
        FROM starts WHERE gap IS NOT NULL GROUP BY workspace_id, job_id""",
    "schedules": """
        SELECT s.workspace_id, s.job_id, coalesce(j.name, 'Job_' || s.job_id) AS job_name, n_starts, period, mad,
               concentration
        FROM (SELECT workspace_id, job_id, period, mad, count(*) AS n_starts,
                     sqrt(pow(avg(cos(2 * pi() * (start % period) / period)), 2)
                          + pow(avg(sin(2 * pi() * (start % period) / period)), 2)) AS concentration
              FROM starts JOIN spread_gaps USING (workspace_id, job_id) GROUP BY ALL) s
        LEFT JOIN latest_job j ON s.workspace_id = j.workspace_id AND s.job_id = j.job_id""",
    "run_seconds": """
        SELECT *, CAST(start_time AS DATE) AS day,
               CAST(epoch(end_time) - epoch(start_time) AS BIGINT) AS s
        FROM runs""",
    "daily_medians": """
        SELECT workspace_id, day, count(*) AS n_runs, quantile_disc(s, 0.5) AS v
        FROM run_seconds GROUP BY workspace_id, day""",
    "day_pairs": """
        SELECT a.workspace_id, CAST(b.v - a.v AS DOUBLE) / (b.day - a.day) AS slope, sign(b.v - a.v) AS up
        FROM daily_medians a JOIN daily_medians b ON a.workspace_id = b.workspace_id AND a.day < b.day""",
    "day_ties": """
        SELECT workspace_id, sum(t * (t - 1) * (2 * t + 5)) AS ties
        FROM (SELECT workspace_id, v, CAST(count(*) AS DOUBLE) AS t FROM daily_medians GROUP BY ALL)
        GROUP BY workspace_id""",
    "day_trends": """
        SELECT workspace_id, n, slope, fitted, (up - sign(up)) / sqrt((n * (n - 1.0) * (2 * n + 5) - ties) / 18) AS z
        FROM (SELECT workspace_id, median(slope) AS slope, CAST(sum(up) AS DOUBLE) AS up FROM day_pairs GROUP BY 1)
        JOIN day_ties USING (workspace_id)
        JOIN (SELECT workspace_id, count(*) AS n, regr_slope(v, day - DATE '1970-01-01') AS fitted
              FROM daily_medians GROUP BY 1) USING (workspace_id)
        WHERE n >= 5""",
    **_segmented("daily_medians", 3),
    "actives": f"""
        SELECT workspace_id, job_id, run_id,
               CAST(sum(epoch(period_end_time - period_start_time)) AS BIGINT) AS duration_seconds
        FROM job_run_timeline WHERE period_start_time > {SINCE_INSTANT} GROUP BY ALL""",
    "runtime": f"""
        SELECT r.workspace_id, r.job_id, coalesce(j.name, 'Job_' || r.job_id) AS job_name,
               count(DISTINCT run_id) AS total_runs,
               {_r("avg(duration_seconds)")} AS avg_duration_seconds,
               min(duration_seconds) AS min_duration_seconds,
               max(duration_seconds) AS max_duration_seconds,
               quantile_disc(duration_seconds, 0.5) AS median_duration_seconds,
               quantile_disc(duration_seconds, 0.9) AS p90_duration_seconds,
               quantile_disc(duration_seconds, 0.95) AS p95_duration_seconds
        FROM envelopes r LEFT JOIN latest_job j
          ON r.workspace_id = j.workspace_id AND r.job_id = j.job_id
        GROUP BY r.workspace_id, r.job_id, j.name""",
    "failures": f"""
        SELECT r.workspace_id, r.job_id, coalesce(j.name, 'Job_' || r.job_id) AS job_name,
               count(DISTINCT run_id) AS total_runs,
               count(DISTINCT run_id) FILTER (WHERE result_state = 'SUCCESS') AS successful_runs,
               count(DISTINCT run_id) FILTER (WHERE result_state IN {FAILED}) AS failed_runs,
               {_percent("count(DISTINCT run_id) FILTER (WHERE result_state = 'SUCCESS')",
                         "count(DISTINCT run_id)")} AS success_rate_percent,
               {_percent(f"count(DISTINCT run_id) FILTER (WHERE result_state IN {FAILED})",
                         "count(DISTINCT run_id)")} AS failure_rate_percent
        FROM job_run_timeline r LEFT JOIN latest_job j
          ON r.workspace_id = j.workspace_id AND r.job_id = j.job_id
        WHERE period_start_time >= {SINCE_DAY} AND result_state IS NOT NULL
        GROUP BY r.workspace_id, r.job_id, j.name""",
    "busy_groups": f"""
        SELECT cluster_id, driver, count(*) AS data_points,
               {_r(f"avg({CPU})")} AS avg_cpu_utilization,
               {_r(f"max({CPU})")} AS peak_cpu_utilization,
               {_r("avg(cpu_wait_percent)")} AS avg_cpu_wait,
               {_r("max(cpu_wait_percent)")} AS max_cpu_wait,
               {_r("avg(mem_used_percent)")} AS avg_memory_utilization,
               {_r("max(mem_used_percent)")} AS max_memory_utilization,
               {_r(f"avg(network_received_bytes) / {MB}")} AS avg_network_mb_received_per_minute,
               {_r(f"avg(network_sent_bytes) / {MB}")} AS avg_network_mb_sent_per_minute
        FROM node_timeline WHERE start_time >= {NODES_SINCE}
        GROUP BY cluster_id, driver HAVING count(*) > 5""",
    "top20": f"SELECT * FROM busy_groups {BY_CPU}, cluster_id, driver LIMIT 20",
    "utilization": f"""
        SELECT cluster_id, driver, count(*) AS data_points,
               {_r(f"avg({CPU0})")} AS avg_cpu_utilization,
               {_r(f"max({CPU0})")} AS peak_cpu_utilization,
               {_r("avg(coalesce(cpu_wait_percent, 0))")} AS avg_cpu_wait,
               {_r("avg(coalesce(mem_used_percent, 0))")} AS avg_memory_utilization,
               {_r("max(coalesce(mem_used_percent, 0))")} AS peak_memory_utilization,
               {_r(f"avg(coalesce(network_received_bytes, 0)) / {MB}")}
                   AS avg_network_mb_received_per_minute,
               {_r(f"avg(coalesce(network_sent_bytes, 0)) / {MB}")}
                   AS avg_network_mb_sent_per_minute
        FROM node_timeline WHERE start_time >= {NODES_SINCE}
        GROUP BY cluster_id, driver HAVING count(*) >= 5""",
    "instances": f"""
        SELECT t.cluster_id, c.cluster_name, c.driver_node_type_id, c.node_type_id, t.driver,
               t.instance_id,
               {_r(f"avg({CPU})", 4)} AS avg_cpu_utilization,
               {_r(f"max({CPU})", 4)} AS peak_cpu_utilization,
               {_r(f"min({CPU})", 4)} AS min_cpu_utilization,
               {_r("avg(cpu_wait_percent)", 4)} AS avg_cpu_wait,
               {_r("max(cpu_wait_percent)", 4)} AS max_cpu_wait,
               {_r("avg(mem_used_percent)", 4)} AS avg_memory_utilization,
               {_r("max(mem_used_percent)", 4)} AS peak_memory_utilization,
               {_r("min(mem_used_percent)", 4)} AS min_memory_utilization,
               {_r(f"avg(network_received_bytes) / {MB}", 4)} AS avg_network_mb_received_per_minute,
               {_r(f"avg(network_sent_bytes) / {MB}", 4)} AS avg_network_mb_sent_per_minute,
               count(*) AS measurement_count, min(t.start_time) AS monitoring_start,
               max(t.end_time) AS monitoring_end
        FROM node_timeline t LEFT JOIN latest_cluster c ON t.cluster_id = c.cluster_id
        WHERE t.start_time >= {NODES_SINCE}
        GROUP BY t.cluster_id, c.cluster_name, c.driver_node_type_id, c.node_type_id, t.driver,
                 t.instance_id""",
    "instance_means": f"""
        SELECT t.cluster_id, c.cluster_name, t.driver, t.instance_id,
               avg({CPU}) AS avg_cpu_utilization, avg(mem_used_percent) AS avg_memory_utilization
        FROM node_timeline t LEFT JOIN latest_cluster c ON t.cluster_id = c.cluster_id
        WHERE t.start_time >= {NODES_SINCE}
        GROUP BY t.cluster_id, c.cluster_name, t.driver, t.instance_id""",
    "cluster_means": f"""
        SELECT cluster_id, avg({CPU}) AS cpu, avg(mem_used_percent) AS mem,
               count(*) AS total_measurements, count(*) FILTER ({CPU} < 10) AS low_cpu_count,
               count(*) FILTER ({CPU} < 30) AS cpu_below_30,
               count(*) FILTER (mem_used_percent < 20) AS low_memory_count
        FROM node_timeline WHERE start_time >= {NODES_SINCE} GROUP BY cluster_id""",
    "efficiency": f"""
        SELECT cluster_id, {_r("cpu", 4)} AS avg_cpu_utilization,
               {_r("mem", 4)} AS avg_memory_utilization, total_measurements, low_cpu_count,
               low_memory_count,
               {_percent("low_cpu_count", "total_measurements")} AS low_cpu_percent,
               {_percent("low_memory_count", "total_measurements")} AS low_memory_percent,
               CASE WHEN cpu < 20 AND mem < 30 THEN 'Underutilized'
                    WHEN cpu > 80 OR mem > 85 THEN 'High Utilization'
                    ELSE 'Normal' END AS efficiency_category
        FROM cluster_means""",
    "costs": f"""
        SELECT u.cluster_id, c.cluster_name, u.sku_name, u.usage_unit,
               CAST(u.total_usage AS DOUBLE) AS total_usage, u.usage_records,
               c.driver_node_type_id, c.node_type_id,
               CAST(c.num_workers AS DOUBLE) AS num_workers
        FROM (SELECT usage_metadata['cluster_id'] AS cluster_id, sku_name, usage_unit,
                     sum(usage_quantity) AS total_usage, count(*) AS usage_records
              FROM billing_usage
              WHERE usage_date >= {NODES_SINCE} AND usage_metadata['cluster_id'] IS NOT NULL
              GROUP BY ALL) u
        LEFT JOIN latest_cluster c ON u.cluster_id = c.cluster_id""",
    "slow": f"""
        SELECT job_id, job_name, {_r("avg_duration_seconds / 60")} AS avg_duration_minutes,
               {_r("max_duration_seconds / 60")} AS max_duration_minutes
        FROM runtime WHERE avg_duration_seconds > 3600""",
    "failing": """
        SELECT job_id, job_name, failure_rate_percent, failed_runs, total_runs
        FROM failures WHERE failure_rate_percent > 10""",
    "underutilized": f"""
        SELECT cluster_id, cluster_name, {_r("avg_cpu_utilization")} AS avg_cpu_utilization,
               {_r("avg_memory_utilization")} AS avg_memory_utilization
        FROM instance_means WHERE avg_cpu_utilization < 20 AND avg_memory_utilization < 30""",
    "overutilized": f"""
        SELECT cluster_id, cluster_name, {_r("avg_cpu_utilization")} AS avg_cpu_utilization,
               {_r("avg_memory_utilization")} AS avg_memory_utilization
        FROM instance_means WHERE avg_cpu_utilization > 85 OR avg_memory_utilization > 90""",
    "inefficient": f"""
        SELECT cluster_id, {_r("cpu")} AS avg_cpu_utilization,
               {_percent("low_cpu_count", "total_measurements")} AS low_cpu_percent,
               {_percent("low_memory_count", "total_measurements")} AS low_memory_percent
        FROM cluster_means WHERE cpu < 20 AND mem < 30""",
    "found_issues": _found_issues("utilization", "cluster_id, driver"),
    "issues": f"""
        {_worded_issues("found_issues")}
        UNION ALL
        SELECT NULL, NULL, 5, NULL, 'OTHER', NULL, remark, remark
        FROM (SELECT CASE WHEN count(*) = 0 THEN '{wording.NO_ISSUE_DATA}'
                          ELSE '{wording.NO_ISSUES}' END AS remark FROM utilization)
        WHERE NOT EXISTS (SELECT 1 FROM found_issues)""",
    "severities": """
        SELECT severity, count(*) AS n_issues,
               CASE severity WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3
                             ELSE 4 END AS severity_rank
        FROM issues GROUP BY severity""",
    "balance": """
        SELECT cluster_id,
               sum(avg_cpu_utilization * data_points) / sum(data_points) AS avg_cpu,
               sum(avg_memory_utilization * data_points) / sum(data_points) AS avg_memory
        FROM utilization WHERE cluster_id IS NOT NULL GROUP BY cluster_id""",
    "given": f"""
        SELECT * FROM (
            SELECT 1 AS theme_rank, 'COST OPTIMIZATION' AS theme, count(*) AS n,
                   count(*) || ' clusters with <30% CPU usage could be downsized' AS message
            FROM utilization WHERE avg_cpu_utilization < 30
            UNION ALL
            SELECT 2, 'PERFORMANCE', count(*),
                   count(*) || ' clusters with >85% CPU usage may need scaling'
            FROM utilization WHERE avg_cpu_utilization > 85
            UNION ALL
            SELECT 3, 'MEMORY', count(*),
                   count(*) || ' clusters with >90% memory usage need attention'
            FROM utilization WHERE avg_memory_utilization > 90
            UNION ALL
            SELECT 4, 'BALANCE', count(*),
                   count(*) || ' unique clusters show CPU/Memory imbalance'
            FROM balance WHERE abs(avg_cpu - avg_memory) > 40) WHERE n > 0""",
    "advice": f"""
        SELECT * FROM given
        UNION ALL
        SELECT 5, 'OTHER', NULL,
               (SELECT CASE WHEN count(*) = 0 THEN '{wording.NO_RECOMMENDATION_DATA}'
                            ELSE '{wording.NO_RECOMMENDATIONS}' END FROM utilization)
        WHERE NOT EXISTS (SELECT 1 FROM given)""",
    "kpis": f"""
        SELECT metric_no, metric, value,
               CASE WHEN metric_no = 1 THEN CAST(CAST(value AS BIGINT) AS VARCHAR)
                    ELSE printf('%.2f%%', value) END AS text
        FROM (SELECT 1 AS metric_no, 'Clusters analyzed' AS metric,
                     CAST(count(*) AS DOUBLE) AS value FROM utilization
              UNION ALL SELECT 2, 'Average CPU utilization',
                     {_r("avg(avg_cpu_utilization)")} FROM utilization
              UNION ALL SELECT 3, 'Peak CPU utilization',
                     {_r("max(peak_cpu_utilization)")} FROM utilization
              UNION ALL SELECT 4, 'Average memory utilization',
                     {_r("avg(avg_memory_utilization)")} FROM utilization
              UNION ALL SELECT 5, 'Peak memory utilization',
                     {_r("max(peak_memory_utilization)")} FROM utilization)
        WHERE (SELECT count(*) FROM utilization) > 0""",
    "quantiles": "\n        UNION ALL\n".join(
        f"""        SELECT '{label}' AS metric,
               {_r(f"quantile_cont({column}, 0.5)")} AS p50,
               {_r(f"quantile_cont({column}, 0.75)")} AS p75,
               {_r(f"quantile_cont({column}, 0.9)")} AS p90,
               {_r(f"quantile_cont({column}, 0.95)")} AS p95
        FROM utilization"""
        for label, column in (
            ("CPU utilization", "avg_cpu_utilization"),
            ("Memory utilization", "avg_memory_utilization"),
        )
    ),
    "job_figures": f"""
        SELECT metric_no, metric, value,
               CASE WHEN metric_no IN (1, 4, 5) THEN CAST(CAST(value AS BIGINT) AS VARCHAR)
                    WHEN metric_no = 2 THEN printf('%.2f minutes', value)
                    ELSE printf('%.2f%%', value) END AS text
        FROM (SELECT 1 AS metric_no, 'Total Jobs Monitored' AS metric,
                     CAST(nullif(count(*), 0) AS DOUBLE) AS value FROM runtime
              UNION ALL SELECT 2, 'Average Job Runtime',
                     {_r("avg(avg_duration_seconds) / 60")} FROM runtime
              UNION ALL SELECT 3, 'Average Success Rate',
                     {_r("avg(success_rate_percent)")} FROM failures
              UNION ALL SELECT 4, 'Total Job Runs', CAST(sum(total_runs) AS DOUBLE) FROM failures
              UNION ALL SELECT 5, 'Total Failures', CAST(sum(failed_runs) AS DOUBLE) FROM failures
              UNION ALL SELECT 6, 'Average CPU Utilization',
                     {_r("avg(avg_cpu_utilization)")} FROM top20
              UNION ALL SELECT 7, 'Average Memory Utilization',
                     {_r("avg(avg_memory_utilization)")} FROM top20
              UNION ALL SELECT 8, 'Average CPU Utilization (all groups)',
                     {_r("avg(avg_cpu_utilization)")} FROM busy_groups
              UNION ALL SELECT 9, 'Average Memory Utilization (all groups)',
                     {_r("avg(avg_memory_utilization)")} FROM busy_groups)
        WHERE value IS NOT NULL""",
    "monitor_figures": f"""
        SELECT metric_no, metric, value,
               CASE WHEN metric_no = 1 THEN CAST(CAST(value AS BIGINT) AS VARCHAR)
                    ELSE printf('%.1f%%', value) END AS text
        FROM (SELECT 1 AS metric_no, 'Total Clusters Monitored' AS metric,
                     CAST(count(DISTINCT cluster_id) AS DOUBLE) AS value FROM instance_means
              UNION ALL SELECT 2, 'Average CPU Utilization',
                     {_r("avg(avg_cpu_utilization)", 1)} FROM instance_means
              UNION ALL SELECT 3, 'Average Memory Utilization',
                     {_r("avg(avg_memory_utilization)", 1)} FROM instance_means)""",
    "bundle_counts": """
        SELECT 'cluster_utilization' AS table_name, count(*) AS n_records FROM instances
        UNION ALL SELECT 'node_types', count(*) FROM node_types
        UNION ALL SELECT 'efficiency_metrics', count(*) FROM efficiency
        UNION ALL SELECT 'cost_analysis', count(*) FROM costs""",
    "windows": f"""
        SELECT date_trunc('day', start_time) AS window_start,
               date_trunc('day', start_time) + to_days(1) AS window_end,
               cluster_id, driver, count(*) AS data_points,
               {_r(f"avg({CPU0})")} AS avg_cpu_utilization,
               {_r(f"max({CPU0})")} AS peak_cpu_utilization,
               {_r("avg(coalesce(cpu_wait_percent, 0))")} AS avg_cpu_wait,
               {_r("avg(coalesce(mem_used_percent, 0))")} AS avg_memory_utilization,
               {_r("max(coalesce(mem_used_percent, 0))")} AS peak_memory_utilization,
               {_r(f"avg(coalesce(network_received_bytes, 0)) / {MB}")}
                   AS avg_network_mb_received_per_minute,
               {_r(f"avg(coalesce(network_sent_bytes, 0)) / {MB}")}
                   AS avg_network_mb_sent_per_minute
        FROM node_timeline
        WHERE date_trunc('day', start_time) + to_days(1)
              <= (SELECT max(start_time) - to_hours(2) FROM node_timeline)
        GROUP BY 1, 2, 3, 4""",
    "window_issues": _found_issues("windows", "window_start, window_end, cluster_id, driver"),
}


def _line(section: str, ord: str, rank: str, line: str, rest: str = "") -> str:
    return (
        f"SELECT '{section}' AS section, {ord} AS ord, CAST({rank} AS DOUBLE) AS rank, "
        f"{line} AS line {rest}"
    )


def _fixed(section: str, lines: dict[int, str]) -> list[str]:
    return [_line(section, str(ord), "0", f"'{line}'") for ord, line in lines.items()]


def _first_hits(table: str, condition: str, order: str, ord: int, heading: str, line: str) -> list:
    """A heading with the number of hits, then the first five."""
    before, after = heading.split("%d")
    return [
        _line(
            "anomalies",
            str(ord),
            "0",
            f"'### {before}' || count(*) || '{after}'",
            f"FROM {table} WHERE {condition} HAVING count(*) > 0",
        ),
        _line(
            "anomalies",
            str(ord + 1),
            "rn",
            line,
            f"FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS rn "
            f"FROM {table} WHERE {condition}) WHERE rn <= 5",
        ),
    ]


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _top_line(ord: int, step: str, columns: list[str]) -> str:
    shown = " || ', ' || ".join(
        f"printf('{name.replace('_utilization', '').replace('_', ' ')} %.2f%%', {name})"
        for name in columns
    )
    return _line(
        "top_consumers",
        str(ord),
        f"-{columns[0]}",
        f"cluster_id || ', driver ' || driver || ': ' || {shown}".replace(
            "cluster_id ||", "'- ' || cluster_id ||", 1
        ),
        f"FROM ({step})",
    )


TOP_CPU_COLUMNS = ["avg_cpu_utilization", "peak_cpu_utilization", "avg_memory_utilization"]
TOP_MEMORY_COLUMNS = ["avg_memory_utilization", "peak_memory_utilization", "avg_cpu_utilization"]


def _top(columns: list[str]) -> str:
    return (
        f"SELECT cluster_id, driver, {', '.join(columns)} FROM utilization "
        f"ORDER BY {columns[0]} DESC NULLS LAST, cluster_id, driver LIMIT 10"
    )


def _job_report() -> str:
    return _union(
        _fixed(
            "header",
            {
                1: "# Job Monitoring Report",
                2: "Generated: 2001-08-01 13:00:00",
                3: "Period: Last 365 days",
                4: "## Summary Statistics",
            },
        )
        + [
            _line(
                "summary", "10", "metric_no", "'- ' || metric || ': ' || text", "FROM job_figures"
            )
        ]
        + _fixed("anomalies", {20: "## Detected Anomalies"})
        + _first_hits(
            "runtime",
            "avg_duration_seconds > 3600",
            "avg_duration_seconds DESC NULLS LAST, workspace_id, job_id",
            21,
            "Long Running Jobs (%d detected)",
            "'- **' || job_name || '** (ID: ' || job_id || '): Avg ' || "
            f"CAST({_r('avg_duration_seconds / 60')} AS VARCHAR) || ' min'",
        )
        + _first_hits(
            "failures",
            "failure_rate_percent > 10",
            "failure_rate_percent DESC NULLS LAST, total_runs DESC, workspace_id, job_id",
            31,
            "High Failure Rate Jobs (%d detected)",
            "'- **' || job_name || '** (ID: ' || job_id || '): ' || "
            "CAST(failure_rate_percent AS VARCHAR) || '% failure rate'",
        )
        + _fixed("details", {40: "## Details"})
        + [
            _rows_of("job_health", "runtime", 41, 365),
            _rows_of("cluster_utilization", "busy_groups", 42, 365),
        ]
    )


def _rows_of(name: str, table: str, ord: int, days: int) -> str:
    text = f"'- {name}: ' || count(*) || ' rows since midnight {days} days ago'"
    return _line("details", str(ord), "0", text, f"FROM {table}")


def _monitor_report() -> str:
    order = f"{BY_CPU.removeprefix('ORDER BY ')}, cluster_id, driver, instance_id"
    line = (
        "'- **' || coalesce(cluster_name, cluster_id) || '**: CPU ' || "
        f"CAST({_r('avg_cpu_utilization')} AS VARCHAR) || '%, Memory ' || "
        f"CAST({_r('avg_memory_utilization')} AS VARCHAR) || '%'"
    )
    return _union(
        _fixed(
            "header",
            {
                1: "# Cluster Monitoring Report",
                2: "Generated: 2024-01-31 13:00:00",
                3: "Period: Last 7 days",
                4: "## Cluster Summary",
            },
        )
        + [
            _line(
                "summary",
                "10",
                "metric_no",
                "'- ' || metric || ': ' || text",
                "FROM monitor_figures",
            )
        ]
        + _fixed("anomalies", {20: "## Detected Issues"})
        + _first_hits(
            "instance_means",
            "avg_cpu_utilization < 20 AND avg_memory_utilization < 30",
            order,
            21,
            "Underutilized Clusters (%d found)",
            line,
        )
        + _first_hits(
            "instance_means",
            "avg_cpu_utilization > 85 OR avg_memory_utilization > 90",
            order,
            31,
            "Overutilized Clusters (%d found)",
            line,
        )
    )


def _cluster_report() -> str:
    labels = ("p50", "p75", "p90", "p95")
    quantiles = " || ', ' || ".join(f"printf('{name} %.2f', {name})" for name in labels)
    return _union(
        _fixed(
            "metadata",
            {
                1: "# Cluster Performance Analysis Report",
                2: "## Run Metadata",
                3: "- Generated: 2024-01-31 13:00:00",
                4: "- Time Window: 2024-01-24 13:00 to 2024-01-31 13:00",
                5: "- Analysis days: 7",
                6: "- CPU threshold: 80%",
                7: "- Memory threshold: 85%",
                8: "- Min datapoints: 5",
                10: "## Key Metrics",
                12: "### Quantiles",
                20: "## Top Consumers",
                21: "### Top 10 by Average CPU Utilization",
                23: "### Top 10 by Average Memory Utilization",
                30: "## Performance Issues",
                50: "## Recommendations",
                70: "## Appendix: Queries",
                71: "- Utilization: node_timeline since midnight 7 days ago, grouped by "
                "cluster_id and driver, missing readings as 0, at least 5 readings per group",
                72: "- Cluster info: distinct versions of clusters since midnight 30 days ago, "
                "newest first",
                73: "## Appendix: Details",
            },
        )
        + [
            _line("key_metrics", "11", "metric_no", "'- ' || metric || ': ' || text", "FROM kpis"),
            _line(
                "key_metrics", "13", "0", f"'- ' || metric || ': ' || {quantiles}", "FROM quantiles"
            ),
            _top_line(22, _top(TOP_CPU_COLUMNS), TOP_CPU_COLUMNS),
            _top_line(24, _top(TOP_MEMORY_COLUMNS), TOP_MEMORY_COLUMNS),
            _line(
                "issues",
                "30 + severity_rank * 3",
                "0",
                "'### ' || severity || ' (' || n_issues || ')'",
                "FROM severities",
            ),
            _line(
                "issues",
                "31 + severity_rank * 3",
                "rule_no * 1000000 - coalesce(value, 0)",
                "'- ' || message",
                "FROM issues JOIN severities USING (severity)",
            ),
            _line("recommendations", "50 + theme_rank * 2", "0", "'### ' || theme", "FROM advice"),
            _line("recommendations", "51 + theme_rank * 2", "0", "'- ' || message", "FROM advice"),
            _rows_of("cluster_utilization", "utilization", 74, 7),
        ]
    )


def _window_rows(condition: str) -> str:
    return (
        "SELECT count(*) AS n_slices, min(period_start_time) AS first_start, "
        f"max(period_start_time) AS last_start FROM job_run_timeline WHERE {condition}"
    )


# Width of each bound table; the timeline carries its calendar day as well.
WIDTHS = {
    "job_run_timeline": 7,
    "jobs": 4,
    "node_timeline": 11,
    "clusters": 7,
    "node_types": 4,
    "billing_usage": 5,
}


def _bodies() -> dict[str, str]:
    """The last SELECT of each query."""
    return {
        "job_runtime_metrics": "SELECT * FROM runtime",
        "job_failure_analysis": "SELECT * FROM failures",
        "simple_job_data": f"""
            SELECT workspace_id, job_id, count(DISTINCT run_id) AS total_runs,
                   count(DISTINCT CAST(period_start_time AS DATE)) AS active_days,
                   min(period_start_time) AS first_run, max(period_end_time) AS last_run
            FROM job_run_timeline WHERE period_start_time >= {SINCE_DAY}
            GROUP BY workspace_id, job_id
            ORDER BY total_runs DESC, workspace_id, job_id LIMIT 20""",
        "recent_job_activity": f"""
            SELECT strftime(period_start_time, '%Y-%m-%d') AS job_date,
                   count(DISTINCT job_id) AS unique_jobs, count(DISTINCT run_id) AS total_runs,
                   count(DISTINCT run_id) FILTER (WHERE result_state = 'SUCCESS')
                       AS successful_runs,
                   count(DISTINCT run_id) FILTER (WHERE result_state IN {FAILED}) AS failed_runs
            FROM job_run_timeline
            WHERE period_start_time >= {SINCE_DAY} AND result_state IS NOT NULL
            GROUP BY 1""",
        "job_runtime_active": f"""
            SELECT r.workspace_id, r.job_id, j.name AS job_name,
                   count(DISTINCT run_id) AS total_runs,
                   {_r("avg(duration_seconds)", 4)} AS avg_duration_seconds,
                   min(duration_seconds) AS min_duration_seconds,
                   max(duration_seconds) AS max_duration_seconds,
                   {_r("quantile_cont(duration_seconds, 0.5)", 4)} AS median_duration_seconds,
                   {_r("quantile_cont(duration_seconds, 0.9)", 4)} AS p90_duration_seconds,
                   {_r("quantile_cont(duration_seconds, 0.95)", 4)} AS p95_duration_seconds
            FROM actives r LEFT JOIN latest_job j
              ON r.workspace_id = j.workspace_id AND r.job_id = j.job_id
            GROUP BY r.workspace_id, r.job_id, j.name""",
        "job_failure_slices": f"""
            SELECT workspace_id, job_id, job_name, total_runs, successful_runs, failed_runs,
                   {_percent("successful_runs", "total_runs")} AS success_rate_percent,
                   {_percent("failed_runs", "total_runs")} AS failure_rate_percent
            FROM (SELECT r.workspace_id, r.job_id, j.name AS job_name, count(*) AS total_runs,
                         count(*) FILTER (result_state = 'SUCCESS') AS successful_runs,
                         count(*) FILTER (result_state IN {FAILED}) AS failed_runs
                  FROM job_run_timeline r LEFT JOIN latest_job j
                    ON r.workspace_id = j.workspace_id AND r.job_id = j.job_id
                  WHERE period_start_time > {SINCE_INSTANT}
                  GROUP BY r.workspace_id, r.job_id, j.name)""",
        "runs_asof_jobs": """
            SELECT workspace_id, job_id, run_id, start_time AS started, succeeded, failed,
                   CAST(epoch(end_time) - epoch(start_time) AS BIGINT) AS envelope_seconds,
                   job_name, version_time
            FROM named_runs""",
        "job_health_by_name": f"""
            SELECT workspace_id, job_id, job_name, count(*) AS total_runs,
                   min(start_time) AS first_start, max(start_time) AS last_start,
                   {_r("avg(epoch(end_time) - epoch(start_time))")} AS avg_duration_seconds,
                   count(*) FILTER (succeeded) AS successful_runs,
                   count(*) FILTER (failed) AS failed_runs,
                   {_percent("count(*) FILTER (succeeded)", "count(*)")} AS success_rate_percent,
                   {_percent("count(*) FILTER (failed)", "count(*)")} AS failure_rate_percent
            FROM named_runs GROUP BY workspace_id, job_id, job_name""",
        "readings_asof_clusters": f"""
            SELECT * REPLACE ({_r("cpu_percent", 4)} AS cpu_percent,
                              {_r("mem_used_percent", 4)} AS mem_used_percent)
            FROM versioned_readings""",
        "cluster_utilization_by_version": f"""
            SELECT cluster_id, cluster_name, node_type, num_workers, version_time,
                   count(*) AS data_points, count(DISTINCT instance_id) AS n_instances,
                   {_r("avg(cpu_percent)", 4)} AS avg_cpu_utilization,
                   {_r("avg(mem_used_percent)", 4)} AS avg_memory_utilization
            FROM versioned_readings GROUP BY ALL""",
        "concurrency_levels": """
            SELECT workspace_id, CAST(active AS BIGINT) AS active_runs,
                   CAST(sum(epoch_us(next_time) - epoch_us(at_time)) AS BIGINT) AS active_micros,
                   min(epoch_us(at_time)) AS first_at
            FROM run_sweep WHERE next_time IS NOT NULL GROUP BY workspace_id, active""",
        "peak_concurrency": _peaks("run_sweep", "workspace_id"),
        "peak_concurrency_fleet": _peaks("fleet_sweep", ""),
        "busy_periods": """
            SELECT workspace_id, min(at_time) AS period_start, max(at_time) AS period_end,
                   CAST(epoch(max(at_time)) - epoch(min(at_time)) AS BIGINT) AS busy_seconds,
                   CAST(sum(opened) AS BIGINT) AS n_slices, CAST(max(active) AS BIGINT) AS peak_slices
            FROM (SELECT *, sum(CASE WHEN active > 0 AND active = delta THEN 1 ELSE 0 END)
                                OVER (PARTITION BY workspace_id ORDER BY at_time) AS period
                  FROM slice_sweep)
            GROUP BY workspace_id, period""",
        "duration_quantiles": """
            SELECT workspace_id, count(*) AS n_runs,
                   CAST(quantile_disc(s, 0.5) AS DOUBLE) AS median_duration_seconds,
                   CAST(quantile_disc(s, 0.9) AS DOUBLE) AS p90_duration_seconds,
                   CAST(quantile_disc(s, 0.95) AS DOUBLE) AS p95_duration_seconds
            FROM run_seconds GROUP BY workspace_id""",
        "job_duration_quantiles": """
            SELECT workspace_id, job_id, count(*) AS n_runs,
                   CAST(quantile_disc(s, 0.5) AS DOUBLE) AS median_duration_seconds,
                   CAST(quantile_disc(s, 0.9) AS DOUBLE) AS p90_duration_seconds,
                   CAST(quantile_disc(s, 0.95) AS DOUBLE) AS p95_duration_seconds
            FROM run_seconds GROUP BY workspace_id, job_id""",
        "statistical_anomalies": """
            SELECT workspace_id, strftime(day, '%Y-%m-%d') AS day, n_runs, CAST(v AS DOUBLE) AS median_seconds,
                   baseline_runs, CAST(baseline_median AS DOUBLE) AS baseline_median_seconds, baseline_percent,
                   CASE WHEN baseline_percent >= 95 THEN 'slower' ELSE 'faster' END AS direction
            FROM (SELECT m.workspace_id, m.day, m.n_runs, m.v, count(*) AS baseline_runs,
                         quantile_disc(b.s, 0.5) AS baseline_median,
                         100 * count(*) FILTER (b.s <= m.v) // count(*) AS baseline_percent
                  FROM daily_medians m JOIN run_seconds b
                    ON m.workspace_id = b.workspace_id AND b.day < DATE '2001-08-01' - 60
                  WHERE m.day >= DATE '2001-08-01' - 60 GROUP BY ALL)
            WHERE baseline_runs >= 20 AND (baseline_percent >= 95 OR baseline_percent < 5)""",
        "duration_trends": f"""
            SELECT workspace_id, n AS n_days, {_r("slope", 4)} AS seconds_per_day,
                   {_r("fitted", 4)} AS fitted_seconds_per_day, {_r("z", 4)} AS mann_kendall_z,
                   CASE WHEN z > 1.96 THEN 'rising' WHEN z < -1.96 THEN 'falling' ELSE 'steady' END AS trend
            FROM day_trends""",
        "duration_changes": _union(
            [
                f"""SELECT workspace_id, strftime(next_day, '%Y-%m-%d') AS change_day, {n} AS round,
                   i AS days_before, n - i AS days_after,
                   {_r("CAST(behind AS DOUBLE) / i", 4)} AS mean_before_seconds,
                   {_r("CAST(total - behind AS DOUBLE) / (n - i)", 4)} AS mean_after_seconds,
                   {_r("score", 4)} AS score
                FROM changes{n}"""
                for n in (1, 2, 3)
            ]
        ),
        "job_resource_usage": _usage(""),
        "resource_intensive_jobs": _usage("WHERE cpu_mean > 80 OR mem_mean > 85"),
        "job_schedules": _schedules(""),
        "irregular_schedules": _schedules(
            "WHERE n_starts >= 5 AND mad / period > 0.25 AND concentration < 0.75"
        ),
        "run_durations": "SELECT * FROM envelopes",
        "run_durations_active": "SELECT * FROM actives",
        "lookback_calendar": _window_rows(f"period_start_time >= {SINCE_DAY}"),
        "lookback_rolling": _window_rows(f"period_start_time > {SINCE_INSTANT}"),
        "formatted_durations": f"""
            SELECT *, CASE
                WHEN duration_seconds < 60 THEN printf('%.1fs', {_r("duration_seconds", 1)})
                WHEN duration_seconds < 3600 THEN printf('%.1fm', {_r("duration_seconds / 60", 1)})
                ELSE printf('%.1fh', {_r("duration_seconds / 3600", 1)}) END AS duration
            FROM envelopes""",
        "standard_percentiles": f"""
            SELECT 'duration_seconds' AS metric,
                   {_r("quantile_cont(duration_seconds, 0.5)", 4)} AS p50,
                   {_r("quantile_cont(duration_seconds, 0.9)", 4)} AS p90,
                   {_r("quantile_cont(duration_seconds, 0.95)", 4)} AS p95,
                   {_r("quantile_cont(duration_seconds, 0.99)", 4)} AS p99
            FROM envelopes""",
        "cluster_utilization_top20": "SELECT * FROM top20",
        "cluster_utilization_zero": "SELECT * FROM utilization",
        "cluster_utilization_raw": f"""
            SELECT cluster_id, driver,
                   {_r(f"avg({CPU})", 4)} AS avg_cpu_utilization,
                   {_r(f"max({CPU})", 4)} AS peak_cpu_utilization,
                   {_r("avg(cpu_wait_percent)", 4)} AS avg_cpu_wait,
                   {_r("max(cpu_wait_percent)", 4)} AS max_cpu_wait,
                   {_r("avg(mem_used_percent)", 4)} AS avg_memory_utilization,
                   {_r("max(mem_used_percent)", 4)} AS max_memory_utilization,
                   {_r(f"avg(network_received_bytes) / {MB}", 4)}
                       AS avg_network_mb_received_per_minute,
                   {_r(f"avg(network_sent_bytes) / {MB}", 4)} AS avg_network_mb_sent_per_minute
            FROM node_timeline WHERE start_time >= {NODES_SINCE} GROUP BY cluster_id, driver""",
        "cluster_instance_utilization": "SELECT * FROM instances",
        "cluster_efficiency": "SELECT * FROM efficiency",
        "cluster_efficiency_limits": f"""
            SELECT cluster_id, {_r("cpu", 4)} AS avg_cpu_utilization,
                   {_r("mem", 4)} AS avg_memory_utilization, total_measurements,
                   cpu_below_30 AS low_cpu_count, low_memory_count,
                   {_percent("cpu_below_30", "total_measurements")} AS low_cpu_percent,
                   {_percent("low_memory_count", "total_measurements")} AS low_memory_percent,
                   CASE WHEN cpu < 70 AND mem < 70 THEN 'Underutilized'
                        WHEN cpu > 80 OR mem > 85 THEN 'High Utilization'
                        ELSE 'Normal' END AS efficiency_category
            FROM cluster_means""",
        "rollup_utilization_top20": "SELECT * FROM top20",
        "rollup_utilization_zero": "SELECT * FROM utilization",
        "rollup_efficiency": "SELECT * FROM efficiency",
        "cluster_report_details": "SELECT * FROM utilization",
        "reading_percentiles": _union(
            [
                f"""SELECT '{label}' AS metric,
                   {_r(f"quantile_cont({column}, 0.5)", 4)} AS p50,
                   {_r(f"quantile_cont({column}, 0.9)", 4)} AS p90,
                   {_r(f"quantile_cont({column}, 0.95)", 4)} AS p95,
                   {_r(f"quantile_cont({column}, 0.99)", 4)} AS p99
                FROM node_timeline"""
                for label, column in (("cpu", CPU), ("memory", "mem_used_percent"))
            ]
        ),
        "cluster_basic_info": f"""
            SELECT DISTINCT cluster_id, cluster_name, cluster_source, change_time
            FROM clusters WHERE change_time >= {INFO_SINCE}""",
        "node_types": """
            SELECT node_type AS node_type_id, memory_mb, core_count AS num_cores,
                   gpu_count AS num_gpus FROM node_types""",
        "cluster_costs": "SELECT * FROM costs",
        "expensive_clusters": f"""
            SELECT usage_unit, place, s.cluster_id, cluster_name, CAST(total_usage AS DOUBLE) AS total_usage,
                   {_r("total_usage * CAST(100 AS DOUBLE) / total", 4)} AS share_percent,
                   {_r("running * CAST(100 AS DOUBLE) / total", 4)} AS running_percent
            FROM (SELECT *, row_number() OVER w AS place, sum(total_usage) OVER w AS running,
                         sum(total_usage) OVER (PARTITION BY usage_unit) AS total
                  FROM (SELECT usage_unit, usage_metadata['cluster_id'] AS cluster_id,
                               sum(usage_quantity) AS total_usage
                        FROM billing_usage
                        WHERE usage_date >= {NODES_SINCE} AND usage_metadata['cluster_id'] IS NOT NULL
                        GROUP BY ALL HAVING sum(usage_quantity) > 0)
                  WINDOW w AS (PARTITION BY usage_unit ORDER BY total_usage DESC, cluster_id)) s
            LEFT JOIN latest_cluster c ON s.cluster_id = c.cluster_id
            WHERE (running - total_usage) * 100 < total * 80""",
        "latest_jobs": "SELECT * FROM latest_job",
        "latest_clusters": "SELECT * FROM latest_cluster",
        "top_cpu": _top(TOP_CPU_COLUMNS),
        "top_memory": _top(TOP_MEMORY_COLUMNS),
        "threshold_levels": """
            SELECT cluster_id, driver, avg_cpu_utilization,
                   CASE WHEN avg_cpu_utilization >= 90 THEN 'critical'
                        WHEN avg_cpu_utilization >= 80 THEN 'warning'
                        ELSE 'normal' END AS level
            FROM utilization""",
        "anomaly_long_running": "SELECT * FROM slow",
        "anomaly_high_failure": "SELECT * FROM failing",
        "anomaly_underutilized": "SELECT * FROM underutilized",
        "anomaly_overutilized": "SELECT * FROM overutilized",
        "anomaly_inefficient": "SELECT * FROM inefficient",
        "job_anomalies": """
            SELECT 'long_running_jobs' AS kind, * FROM slow
            UNION ALL BY NAME
            SELECT 'high_failure_rates' AS kind, job_id, job_name, failure_rate_percent,
                   CAST(failed_runs AS DOUBLE) AS failed_runs,
                   CAST(total_runs AS DOUBLE) AS total_runs
            FROM failing""",
        "cluster_anomalies": """
            SELECT 'underutilized_clusters' AS kind, * FROM underutilized
            UNION ALL BY NAME SELECT 'overutilized_clusters' AS kind, * FROM overutilized
            UNION ALL BY NAME SELECT 'inefficient_clusters' AS kind, * FROM inefficient""",
        "performance_issues": "SELECT * FROM issues",
        "issues_without_data": _no_issues("late"),
        "issues_none_found": _no_issues("utilization"),
        "recommendations_without_data": _no_advice("late"),
        "recommendations_none_found": _no_advice("utilization"),
        "instance_utilization_null_cluster": "SELECT * FROM lost_instances",
        "issues_by_severity": "SELECT * FROM severities",
        "recommendations": "SELECT * FROM advice",
        "imbalanced_clusters": f"""
            SELECT cluster_id, {_r("avg_cpu", 4)} AS avg_cpu, {_r("avg_memory", 4)} AS avg_memory,
                   {_r("abs(avg_cpu - avg_memory)", 4)} AS gap
            FROM balance WHERE abs(avg_cpu - avg_memory) > 40""",
        "cluster_kpis": "SELECT * FROM kpis",
        "cluster_quantiles": "SELECT * FROM quantiles",
        "job_report_summary": "SELECT * FROM job_figures",
        "job_report_lines": _job_report(),
        "cluster_monitor_summary": "SELECT * FROM monitor_figures",
        "cluster_monitor_lines": _monitor_report(),
        "cluster_report_lines": _cluster_report(),
        "metrics_summary": """
            SELECT * FROM bundle_counts
            UNION ALL SELECT 'total_records', CAST(sum(n_records) AS BIGINT) FROM bundle_counts""",
        "availability": _union(
            [
                f"SELECT '{name}' AS table_name, true AS present, {width} AS n_columns, "
                f"count(*) > 0 AS has_rows, count(*) AS n_rows FROM {name}"
                for name, width in WIDTHS.items()
            ]
        ),
        "sql_passthrough": f"""
            SELECT job_id, count(DISTINCT run_id) AS failed_runs, max(period_end_time) AS last_end
            FROM job_run_timeline
            WHERE period_start_time >= {SINCE_DAY} AND result_state IN {FAILED}
            GROUP BY job_id""",
        "stream_utilization": "SELECT * FROM windows",
        "stream_issues": _worded_issues("window_issues"),
        "stream_alert_episodes": """
            SELECT cluster_id, driver, window_start, window_end, avg_cpu_utilization,
                   CASE WHEN is_over THEN 'opened' ELSE 'closed' END AS change
            FROM (SELECT *, lag(is_over, 1, false) OVER (PARTITION BY cluster_id, driver
                                                         ORDER BY window_start) AS was_over
                  FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, driver, is_over, island
                                                     ORDER BY window_start) AS n
                        FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, driver ORDER BY window_start)
                                        - row_number() OVER (PARTITION BY cluster_id, driver, is_over
                                                             ORDER BY window_start) AS island
                              FROM (SELECT *, avg_cpu_utilization > 50 AS is_over FROM windows)))
                  WHERE n = CASE WHEN is_over THEN 2 ELSE 1 END)
            WHERE is_over <> was_over""",
    }


STEPS["lost_readings"] = """
        SELECT * REPLACE (nullif(cluster_id, 'c-07') AS cluster_id) FROM node_timeline"""
STEPS["lost_instances"] = STEPS["instances"].replace("FROM node_timeline t", "FROM lost_readings t")
LATE_SINCE = "DATE '2025-01-30' - 7"
STEPS["late"] = STEPS["utilization"].replace(NODES_SINCE, LATE_SINCE)


def _remark(table: str, no_data: str, nothing: str) -> str:
    return f"(SELECT CASE WHEN count(*) = 0 THEN '{no_data}' ELSE '{nothing}' END FROM {table})"


def _no_issues(table: str) -> str:
    remark = _remark(table, wording.NO_ISSUE_DATA, wording.NO_ISSUES)
    return f"""
        SELECT CAST(NULL AS VARCHAR) AS cluster_id, CAST(NULL AS BOOLEAN) AS driver, 5 AS rule_no,
               CAST(NULL AS VARCHAR) AS rule, 'OTHER' AS severity, CAST(NULL AS DOUBLE) AS value,
               {remark} AS message, {remark} AS issue"""


def _no_advice(table: str) -> str:
    remark = _remark(table, wording.NO_RECOMMENDATION_DATA, wording.NO_RECOMMENDATIONS)
    return f"""
        SELECT 5 AS theme_rank, 'OTHER' AS theme, CAST(NULL AS BIGINT) AS n, {remark} AS message"""


def _query(body: str) -> str:
    """The body behind the views and steps it needs, in order of definition."""
    known = VIEWS | STEPS
    needed: set[str] = set()
    pending = [body]
    while pending:
        words = set(re.findall(r"\w+", pending.pop()))
        for name in words & set(known) - needed:
            needed.add(name)
            pending.append(known[name])
    parts = [f"{name} AS ({text}\n)" for name, text in known.items() if name in needed]
    return f"WITH {', '.join(parts)}\n{body}"


def oracle_sql() -> dict[str, str]:
    return {name: _query(body) for name, body in _bodies().items()}
