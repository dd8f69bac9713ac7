"""Report tables and report lines.

Lines are rows (section, ord, rank, line): ``ord`` is the fixed place of a block
in the report and ``rank`` the order inside the block, so a report of any length
sorts in parallel. Full result tables are written as Parquet next to the text.

A report reads its metric tables several times. The ``write_*`` functions write
those tables to their place first and build the lines from what they have written,
so that the input is scanned once. They raise if a fact table is unbound or empty.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens import wording
from fleetlens.config import TOP_ANOMALY_ROWS, TOP_UTILIZATION_ROWS, Thresholds
from fleetlens.functions import checked_days, descending, minutes, rounded, stable_round
from fleetlens.functions.time import clock_sql
from fleetlens.operators import advise, clusters, detect, nodes, stats
from fleetlens.operators.jobs import JOB_KEYS, failure_view, job_health, runtime_view
from fleetlens.plans.bundles import cluster_bundle
from fleetlens.sources.catalog import require_rows
from fleetlens.sources.sinks import write_report, write_table
from fleetlens.sources.tables import Tables

# Time formats of the report headers.
SECONDS_FORMAT = "yyyy-MM-dd HH:mm:ss"
MINUTES_FORMAT = "yyyy-MM-dd HH:mm"

# Columns of the detailed table, and the look-back of cluster info.
DETAIL_COLUMNS = (*nodes.NODE_KEYS, "data_points", *nodes.ZERO_FIGURES)
INFO_DAYS = 30


def _figure(number: int, name: str, value: str, template: str) -> str:
    """SQL of one key figure; null where the value is."""
    return (
        f"CASE WHEN {value} IS NOT NULL THEN named_struct('metric_no', {number}, "
        f"'metric', '{name}', 'value', CAST({value} AS DOUBLE), "
        f"'text', format_string('{template}', {value})) END"
    )


def _figures(totals: DataFrame, *figures: str) -> DataFrame:
    return totals.selectExpr(f"inline(array_compact(array({', '.join(figures)})))")


def _percent(number: int, name: str, column: str) -> str:
    return _figure(number, name, rounded(column), "%.2f%%")


def _count(number: int, name: str, column: str) -> str:
    return _figure(number, name, column, "%d")


def cluster_kpis(utilization: DataFrame) -> DataFrame:
    """Key figures over the rows of a utilisation table, each row with equal weight."""
    totals = utilization.agg(
        F.expr("nullif(count(1), 0) AS n_rows"),
        F.avg("avg_cpu_utilization").alias("avg_cpu"),
        F.max("peak_cpu_utilization").alias("peak_cpu"),
        F.avg("avg_memory_utilization").alias("avg_memory"),
        F.max("peak_memory_utilization").alias("peak_memory"),
    )
    return _figures(
        totals,
        _count(1, wording.KPI_CLUSTERS, "n_rows"),
        _percent(2, wording.KPI_AVG_CPU, "avg_cpu"),
        _percent(3, wording.KPI_PEAK_CPU, "peak_cpu"),
        _percent(4, wording.KPI_AVG_MEMORY, "avg_memory"),
        _percent(5, wording.KPI_PEAK_MEMORY, "peak_memory"),
    )


def cluster_quantiles(utilization: DataFrame) -> DataFrame:
    """Quantiles of the CPU and memory averages."""
    return stats.quantiles(
        utilization,
        {
            wording.QUANTILE_CPU: "avg_cpu_utilization",
            wording.QUANTILE_MEMORY: "avg_memory_utilization",
        },
        stats.REPORT_FRACTIONS,
        digits=2,
    )


def job_summary(health: DataFrame, utilization: DataFrame) -> DataFrame:
    """Key figures of the job report: (metric_no, metric, value, text).

    ``utilization`` holds all node groups. The first two fleet averages are over the
    ``TOP_UTILIZATION_ROWS`` busiest of them, as such reports show them, and so lie
    above those over all groups, which follow. Averages are plain means over jobs
    and groups. Figures of an empty table are left out.
    """
    jobs = health.agg(
        F.expr("nullif(count(1), 0) AS n_jobs"),
        F.expr(f"{rounded('avg(avg_duration_seconds) / 60')} AS minutes"),
        F.expr("avg(success_rate_percent) FILTER (WHERE finished_runs > 0) AS success"),
        F.expr("sum(finished_runs) FILTER (WHERE finished_runs > 0) AS runs"),
        F.expr("sum(failed_runs) FILTER (WHERE finished_runs > 0) AS failed"),
    )
    means = [
        F.avg("avg_cpu_utilization").alias("avg_cpu"),
        F.avg("avg_memory_utilization").alias("avg_memory"),
    ]
    busiest = nodes.by_cpu(utilization, *nodes.NODE_KEYS).limit(TOP_UTILIZATION_ROWS)
    return _figures(
        jobs,
        _count(1, wording.JOBS_MONITORED, "n_jobs"),
        _figure(2, wording.JOB_RUNTIME, "minutes", "%.2f minutes"),
        _percent(3, wording.JOB_SUCCESS, "success"),
        _count(4, wording.JOB_RUNS, "runs"),
        _count(5, wording.JOB_FAILURES, "failed"),
    ).unionByName(
        _figures(
            busiest.agg(*means),
            _percent(6, wording.FLEET_CPU, "avg_cpu"),
            _percent(7, wording.FLEET_MEMORY, "avg_memory"),
        )
    ).unionByName(
        _figures(
            utilization.agg(*means),
            _percent(8, wording.ALL_CPU, "avg_cpu"),
            _percent(9, wording.ALL_MEMORY, "avg_memory"),
        )
    )


def cluster_monitor_summary(instances: DataFrame) -> DataFrame:
    """Key figures of the cluster monitor: distinct clusters and plain means over instances."""
    per_cluster = instances.groupBy("cluster_id").agg(
        F.sum("avg_cpu_utilization").alias("cpu"),
        F.count("avg_cpu_utilization").alias("n_cpu"),
        F.sum("avg_memory_utilization").alias("memory"),
        F.count("avg_memory_utilization").alias("n_memory"),
    )
    totals = per_cluster.agg(
        F.expr("if(count(1) = 0, NULL, count(cluster_id)) AS n_clusters"),
        F.expr(f"{rounded('try_divide(sum(cpu), sum(n_cpu))', 1)} AS avg_cpu"),
        F.expr(f"{rounded('try_divide(sum(memory), sum(n_memory))', 1)} AS avg_memory"),
    )
    return _figures(
        totals,
        _count(1, wording.CLUSTERS_MONITORED, "n_clusters"),
        _figure(2, wording.FLEET_CPU, "avg_cpu", "%.1f%%"),
        _figure(3, wording.FLEET_MEMORY, "avg_memory", "%.1f%%"),
    )


def _lines(df: DataFrame, section: str, ord: int | Column, rank: Column, line: Column) -> DataFrame:
    place = F.lit(ord) if isinstance(ord, int) else ord
    return df.select(
        F.lit(section).alias("section"),
        place.cast("int").alias("ord"),
        rank.cast("double").alias("rank"),
        line.alias("line"),
    )


def _fixed_lines(like: DataFrame, section: str, lines: dict[int, str]) -> DataFrame:
    """Lines that no table feeds, given as SQL."""
    rows = [
        f"named_struct('section', '{section}', 'ord', {ord}, 'rank', 0.0D, 'line', {line})"
        for ord, line in lines.items()
    ]
    return like.sparkSession.range(1).selectExpr(f"inline(array({', '.join(rows)}))")


def _text(line: str) -> str:
    return f"'{line}'"


def _time(instant: str, form: str) -> str:
    return f"date_format({instant}, '{form}')"


def _header(
    like: DataFrame, title: str, days: int, as_of: datetime | None, summary_title: str
) -> DataFrame:
    return _fixed_lines(
        like,
        "header",
        {
            1: _text(f"# {title}"),
            2: f"concat('Generated: ', {_time(clock_sql(as_of), SECONDS_FORMAT)})",
            3: _text(f"Period: Last {days} days"),
            4: _text(f"## {summary_title}"),
        },
    )


def _summary_lines(figures: DataFrame) -> DataFrame:
    text = F.format_string("- %s: %s", "metric", "text")
    return _lines(figures, "summary", 10, F.col("metric_no"), text)


def _anomaly_lines(
    hits: DataFrame, section: str, ord: int, heading: str, order: list[Column], line: Column
) -> DataFrame:
    """A heading with the number of hits and the first few; nothing if there are none."""
    counted = hits.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 0)
    head = _lines(counted, section, ord, F.lit(0), F.format_string(f"### {heading}", "n"))
    first = hits.orderBy(*order).limit(TOP_ANOMALY_ROWS)
    rank = F.row_number().over(Window.partitionBy(F.lit(ord)).orderBy(*order))
    return head.unionByName(_lines(first, section, ord + 1, rank, line))


def _joined(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def job_report_lines(
    health: DataFrame,
    utilization: DataFrame,
    days: int = 7,
    as_of: datetime | None = None,
    limits: Thresholds = Thresholds(),
) -> DataFrame:
    """The job report: header, key figures, the first anomalies of each kind, details.

    ``utilization`` holds all node groups. Both tables are read several times.
    """
    since = f"midnight {days} days ago"
    runtime = runtime_view(health, ordered=False)
    failures = failure_view(health, ordered=False)
    average_minutes = minutes(F.col("avg_duration_seconds")).cast("string")
    return _joined(
        _header(runtime, "Job Monitoring Report", days, as_of, "Summary Statistics"),
        _summary_lines(job_summary(health, utilization)),
        _fixed_lines(runtime, "anomalies", {20: _text("## Detected Anomalies")}),
        _anomaly_lines(
            runtime.filter(detect.runs_long(limits)),
            "anomalies",
            21,
            "Long Running Jobs (%d detected)",
            descending(JOB_KEYS, "avg_duration_seconds"),
            F.format_string("- **%s** (ID: %s): Avg %s min", "job_name", _job_id(), average_minutes),
        ),
        _anomaly_lines(
            failures.filter(detect.fails_often(limits)),
            "anomalies",
            31,
            "High Failure Rate Jobs (%d detected)",
            descending(JOB_KEYS, "failure_rate_percent", "total_runs"),
            F.format_string(
                "- **%s** (ID: %s): %s%% failure rate",
                "job_name",
                _job_id(),
                F.col("failure_rate_percent").cast("string"),
            ),
        ),
        _fixed_lines(runtime, "details", {40: _text("## Details")}),
        _detail_lines(health, "job_health", 41, since),
        _detail_lines(utilization, "cluster_utilization", 42, since),
    )


def _detail_lines(df: DataFrame, table: str, ord: int, since: str) -> DataFrame:
    """A pointer to a table written next to the report."""
    counted = df.agg(F.count(F.lit(1)).alias("n"))
    text = F.format_string(f"- {table}: %d rows since {since}", "n")
    return _lines(counted, "details", ord, F.lit(0), text)


def _job_id() -> Column:
    return F.col("job_id").cast("string")


def cluster_monitor_lines(
    instances: DataFrame,
    days: int = 7,
    as_of: datetime | None = None,
    limits: Thresholds = Thresholds(),
) -> DataFrame:
    """The cluster monitor report: key figures and the first instances out of range."""
    line = F.format_string(
        "- **%s**: CPU %s%%, Memory %s%%",
        F.coalesce("cluster_name", F.col("cluster_id").cast("string")),
        stable_round(F.col("avg_cpu_utilization")).cast("string"),
        stable_round(F.col("avg_memory_utilization")).cast("string"),
    )
    busiest = descending(nodes.INSTANCE_KEYS, "avg_cpu_utilization")
    return _joined(
        _header(instances, "Cluster Monitoring Report", days, as_of, "Cluster Summary"),
        _summary_lines(cluster_monitor_summary(instances)),
        _fixed_lines(instances, "anomalies", {20: _text("## Detected Issues")}),
        _anomaly_lines(
            instances.filter(detect.is_idle(limits)),
            "anomalies",
            21,
            "Underutilized Clusters (%d found)",
            busiest,
            line,
        ),
        _anomaly_lines(
            instances.filter(detect.is_overloaded(limits)),
            "anomalies",
            31,
            "Overutilized Clusters (%d found)",
            busiest,
            line,
        ),
    )


def cluster_report_lines(
    utilization: DataFrame,
    days: int = 7,
    as_of: datetime | None = None,
    min_points: int = 5,
    limits: Thresholds = Thresholds(),
    info_days: int = INFO_DAYS,
) -> DataFrame:
    """The cluster performance report over a (cluster, driver) utilisation table."""
    now = clock_sql(as_of)
    start = f"{now} - make_dt_interval({days})"
    header = _fixed_lines(
        utilization,
        "metadata",
        {
            1: _text("# Cluster Performance Analysis Report"),
            2: _text("## Run Metadata"),
            3: f"concat('- Generated: ', {_time(now, SECONDS_FORMAT)})",
            4: f"concat('- Time Window: ', {_time(start, MINUTES_FORMAT)}, ' to ', "
            f"{_time(now, MINUTES_FORMAT)})",
            5: _text(f"- Analysis days: {days}"),
            6: _text(f"- CPU threshold: {limits.cpu_percent:g}%"),
            7: _text(f"- Memory threshold: {limits.memory_percent:g}%"),
            8: _text(f"- Min datapoints: {min_points}"),
            10: _text("## Key Metrics"),
            12: _text("### Quantiles"),
            20: _text("## Top Consumers"),
            21: _text("### Top 10 by Average CPU Utilization"),
            23: _text("### Top 10 by Average Memory Utilization"),
            30: _text("## Performance Issues"),
            50: _text("## Recommendations"),
            70: _text("## Appendix: Queries"),
            71: _text(
                "- Utilization: node_timeline since midnight "
                f"{days} days ago, grouped by cluster_id and driver, missing readings as 0, "
                f"at least {min_points} readings per group"
            ),
            72: _text(
                "- Cluster info: distinct versions of clusters since midnight "
                f"{info_days} days ago, newest first"
            ),
            73: _text("## Appendix: Details"),
        },
    )
    kpis = cluster_kpis(utilization)
    quantiles = cluster_quantiles(utilization)
    labels = [name for name in quantiles.columns if name != "metric"]
    issues = advise.performance_issues(utilization, limits)
    severity_block = F.lit(30) + advise.severity_rank(F.col("severity")) * 3
    given = advise.recommendations(utilization, limits)
    theme_block = F.lit(50) + F.col("theme_rank") * 2
    return _joined(
        header,
        _lines(
            kpis, "key_metrics", 11, F.col("metric_no"), F.format_string("- %s: %s", "metric", "text")
        ),
        _lines(
            quantiles,
            "key_metrics",
            13,
            F.lit(0),
            F.format_string(
                "- %s: " + ", ".join(f"{name} %.2f" for name in labels), "metric", *labels
            ),
        ),
        _top_lines(stats.top_cpu(utilization), 22, "avg_cpu_utilization"),
        _top_lines(stats.top_memory(utilization), 24, "avg_memory_utilization"),
        _lines(
            advise.issues_by_severity(issues, ordered=False),
            "issues",
            severity_block,
            F.lit(0),
            F.format_string("### %s (%d)", "severity", "n_issues"),
        ),
        # Inside a severity: by rule, then busiest first.
        _lines(
            issues,
            "issues",
            severity_block + 1,
            F.col("rule_no") * 1_000_000 - F.coalesce("value", F.lit(0.0)),
            F.format_string("- %s", "message"),
        ),
        _lines(given, "recommendations", theme_block, F.lit(0), F.format_string("### %s", "theme")),
        _lines(
            given, "recommendations", theme_block + 1, F.lit(0), F.format_string("- %s", "message")
        ),
        _detail_lines(utilization, "cluster_utilization", 74, f"midnight {days} days ago"),
    )


def _top_lines(top: DataFrame, ord: int, first: str) -> DataFrame:
    figures = top.columns[2:]
    names = [name.replace("_utilization", "").replace("_", " ") for name in figures]
    text = F.format_string(
        "- %s, driver %s: " + ", ".join(f"{name} %.2f%%" for name in names),
        F.col("cluster_id"),
        F.col("driver").cast("string"),
        *figures,
    )
    return _lines(top, "top_consumers", ord, -F.col(first), text)


def write_job_report(
    tables: Tables,
    path: str,
    days: int = 7,
    as_of: datetime | None = None,
    limits: Thresholds = Thresholds(),
) -> None:
    """Write ``report`` (text) and its tables (Parquet) below ``path``.

    ``job_health`` and ``cluster_utilization`` (all groups) come from the input;
    ``runtime_metrics``, ``failure_analysis`` and the lines from ``job_health``.
    """
    checked_days(days)
    require_rows(tables, "job_run_timeline", "node_timeline")
    health = job_health(tables.job_run_timeline, tables.jobs, days, as_of)
    health = _written(health, f"{path}/job_health")
    groups = nodes.cluster_utilization_top(tables.node_timeline, days, as_of, limit=None)
    groups = _written(groups, f"{path}/cluster_utilization")
    write_table(runtime_view(health), f"{path}/runtime_metrics")
    write_table(failure_view(health), f"{path}/failure_analysis")
    write_report(job_report_lines(health, groups, days, as_of, limits), f"{path}/report")


def write_cluster_monitor_report(
    tables: Tables,
    path: str,
    days: int = 7,
    as_of: datetime | None = None,
    limits: Thresholds = Thresholds(),
) -> None:
    """Write the cluster monitor ``report`` and its tables below ``path``.

    ``node_rollup`` holds the mergeable aggregates from which utilisation and efficiency
    are derived; the lines come from the written ``cluster_utilization``.
    """
    checked_days(days)
    require_rows(tables, "node_timeline")
    rollup = nodes.node_rollup(tables.node_timeline, days, as_of, limits=limits)
    rollup = _written(rollup, f"{path}/node_rollup")
    bundle = cluster_bundle(tables, days, as_of, rollup, limits)
    written = {name: _written(df, f"{path}/{name}") for name, df in bundle.items()}
    lines = cluster_monitor_lines(written["cluster_utilization"], days, as_of, limits)
    write_report(lines, f"{path}/report")


def write_cluster_report(
    tables: Tables,
    path: str,
    days: int = 7,
    as_of: datetime | None = None,
    min_points: int = 5,
    limits: Thresholds = Thresholds(),
    info_days: int = INFO_DAYS,
) -> None:
    """Write the cluster performance ``report``, its utilisation table and cluster info."""
    checked_days(days)
    require_rows(tables, "node_timeline")
    utilization = nodes.cluster_utilization(tables.node_timeline, days, as_of, min_points)
    detailed = stats.present_columns(utilization, DETAIL_COLUMNS)
    written = _written(detailed, f"{path}/cluster_utilization")
    info = clusters.cluster_basic_info(tables.clusters, checked_days(info_days), as_of)
    write_table(info, f"{path}/cluster_info")
    lines = cluster_report_lines(written, days, as_of, min_points, limits, info_days)
    write_report(lines, f"{path}/report")


def _written(df: DataFrame, path: str) -> DataFrame:
    """Write a table to its place and go on with what is there."""
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
