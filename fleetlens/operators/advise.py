"""Performance issues and recommendations over node utilisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import wording
from fleetlens.config import Thresholds
from fleetlens.functions import rounded


# Issue rules by number, in reporting order.
RULES = {
    1: wording.HIGH_CPU,
    2: wording.HIGH_MEMORY,
    3: wording.HIGH_CPU_WAIT,
    4: wording.UNDERUTILIZED,
}


def _broken(limits: Thresholds) -> dict[int, tuple[str, str]]:
    """The condition of each rule and the figure it reports, as SQL."""
    cpu, memory, wait = "avg_cpu_utilization", "avg_memory_utilization", "avg_cpu_wait"
    return {
        1: (f"{cpu} > {limits.cpu_percent}D", cpu),
        2: (f"{memory} > {limits.memory_percent}D", memory),
        3: (f"{wait} > {limits.high_wait}D", wait),
        4: (f"{cpu} < {limits.idle_cpu}D", cpu),
    }


def row_issues(
    utilization: DataFrame, *extra: str, limits: Thresholds = Thresholds()
) -> DataFrame:
    """Issues of each row in a single pass. Works on streams; adds no closing remark."""
    names = " ".join(f"WHEN {number} THEN '{name}'" for number, name in RULES.items())
    checks = ", ".join(
        f"{number}, CASE WHEN {condition} THEN {figure} END"
        for number, (condition, figure) in _broken(limits).items()
    )
    value = rounded("value", 1)
    return (
        utilization.selectExpr(
            *extra,
            "cluster_id",
            "driver",
            f"stack({len(RULES)}, {checks}) AS (rule_no, value)",
        )
        .filter("value IS NOT NULL")
        .selectExpr(
            *extra,
            "cluster_id",
            "driver",
            "rule_no",
            f"CASE rule_no {names} END AS rule",
            f"""CASE
                WHEN rule_no = 1 AND value > {limits.severe_cpu}D THEN 'HIGH'
                WHEN rule_no = 2 AND value > {limits.severe_memory}D THEN 'HIGH'
                WHEN rule_no <= 3 THEN 'MEDIUM'
                ELSE 'LOW' END AS severity""",
            "value",
        )
        .selectExpr(
            "*",
            f"""CASE WHEN rule_no = 4
                THEN format_string('{wording.UNDERUTILIZED_MESSAGE}', rule, cluster_id, {value})
                ELSE format_string('{wording.ISSUE_MESSAGE}', rule, cluster_id, {value})
                END AS message""",
        )
        .selectExpr("*", f"format_string('{wording.ISSUE_TAG}', severity, message) AS issue")
    )


def performance_issues(utilization: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """All issues, or one remark row that there is no data or nothing to report.

    The remark comes from a one-row tally; Spark computes the utilisation under
    both branches once, because they share the same exchange.
    """
    hits = " + ".join(f"count_if({condition})" for condition, _ in _broken(limits).values())
    tally = utilization.agg(F.expr("count(1) AS n_rows"), F.expr(f"{hits} AS n_issues"))
    remark = (
        tally.filter("n_issues = 0")
        .selectExpr(
            f"{len(RULES) + 1} AS rule_no",
            f"'{wording.SEVERITIES[-1]}' AS severity",
            f"if(n_rows = 0, '{wording.NO_ISSUE_DATA}', '{wording.NO_ISSUES}') AS message",
        )
        .selectExpr("*", "message AS issue")
    )
    return row_issues(utilization, limits=limits).unionByName(remark, allowMissingColumns=True)


def severity_rank(severity: Column) -> Column:
    order = F.array(*[F.lit(name) for name in wording.SEVERITIES])
    return F.array_position(order, severity).cast("int")


def issues_by_severity(issues: DataFrame, ordered: bool = True) -> DataFrame:
    """Number of issues per severity; the remark row counts as well."""
    counted = issues.groupBy("severity").agg(F.count(F.lit(1)).alias("n_issues"))
    ranked = counted.withColumn("severity_rank", severity_rank(F.col("severity")))
    return ranked.orderBy("severity_rank") if ordered else ranked


def _weighted(utilization: DataFrame, limits: Thresholds) -> DataFrame:
    """Per cluster: averages weighted by data points, and rows over the row limits."""
    cpu, memory = "avg_cpu_utilization", "avg_memory_utilization"
    total = "sum(data_points)"
    parts = {
        "avg_cpu": f"try_divide(sum({cpu} * data_points), {total})",
        "avg_memory": f"try_divide(sum({memory} * data_points), {total})",
        "n_rows": "count(1)",
        "n_idle": f"count_if({cpu} < {limits.downsize_cpu}D)",
        "n_busy": f"count_if({cpu} > {limits.scale_up_cpu}D)",
        "n_full": f"count_if({memory} > {limits.relieve_memory}D)",
    }
    return (
        utilization.groupBy("cluster_id")
        .agg(*[F.expr(f"{sql} AS {name}") for name, sql in parts.items()])
        .selectExpr("*", "abs(avg_cpu - avg_memory) AS gap")
    )


def _imbalanced(limits: Thresholds) -> str:
    return f"cluster_id IS NOT NULL AND gap > {limits.imbalance_gap}D"


def imbalanced_clusters(
    utilization: DataFrame, limits: Thresholds = Thresholds(), digits: int | None = None
) -> DataFrame:
    """Clusters whose weighted CPU and memory averages lie far apart."""
    return (
        _weighted(utilization, limits)
        .filter(_imbalanced(limits))
        .selectExpr(
            "cluster_id",
            *[f"{rounded(name, digits)} AS {name}" for name in ("avg_cpu", "avg_memory", "gap")],
        )
    )


def recommendations(utilization: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Recommendations in theme order: (theme_rank, theme, n, message).

    COST OPTIMIZATION, PERFORMANCE and MEMORY count rows, that is (cluster,
    driver) pairs; BALANCE counts clusters. One remark row if none applies.
    """
    totals = _weighted(utilization, limits).agg(
        F.expr("coalesce(sum(n_rows), 0) AS n_rows"),
        F.expr("sum(n_idle) AS n_idle"),
        F.expr("sum(n_busy) AS n_busy"),
        F.expr("sum(n_full) AS n_full"),
        F.expr(f"count_if({_imbalanced(limits)}) AS n_imbalanced"),
    )

    def advice(rank: int, n: str, message: str) -> str:
        theme = wording.THEMES[rank - 1]
        return (
            f"named_struct('theme_rank', {rank}, 'theme', '{theme}', 'n', {n}, "
            f"'message', {message})"
        )

    def case(rank: int, n: str, template: str, *limit: float) -> str:
        values = "".join(f", '{value:g}'" for value in limit)
        message = f"format_string('{template}', {n}{values})"
        return f"CASE WHEN {n} > 0 THEN {advice(rank, n, message)} END"

    cases = [
        case(1, "n_idle", wording.DOWNSIZE, limits.downsize_cpu),
        case(2, "n_busy", wording.SCALE_UP, limits.scale_up_cpu),
        case(3, "n_full", wording.RELIEVE_MEMORY, limits.relieve_memory),
        case(4, "n_imbalanced", wording.IMBALANCE),
    ]
    remark = advice(
        len(wording.THEMES),
        "CAST(NULL AS BIGINT)",
        f"if(n_rows = 0, '{wording.NO_RECOMMENDATION_DATA}', '{wording.NO_RECOMMENDATIONS}')",
    )
    given = totals.selectExpr("n_rows", f"array_compact(array({', '.join(cases)})) AS given")
    return given.selectExpr(f"inline(if(size(given) > 0, given, array({remark})))")
