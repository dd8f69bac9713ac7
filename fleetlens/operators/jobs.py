"""Job statistics from the time slices of job runs.

Slices are first collapsed to one row per run, which partial aggregation does
mostly before the shuffle; every later step works on runs or jobs only. Names
are joined last, to one row per job: both sides are then partitioned by job, and
the join is a broadcast only where the measured size of the names allows it.
"""

from __future__ import annotations

from datetime import datetime
from typing import Literal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens import wording
from fleetlens.config import TOP_JOB_ROWS
from fleetlens.functions import (
    FAILED,
    SUCCEEDED,
    calendar_lookback,
    descending,
    percent,
    rolling_lookback,
    rounded,
)
from fleetlens.operators.versions import latest_jobs

JOB_KEYS = ("workspace_id", "job_id")
RUN_KEYS = (*JOB_KEYS, "run_id")

# Elapsed time in plain integers; a difference of timestamps costs several times more.
MICROS = "unix_micros(CAST(period_{}_time AS TIMESTAMP))"

RUNTIME_COLUMNS = (
    *JOB_KEYS,
    "job_name",
    "total_runs",
    "avg_duration_seconds",
    "min_duration_seconds",
    "max_duration_seconds",
    "median_duration_seconds",
    "p90_duration_seconds",
    "p95_duration_seconds",
)
FAILURE_COLUMNS = (
    *JOB_KEYS,
    "job_name",
    "total_runs",
    "successful_runs",
    "failed_runs",
    "success_rate_percent",
    "failure_rate_percent",
)


def _sorted(df: DataFrame, ordered: bool, *columns: str) -> DataFrame:
    return df.orderBy(*descending(JOB_KEYS, *columns)) if ordered else df


def _with_names(per_job: DataFrame, jobs: DataFrame, fallback: bool = True) -> DataFrame:
    names = latest_jobs(jobs).select(*JOB_KEYS, F.col("name").alias("job_name"))
    named = per_job.join(names, list(JOB_KEYS), "left")
    if not fallback:
        return named
    unnamed = F.concat(F.lit(wording.UNNAMED_JOB_PREFIX), F.col("job_id").cast("string"))
    return named.withColumn("job_name", F.coalesce("job_name", unnamed))


def run_rollup(slices: DataFrame) -> DataFrame:
    """One row per run: its envelope, its active time and the states it went through."""
    return (
        slices.groupBy(*RUN_KEYS)
        .agg(
            F.min("period_start_time").alias("started"),
            F.max("period_end_time").alias("ended"),
            F.expr(f"sum({MICROS.format('end')} - {MICROS.format('start')}) AS active_micros"),
            F.expr("max(result_state IS NOT NULL) AS has_state"),
            F.expr(f"max(coalesce({SUCCEEDED}, false)) AS succeeded"),
            F.expr(f"max(coalesce({FAILED}, false)) AS failed"),
        )
        .selectExpr(
            "*",
            "unix_timestamp(ended) - unix_timestamp(started) AS envelope_seconds",
            "active_micros div 1000000 AS active_seconds",
        )
    )


def run_durations(
    timeline: DataFrame,
    days: int = 7,
    as_of: datetime | None = None,
    mode: Literal["envelope", "active"] = "envelope",
) -> DataFrame:
    """Seconds per run: from first start to last end, or the sum of its slices.

    The envelope looks back by calendar days, the active time by a rolling window.
    """
    lookback = calendar_lookback if mode == "envelope" else rolling_lookback
    runs = run_rollup(lookback(timeline, "period_start_time", days, as_of))
    return runs.select(*RUN_KEYS, F.col(f"{mode}_seconds").alias("duration_seconds"))


# Not complementary: a run may count as both, or as neither.
def _rates(total: str) -> list[str]:
    return [
        f"{percent('successful_runs', total)} AS success_rate_percent",
        f"{percent('failed_runs', total)} AS failure_rate_percent",
    ]


def _job_health(slices: DataFrame, jobs: DataFrame) -> DataFrame:
    per_job = (
        run_rollup(slices)
        .groupBy(*JOB_KEYS)
        .agg(
            F.count("run_id").alias("runs"),
            F.expr(f"{rounded('avg(envelope_seconds)')} AS avg_duration_seconds"),
            F.min("envelope_seconds").alias("min_duration_seconds"),
            F.max("envelope_seconds").alias("max_duration_seconds"),
            # One bounded sketch per job for all three fractions.
            F.expr("percentile_approx(envelope_seconds, array(0.5, 0.9, 0.95), 10000) AS q"),
            F.expr("count_if(run_id IS NOT NULL AND has_state) AS finished_runs"),
            F.expr("count_if(run_id IS NOT NULL AND succeeded) AS successful_runs"),
            F.expr("count_if(run_id IS NOT NULL AND failed) AS failed_runs"),
        )
        .filter("runs > 0")
        .selectExpr(
            "* EXCEPT (q)",
            "q[0] AS median_duration_seconds",
            "q[1] AS p90_duration_seconds",
            "q[2] AS p95_duration_seconds",
            *_rates("finished_runs"),
        )
    )
    return _with_names(per_job, jobs)


def job_health(
    timeline: DataFrame, jobs: DataFrame, days: int = 7, as_of: datetime | None = None
) -> DataFrame:
    """Runtime and outcome statistics per job from a single pass over the slices.

    ``runtime_view`` and ``failure_view`` cut the two public tables out of it.
    """
    return _job_health(calendar_lookback(timeline, "period_start_time", days, as_of), jobs)


def runtime_view(health: DataFrame, ordered: bool = True) -> DataFrame:
    view = health.withColumnRenamed("runs", "total_runs").select(*RUNTIME_COLUMNS)
    return _sorted(view, ordered, "avg_duration_seconds")


def failure_view(health: DataFrame, ordered: bool = True) -> DataFrame:
    view = (
        health.filter(F.col("finished_runs") > 0)
        .withColumnRenamed("finished_runs", "total_runs")
        .select(*FAILURE_COLUMNS)
    )
    return _sorted(view, ordered, "failure_rate_percent", "total_runs")


def job_runtime_metrics(
    timeline: DataFrame,
    jobs: DataFrame,
    days: int = 7,
    as_of: datetime | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Runs per job and the distribution of their envelope durations."""
    return runtime_view(job_health(timeline, jobs, days, as_of), ordered)


def job_failure_analysis(
    timeline: DataFrame,
    jobs: DataFrame,
    days: int = 7,
    as_of: datetime | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Distinct runs per job that reported a state, that succeeded and that failed.

    The flags per run replace distinct counts, which would copy each slice once
    per count. Slices without a state are dropped at the scan.
    """
    slices = calendar_lookback(timeline, "period_start_time", days, as_of)
    with_state = slices.filter(F.col("result_state").isNotNull())
    return failure_view(_job_health(with_state, jobs), ordered)


def job_runtime_active(
    timeline: DataFrame,
    jobs: DataFrame,
    days: int = 7,
    as_of: datetime | None = None,
    digits: int | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Runs per job and the distribution of their active time, gaps excluded.

    Rolling window, exact interpolated percentiles, no fallback name. Equal
    durations of a job are counted before the percentile, so its state is
    bounded by the distinct durations rather than by the runs of the job.
    """
    runs = run_durations(timeline, days, as_of, mode="active")
    per_job = (
        runs.groupBy(*JOB_KEYS, "duration_seconds")
        .agg(F.count(F.lit(1)).alias("n"), F.count("run_id").alias("n_runs"))
        .groupBy(*JOB_KEYS)
        .agg(
            F.sum("n_runs").alias("total_runs"),
            F.expr(
                "try_divide(sum(duration_seconds * n), sum(n) FILTER (WHERE duration_seconds"
                " IS NOT NULL)) AS mean"
            ),
            F.min("duration_seconds").alias("min_duration_seconds"),
            F.max("duration_seconds").alias("max_duration_seconds"),
            F.expr("percentile(duration_seconds, array(0.5, 0.9, 0.95), n) AS q"),
        )
    )
    result = _with_names(per_job, jobs, fallback=False).selectExpr(
        *JOB_KEYS,
        "job_name",
        "total_runs",
        f"{rounded('mean', digits)} AS avg_duration_seconds",
        "min_duration_seconds",
        "max_duration_seconds",
        f"{rounded('q[0]', digits)} AS median_duration_seconds",
        f"{rounded('q[1]', digits)} AS p90_duration_seconds",
        f"{rounded('q[2]', digits)} AS p95_duration_seconds",
    )
    return _sorted(result, ordered, "avg_duration_seconds")


def job_failure_slices(
    timeline: DataFrame,
    jobs: DataFrame,
    days: int = 7,
    as_of: datetime | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Outcome rates over slices instead of runs; slices without a state count too."""
    per_job = (
        rolling_lookback(timeline, "period_start_time", days, as_of)
        .groupBy(*JOB_KEYS)
        .agg(
            F.count(F.lit(1)).alias("total_runs"),
            F.expr(f"count_if({SUCCEEDED}) AS successful_runs"),
            F.expr(f"count_if({FAILED}) AS failed_runs"),
        )
        .selectExpr("*", *_rates("total_runs"))
    )
    result = _with_names(per_job, jobs, fallback=False).select(*FAILURE_COLUMNS)
    return _sorted(result, ordered, "failure_rate_percent", "total_runs")


def simple_job_data(
    timeline: DataFrame,
    days: int = 7,
    as_of: datetime | None = None,
    limit: int | None = TOP_JOB_ROWS,
) -> DataFrame:
    """Distinct runs and active days, first start and last end of the busiest jobs.

    Slices collapse to a row per run and day. Two grouping sets then stand in for the
    two distinct counts: each such row becomes one (job, run) and one (job, day) row
    that merge before the shuffle.
    """
    run_days = (
        calendar_lookback(timeline, "period_start_time", days, as_of)
        .groupBy(*RUN_KEYS, F.to_date("period_start_time").alias("day"))
        .agg(F.min("period_start_time").alias("first"), F.max("period_end_time").alias("last"))
    )
    merged = run_days.groupingSets([(*RUN_KEYS,), (*JOB_KEYS, "day")], *RUN_KEYS, "day").agg(
        F.expr("grouping(day) = 1 AS by_run"),
        F.min("first").alias("first_run"),
        F.max("last").alias("last_run"),
    )
    per_job = merged.groupBy(*JOB_KEYS).agg(
        F.expr("count(run_id) FILTER (WHERE by_run) AS total_runs"),
        F.expr("count(day) FILTER (WHERE NOT by_run) AS active_days"),
        F.min("first_run").alias("first_run"),
        F.max("last_run").alias("last_run"),
    )
    busiest = _sorted(per_job, True, "total_runs")
    return busiest if limit is None else busiest.limit(limit)


def recent_job_activity(
    timeline: DataFrame, days: int = 3, as_of: datetime | None = None, ordered: bool = True
) -> DataFrame:
    """Distinct jobs and runs per calendar day, and how many runs succeeded or failed.

    Ids are counted without their workspace. Slices collapse to a row per day, job and
    run. One grouping set for jobs and one for runs then spread a busy day over all
    tasks before the count per day.
    """
    day_runs = (
        calendar_lookback(timeline, "period_start_time", days, as_of)
        .filter("result_state IS NOT NULL")
        .selectExpr(
            "to_date(period_start_time) AS job_date",
            "job_id",
            "run_id",
            f"{SUCCEEDED} AS succeeded",
            f"{FAILED} AS failed",
        )
        .groupBy("job_date", "job_id", "run_id")
        .agg(F.max("succeeded").alias("succeeded"), F.max("failed").alias("failed"))
    )
    merged = day_runs.groupingSets(
        [("job_date", "job_id"), ("job_date", "run_id")], "job_date", "job_id", "run_id"
    ).agg(
        F.expr("grouping(job_id) = 1 AS by_run"),
        F.max("succeeded").alias("succeeded"),
        F.max("failed").alias("failed"),
    )
    per_day = merged.groupBy("job_date").agg(
        F.expr("count(job_id) FILTER (WHERE NOT by_run) AS unique_jobs"),
        F.expr("count(run_id) FILTER (WHERE by_run) AS total_runs"),
        F.expr("count(run_id) FILTER (WHERE by_run AND succeeded) AS successful_runs"),
        F.expr("count(run_id) FILTER (WHERE by_run AND failed) AS failed_runs"),
    )
    return per_day.orderBy(F.desc("job_date")) if ordered else per_day
