"""How regularly jobs start: gaps between starts, their spread, and the phase of the starts."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import calendar_lookback, descending, rounded
from fleetlens.operators.jobs import JOB_KEYS, _with_names, run_rollup
from fleetlens.operators.timeline import SLICE_SECONDS, micros, running_sums


@dataclass(frozen=True)
class ScheduleRule:
    """When a job's schedule counts as irregular.

    It needs ``min_starts`` different starts. It is irregular if its gaps stray from their median by more than
    ``spread`` of it (median absolute deviation) and its starts keep no phase: their mean
    on a circle of that period is shorter than ``concentration``.
    """

    min_starts: int = 5
    spread: float = 0.25
    concentration: float = 0.75


def start_gaps(
    timeline: DataFrame,
    days: int = 7,
    as_of: datetime | None = None,
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """Each start of each job in seconds since 1970, and the seconds to the next one, null at the last.

    Runs that start in the same second are one start.
    """
    runs = run_rollup(calendar_lookback(timeline, "period_start_time", days, as_of))
    second = F.expr("floor(at / 1000000D) * 1000000")
    starts = runs.select(*JOB_KEYS, micros("started").alias("at")).filter("at IS NOT NULL")
    steps = starts.withColumn("at", second).groupBy(*JOB_KEYS, "at").agg(F.count(F.lit(1)).alias("runs"))
    found = running_sums(steps, JOB_KEYS, "at", {"so_far": "runs"}, slice_seconds, following="next")
    return found.selectExpr(*JOB_KEYS, "at div 1000000 AS start", "runs", "(next - at) div 1000000 AS gap")


def job_schedules(
    timeline: DataFrame,
    jobs: DataFrame,
    days: int = 7,
    as_of: datetime | None = None,
    digits: int | None = 4,
    ordered: bool = True,
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """Period, spread and phase of each job with two starts or more.

    ``period_seconds`` is the median gap, ``gap_mad_seconds`` the median distance of the gaps from it,
    ``gap_spread`` their ratio. ``phase_concentration`` is 1 if all starts fall on the same
    place of the period, near 0 if they fall anywhere. The medians halve the two middle values. Their
    state is one count for each gap that occurs, in whole seconds, however many starts a job has.
    """
    starts = start_gaps(timeline, days, as_of, slice_seconds)
    gaps = starts.filter("gap IS NOT NULL").groupBy(*JOB_KEYS, "gap").agg(F.count(F.lit(1)).alias("n"))
    periods = gaps.groupBy(*JOB_KEYS).agg(
        F.expr("percentile(gap, 0.5, n) AS period"), F.collect_list(F.struct("gap", "n")).alias("gaps")
    )
    spreads = (
        periods.select(*JOB_KEYS, "period", F.inline("gaps"))
        .groupBy(*JOB_KEYS, "period")
        .agg(F.expr("percentile(abs(gap - period), 0.5, n) AS mad"))
    )
    keyed = spreads.withColumnsRenamed({key: f"_{key}" for key in JOB_KEYS})
    same = [F.col(key).eqNullSafe(F.col(f"_{key}")) for key in JOB_KEYS]
    # The mean direction of the starts on a circle of one period.
    joined = (
        starts.join(keyed, same)
        .withColumn("angle", F.expr("2 * pi() * (start % period) / period"))
        .groupBy(*JOB_KEYS, "period", "mad")
        .agg(
            F.count(F.lit(1)).alias("n_starts"),
            F.expr("sqrt(pow(avg(cos(angle)), 2) + pow(avg(sin(angle)), 2)) AS concentration"),
        )
    )
    shown = joined.select(
        *JOB_KEYS,
        "n_starts",
        F.expr(f"{rounded('period', digits)} AS period_seconds"),
        F.expr(f"{rounded('mad', digits)} AS gap_mad_seconds"),
        F.expr(f"{rounded('mad / period', digits)} AS gap_spread"),
        F.expr(f"{rounded('concentration', digits)} AS phase_concentration"),
    )
    named = _with_names(shown, jobs)
    return named.orderBy(*descending(JOB_KEYS, "gap_spread")) if ordered else named


def irregular_schedules(schedules: DataFrame, rule: ScheduleRule = ScheduleRule()) -> DataFrame:
    """Jobs whose starts follow no period, by unrounded rows of ``job_schedules``."""
    return schedules.filter(
        (F.col("n_starts") >= rule.min_starts)
        & (F.col("gap_spread") > rule.spread)
        & (F.col("phase_concentration") < rule.concentration)
    )
