"""How many runs are active at once, and when anything is active at all: a sweep over time."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import calendar_lookback, descending, rounded
from fleetlens.operators.jobs import run_rollup
from fleetlens.operators.timeline import SLICE_SECONDS, micros, running_sums

WORKSPACE = ("workspace_id",)


def active_counts(
    intervals: DataFrame,
    start: str,
    end: str,
    keys: Sequence[str] = WORKSPACE,
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """How many intervals are active from each instant on at which one opens or closes.

    Returns the keys, at and next_at (microseconds; null at a key's last instant), opened,
    delta and active. An interval is active from its start up to, not including, its
    end: where one ends and another starts, the count stays. Intervals without a
    start or end, or that do not last, are left out.
    """
    bounds = intervals.select(*keys, micros(start).alias("_from"), micros(end).alias("_to"))
    steps = (
        bounds.filter("_to > _from")
        .select(*keys, F.expr("inline(array(struct(_from AS at, 1L AS opened, 1L AS delta), "
                              "struct(_to AS at, 0L AS opened, -1L AS delta)))"))
        .groupBy(*keys, "at")
        .agg(F.sum("opened").alias("opened"), F.sum("delta").alias("delta"))
    )
    return running_sums(steps, keys, "at", {"active": "delta"}, slice_seconds, following="next_at")


def _runs(timeline: DataFrame, days: int, as_of: datetime | None) -> DataFrame:
    return run_rollup(calendar_lookback(timeline, "period_start_time", days, as_of))


def concurrency_levels(
    timeline: DataFrame,
    days: int = 7,
    as_of: datetime | None = None,
    keys: Sequence[str] = WORKSPACE,
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """For how many microseconds how many runs were active, and when first.

    A run is active from its first start to its last end, also where its slices leave a gap.
    """
    counts = active_counts(_runs(timeline, days, as_of), "started", "ended", keys, slice_seconds)
    return (
        counts.filter("next_at IS NOT NULL")
        .groupBy(*keys, F.col("active").alias("active_runs"))
        .agg(F.expr("sum(next_at - at) AS active_micros"), F.min("at").alias("first_at"))
    )


def peak_concurrency(
    timeline: DataFrame,
    days: int = 7,
    as_of: datetime | None = None,
    keys: Sequence[str] = WORKSPACE,
    digits: int | None = 2,
    ordered: bool = True,
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """The most runs active at once, when first and how long; and the mean while any is active."""
    levels = concurrency_levels(timeline, days, as_of, keys, slice_seconds)
    busy = levels.filter("active_runs > 0").groupBy(*keys).agg(
        F.max("active_runs").alias("peak_runs"),
        F.max_by("first_at", "active_runs").alias("_peak_at"),
        F.max_by("active_micros", "active_runs").alias("_peak_micros"),
        F.sum("active_micros").alias("_busy_micros"),
        F.sum(F.col("active_runs") * F.col("active_micros")).alias("_run_micros"),
    )
    peaks = busy.select(
        *keys,
        "peak_runs",
        F.timestamp_micros("_peak_at").alias("peak_start"),
        F.expr("_peak_micros div 1000000 AS peak_seconds"),
        F.expr("_busy_micros div 1000000 AS busy_seconds"),
        F.expr("_run_micros div 1000000 AS run_seconds"),
        F.expr(f"{rounded('_run_micros / _busy_micros', digits)} AS avg_active_runs"),
    )
    return peaks.orderBy(*descending(keys, "peak_runs")) if ordered else peaks


def busy_periods(
    timeline: DataFrame,
    days: int = 7,
    as_of: datetime | None = None,
    keys: Sequence[str] = WORKSPACE,
    ordered: bool = True,
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """The longest stretches of time in which some slice is active; slices that touch are merged.

    Returns the keys, period_start, period_end, busy_seconds, n_slices and peak_slices, the most
    that are active at once.
    """
    slices = calendar_lookback(timeline, "period_start_time", days, as_of)
    counts = active_counts(slices, "period_start_time", "period_end_time", keys, slice_seconds)
    begins = F.expr("CAST(active > 0 AND active = delta AS BIGINT)")
    numbered = running_sums(
        counts.select(*keys, "at", "opened", "active", begins.alias("begins")),
        keys, "at", {"period": "begins"}, slice_seconds,
    )
    periods = numbered.groupBy(*keys, "period").agg(
        F.min("at").alias("_from"),
        F.max("at").alias("_to"),
        F.sum("opened").alias("n_slices"),
        F.max("active").alias("peak_slices"),
    )
    shown = periods.select(
        *keys,
        F.timestamp_micros("_from").alias("period_start"),
        F.timestamp_micros("_to").alias("period_end"),
        F.expr("(_to - _from) div 1000000 AS busy_seconds"),
        "n_slices",
        "peak_slices",
    )
    return shown.orderBy("period_start", *keys) if ordered else shown
