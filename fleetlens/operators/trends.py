"""Run durations from day to day: quantile sketches, anomalies against a baseline, trends and changes.

All build on one table of a row for each key and day, whose sketches merge. It can be stored and
read back (``sources.write_table`` with ``partition_by=["day"]``), so that a longer look-back costs no new scan of runs.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import calendar_lookback, rounded
from fleetlens.functions.time import checked_days, clock
from fleetlens.operators.jobs import JOB_KEYS, run_rollup

#: Size of a sketch: exact up to as many runs, and ranks within about 0.1 % beyond.
SKETCH_SIZE = 4096

#: Critical value of the CUSUM statistic at 5 % (the largest distance of a Brownian bridge from 0).
CHANGE_LIMIT = 1.358

#: Critical value of the Mann-Kendall statistic at 5 %.
TREND_LIMIT = 1.96


def daily_durations(
    timeline: DataFrame,
    days: int = 90,
    as_of: datetime | None = None,
    keys: Sequence[str] = JOB_KEYS,
    sketch_size: int = SKETCH_SIZE,
) -> DataFrame:
    """Runs and a mergeable sketch of their durations in seconds, for each key and day of start."""
    runs = run_rollup(calendar_lookback(timeline, "period_start_time", days, as_of))
    return (
        runs.select(*keys, F.to_date("started").alias("day"), F.col("envelope_seconds").cast("double").alias("s"))
        .filter("s IS NOT NULL")
        .groupBy(*keys, "day")
        .agg(F.count(F.lit(1)).alias("n_runs"), F.expr(f"kll_sketch_agg_double(s, {sketch_size}) AS durations"))
    )


def _merged(daily: DataFrame, keys: Sequence[str]) -> DataFrame:
    return daily.groupBy(*keys).agg(
        F.sum("n_runs").alias("n_runs"), F.expr("kll_merge_agg_double(durations) AS durations")
    )


def _quantile(fraction: float) -> str:
    return f"kll_sketch_get_quantile_double(durations, {fraction}D)"


def duration_quantiles(daily: DataFrame, keys: Sequence[str] = JOB_KEYS) -> DataFrame:
    """Median, 90th and 95th percentile of all runs of a key, from its daily sketches."""
    shown = {"median": 0.5, "p90": 0.9, "p95": 0.95}
    return _merged(daily, keys).select(
        *keys, "n_runs", *(F.expr(_quantile(q)).alias(f"{name}_duration_seconds") for name, q in shown.items())
    )


# Whole percents, a little less, so that rounding does not skip a run.
_PERCENTS = ", ".join(f"{i / 100 - 1e-9}D" for i in range(1, 101))


def statistical_anomalies(
    daily: DataFrame,
    recent_days: int = 7,
    as_of: datetime | None = None,
    keys: Sequence[str] = JOB_KEYS,
    tail_percent: int = 5,
    min_baseline_runs: int = 20,
) -> DataFrame:
    """Recent days whose median run is in the upper or lower tail of the days before.

    The baseline of a key is all runs before the last ``recent_days`` days; it needs
    ``min_baseline_runs``. ``baseline_percent`` is how many whole percent of its runs are no longer than the day's
    median. A day is slower from ``100 - tail_percent`` on, and faster below ``tail_percent``.
    """
    first_recent = F.date_sub(clock(as_of), checked_days(recent_days))
    baseline = _merged(daily.filter(F.col("day") < first_recent), keys)
    named = {key: f"_{key}" for key in keys}
    baseline = baseline.filter(F.col("n_runs") >= min_baseline_runs).select(
        *(F.col(key).alias(name) for key, name in named.items()),
        F.col("n_runs").alias("baseline_runs"),
        F.expr(f"{_quantile(0.5)} AS baseline_median_seconds"),
        F.expr(f"kll_sketch_get_quantile_double(durations, array({_PERCENTS})) AS percents"),
    )
    recent = daily.filter(F.col("day") >= first_recent).withColumn("median_seconds", F.expr(_quantile(0.5)))
    same = [F.col(key).eqNullSafe(F.col(name)) for key, name in named.items()]
    compared = recent.join(baseline, same).select(
        *keys,
        "day",
        "n_runs",
        "median_seconds",
        "baseline_runs",
        "baseline_median_seconds",
        F.expr("CAST(size(filter(percents, q -> q <= median_seconds)) AS BIGINT) AS baseline_percent"),
    )
    slower, faster = f"baseline_percent >= {100 - tail_percent}", f"baseline_percent < {tail_percent}"
    return compared.filter(f"{slower} OR {faster}").withColumn(
        "direction", F.expr(f"IF({slower}, 'slower', 'faster')")
    )


def _series(daily: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, series): the days of a key in order, each with its median; bounded by the look-back."""
    return (
        daily.select(
            *keys,
            F.expr("datediff(day, DATE '1970-01-01') AS d"),
            F.expr(f"CAST({_quantile(0.5)} AS BIGINT) AS v"),
        )
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("d", "v"))).alias("series"))
    )


def duration_trends(
    daily: DataFrame,
    keys: Sequence[str] = JOB_KEYS,
    min_days: int = 5,
    digits: int | None = 4,
) -> DataFrame:
    """How the median duration of a key moves from day to day.

    ``seconds_per_day`` is the Theil-Sen slope, the median of the slopes between all pairs of days,
    which single bad days do not bend; ``fitted_seconds_per_day`` is the least-squares slope. The Mann-Kendall
    statistic ``mann_kendall_z`` counts rising against falling pairs, ties corrected: beyond 1.96
    either way the key is ``rising`` or ``falling``, else ``steady``. Pairs are bounded by the square of the look-back's days.
    """
    pairs = (
        "flatten(transform(series, (p, i) -> transform(slice(series, i + 2, size(series)), "
        "q -> struct((q.v - p.v) / (q.d - p.d) AS slope, CAST(sign(q.v - p.v) AS BIGINT) AS up))))"
    )
    least = (
        "aggregate(series, named_struct('n', 0L, 'd', 0D, 'v', 0D, 'dv', 0D, 'dd', 0D), (s, p) -> named_struct("
        "'n', s.n + 1, 'd', s.d + (p.d - series[0].d), 'v', s.v + p.v, "
        "'dv', s.dv + CAST(p.d - series[0].d AS DOUBLE) * p.v, "
        "'dd', s.dd + CAST(p.d - series[0].d AS DOUBLE) * (p.d - series[0].d)))"
    )
    ties = (
        "aggregate(transform(array_distinct(transform(series, p -> p.v)), "
        "v -> CAST(size(filter(series, p -> p.v = v)) AS DOUBLE)), 0D, (s, t) -> s + t * (t - 1) * (2 * t + 5))"
    )
    found = (
        _series(daily, keys)
        .filter(F.size("series") >= max(min_days, 2))
        .withColumn("n", F.expr("CAST(size(series) AS BIGINT)"))
        .withColumn("pairs", F.expr(pairs))
        .withColumn("slopes", F.expr("sort_array(transform(pairs, p -> p.slope))"))
        .withColumn("s", F.expr("aggregate(pairs, 0L, (s, p) -> s + p.up)"))
        .withColumn("variance", F.expr(f"(n * (n - 1.0D) * (2 * n + 5) - {ties}) / 18"))
        .withColumn("z", F.expr("IF(variance > 0, (s - sign(s)) / sqrt(variance), 0D)"))
        .withColumn("fit", F.expr(least))
    )
    slope = "(slopes[(size(slopes) - 1) div 2] + slopes[size(slopes) div 2]) / 2"
    fitted = "(fit.n * fit.dv - fit.d * fit.v) / (fit.n * fit.dd - fit.d * fit.d)"
    return found.select(
        *keys,
        F.col("n").alias("n_days"),
        F.expr(f"{rounded(slope, digits)} AS seconds_per_day"),
        F.expr(f"{rounded(fitted, digits)} AS fitted_seconds_per_day"),
        F.expr(f"{rounded('z', digits)} AS mann_kendall_z"),
        F.expr(
            f"CASE WHEN z > {TREND_LIMIT}D THEN 'rising' WHEN z < -{TREND_LIMIT}D THEN 'falling' ELSE 'steady' END"
            " AS trend"
        ),
    )


def duration_changes(
    daily: DataFrame,
    keys: Sequence[str] = JOB_KEYS,
    min_days: int = 10,
    rounds: int = 3,
    limit: float = CHANGE_LIMIT,
    digits: int | None = 4,
) -> DataFrame:
    """Days on which the median duration of a key moves to another level.

    Binary segmentation: in each stretch of ``min_days`` days or more, the day that best splits it is the
    one at which the summed distance from the mean is largest (of equal ones the earliest). It is a change if that
    distance, over the standard deviation times the root of the length, exceeds ``limit``. Both sides are then searched
    anew, ``rounds`` times in all, so up to ``2 ** rounds - 1`` changes are found.

    Returns the keys, change_day (the first of the new level), round, days and mean before and after, within
    the stretch, and score. Sums are integers, so equal splits are told apart exactly.
    """
    if rounds < 1:
        raise ValueError(f"a search needs a round or more, not {rounds}")
    stretches = _series(daily, keys)
    found = None
    for n in range(1, rounds + 1):
        searched = _split(stretches.filter(F.size("series") >= max(min_days, 2)))
        changed = searched.filter(f"score > {limit}D")
        changes = changed.select(
            *keys,
            F.expr("date_add(DATE '1970-01-01', series[cut].d) AS change_day"),
            F.lit(n).alias("round"),
            F.expr("CAST(cut AS BIGINT) AS days_before"),
            F.expr("CAST(size(series) - cut AS BIGINT) AS days_after"),
            F.expr(f"{rounded('behind / cut', digits)} AS mean_before_seconds"),
            F.expr(f"{rounded('(total - behind) / (size(series) - cut)', digits)} AS mean_after_seconds"),
            F.expr(f"{rounded('score', digits)} AS score"),
        )
        found = changes if found is None else found.unionByName(changes)
        halves = "explode(array(slice(series, 1, cut), slice(series, cut + 1, size(series)))) AS series"
        stretches = changed.select(*keys, F.expr(halves))
    return found


def _split(stretches: DataFrame) -> DataFrame:
    """Add the best split: ``cut`` days before it, their sum ``behind``, the ``total`` and the ``score``."""
    # The distance of the sum so far from its share of the total, times the number of days.
    scan = (
        "aggregate(series, named_struct('i', 0, 'sum', 0L, 'far', -1L, 'cut', 0, 'behind', 0L), (s, p) -> "
        "IF(s.i + 1 < size(series) AND abs(size(series) * (s.sum + p.v) - (s.i + 1) * total) > s.far, "
        "named_struct('i', s.i + 1, 'sum', s.sum + p.v, "
        "'far', abs(size(series) * (s.sum + p.v) - (s.i + 1) * total), 'cut', s.i + 1, 'behind', s.sum + p.v), "
        "named_struct('i', s.i + 1, 'sum', s.sum + p.v, 'far', s.far, 'cut', s.cut, 'behind', s.behind)))"
    )
    squares = "aggregate(series, 0D, (s, p) -> s + CAST(p.v AS DOUBLE) * p.v)"
    return (
        stretches.withColumn("total", F.expr("aggregate(series, 0L, (s, p) -> s + p.v)"))
        .withColumn("best", F.expr(scan))
        # Size times the sum of squares less the squared sum is the squared size times the variance.
        .withColumn("spread", F.expr(f"size(series) * {squares} - CAST(total AS DOUBLE) * total"))
        .selectExpr(
            "*",
            "best.cut AS cut",
            "best.behind AS behind",
            "IF(spread > 0, best.far / sqrt(spread) / sqrt(size(series)), 0D) AS score",
        )
    )
