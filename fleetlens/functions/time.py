"""Look-back filters.

Both filters compare the timestamp column with one folded literal of the
column's own type, so that the predicate reaches the Parquet scan. If the binding
names a column that holds the calendar day of that timestamp, as date-partitioned
fact tables do, it gets a bound too: it prunes partitions, and it passes joins
that a computed timestamp cannot.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.config import MAX_LOOKBACK_DAYS, MIN_LOOKBACK_DAYS

log = logging.getLogger(__name__)

#: Column metadata by which a binding marks the calendar day of a fact row.
DAY_MARK = "fleetlens.calendar_day"


@dataclass(frozen=True)
class DayColumn:
    """A column with the calendar day of the rows' look-back timestamp.

    ``complete`` states that it is never null. A bound on it then also reaches a scan
    below an expression that computes it.
    """

    name: str
    complete: bool = False


def mark_day(df: DataFrame, day: DayColumn) -> DataFrame:
    """Mark the column, so that look-backs prune by it."""
    mark = "complete" if day.complete else "partial"
    return df.withMetadata(day.name, {**df.schema[day.name].metadata, DAY_MARK: mark})


def clock_sql(as_of: datetime | None) -> str:
    """SQL of the clock: now, or a fixed instant.

    A datetime without zone is wall-clock time in the session's time zone.
    """
    return "current_timestamp()" if as_of is None else f"TIMESTAMP '{as_of.isoformat(sep=' ')}'"


def clock(as_of: datetime | None) -> Column:
    return F.expr(clock_sql(as_of))


def checked_days(days: int) -> int:
    """The length of a look-back; one of no whole day is an error."""
    if days < MIN_LOOKBACK_DAYS:
        raise ValueError(f"a look-back needs {MIN_LOOKBACK_DAYS} day or more, not {days}")
    return days


def clamp_days(days: int) -> int:
    """Bring a look-back into the customary range, with a warning.

    No operator calls this; it is for callers that want the guard.
    """
    clamped = min(max(days, MIN_LOOKBACK_DAYS), MAX_LOOKBACK_DAYS)
    if clamped != days:
        log.warning("look-back of %s days is out of range, using %s", days, clamped)
    return clamped


def _bound_day(df: DataFrame, first_day: Column) -> DataFrame:
    """Prune by marked days, with one to spare for tables dated in another time zone.

    Rows without a day stay.
    """
    for field in df.schema:
        mark = field.metadata.get(DAY_MARK)
        if mark:
            in_time = F.col(field.name) >= F.date_sub(first_day, 1)
            df = df.filter(in_time if mark == "complete" else in_time | F.col(field.name).isNull())
    return df


def calendar_lookback(
    df: DataFrame, column: str, days: int, as_of: datetime | None = None
) -> DataFrame:
    """Rows from midnight ``days`` days ago on, that midnight included.

    The window therefore touches ``days + 1`` calendar days.
    """
    first_day = F.date_sub(clock(as_of), days)
    return _bound_day(df.filter(F.col(column) >= first_day), first_day)


def rolling_lookback(
    df: DataFrame, column: str, days: int, as_of: datetime | None = None
) -> DataFrame:
    """Rows strictly later than the instant ``days`` x 24 hours ago."""
    cutoff = clock(as_of) - F.make_dt_interval(F.lit(days))
    typed = cutoff.cast(df.schema[column].dataType)
    return _bound_day(df.filter(F.col(column) > typed), F.to_date(cutoff))
