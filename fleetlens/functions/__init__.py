from fleetlens.functions.numbers import (
    FAILED,
    SUCCEEDED,
    descending,
    format_duration,
    minutes,
    percent,
    rounded,
    stable_round,
    threshold_level,
)
from fleetlens.functions.time import (
    DayColumn,
    calendar_lookback,
    checked_days,
    clamp_days,
    mark_day,
    rolling_lookback,
)

__all__ = [
    "DayColumn",
    "FAILED",
    "SUCCEEDED",
    "calendar_lookback",
    "checked_days",
    "clamp_days",
    "descending",
    "format_duration",
    "mark_day",
    "minutes",
    "percent",
    "rolling_lookback",
    "rounded",
    "stable_round",
    "threshold_level",
]
