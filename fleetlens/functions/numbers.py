"""Expressions shared by the operators. Built-in functions only.

Long lists of figures are written as SQL text: Spark parses a text in one step,
while a Column is built over the Python bridge one call at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens import wording
from fleetlens.config import FAILURE_STATES, SUCCESS_STATE

BYTES_PER_MB = 1024 * 1024

# Conditions on the state of a run slice; null for an unknown state.
SUCCEEDED = f"result_state = '{SUCCESS_STATE}'"
FAILED = f"result_state IN {FAILURE_STATES}"


def rounded(sql: str, digits: int | None = 2) -> str:
    """SQL that rounds ``sql`` half up to ``digits`` and gives a double.

    A sum of doubles differs in its last bits with the order of the tasks. The
    detour over a six-digit decimal removes that noise first, so a value on a
    tie rounds the same way on every run. ``digits=None`` leaves the value as
    it is. NaN becomes null, and so never passes a threshold.
    """
    if digits is None:
        return sql
    return f"CAST(round(try_cast({sql} AS DECIMAL(38, 6)), {digits}) AS DOUBLE)"


def percent(part: str, whole: str) -> str:
    """SQL of ``part`` as a rounded percentage of ``whole``; null for an empty whole."""
    return rounded(f"try_divide({part} * 100.0D, {whole})")


def stable_round(value: Column, digits: int | None = 2) -> Column:
    """``rounded`` for a column."""
    if digits is None:
        return value
    return F.round(value.try_cast("decimal(38,6)"), digits).cast("double")


def descending(keys: Sequence[str], *columns: str) -> list[Column]:
    """Largest first, nulls last. The keys break ties, so no sort key is hot."""
    return [F.desc_nulls_last(name) for name in columns] + [F.col(name) for name in keys]


def minutes(seconds: Column) -> Column:
    return stable_round(seconds / F.lit(60))


def format_duration(seconds: Column) -> Column:
    """Seconds as ``12.3s``, ``4.5m`` or ``6.7h``."""

    def shown(amount: Column, unit: str) -> Column:
        return F.format_string(f"%.1f{unit}", stable_round(amount, 1))

    return (
        F.when(seconds < 60, shown(seconds.cast("double"), "s"))
        .when(seconds < 3600, shown(seconds / 60, "m"))
        .when(seconds.isNotNull(), shown(seconds / 3600, "h"))
    )


def threshold_level(value: Column, warning: float, critical: float) -> Column:
    """Alert level of a value; both limits are inclusive."""
    return (
        F.when(value >= F.lit(critical), wording.LEVEL_CRITICAL)
        .when(value >= F.lit(warning), wording.LEVEL_WARNING)
        .otherwise(wording.LEVEL_NORMAL)
    )
