"""Rule limits and refresh settings, passed to operators as plain values."""

from __future__ import annotations

from dataclasses import dataclass

# The states a run slice may end in that the statistics look at.
# Any other state counts as neither success nor failure.
SUCCESS_STATE = "SUCCESS"
FAILURE_STATES = ("FAILED", "TIMEOUT", "CANCELLED")

# Bounds of a look-back and the row limits of the short lists.
MIN_LOOKBACK_DAYS = 1
MAX_LOOKBACK_DAYS = 90
TOP_UTILIZATION_ROWS = 20
TOP_JOB_ROWS = 20
TOP_CONSUMER_ROWS = 10
TOP_ANOMALY_ROWS = 5


@dataclass(frozen=True)
class Thresholds:
    """Limits of the anomaly, issue and recommendation rules.

    Percentages are on the 0-100 scale except ``failure_rate``, a fraction.
    All comparisons against these limits are strict.
    """

    # Defaults of the alert settings.
    cpu_percent: float = 80.0
    memory_percent: float = 85.0
    job_duration_minutes: int = 60
    failure_rate: float = 0.1

    # Limits of the per-instance anomaly rules.
    underutilized_cpu: float = 20.0
    underutilized_memory: float = 30.0
    overutilized_cpu: float = 85.0
    overutilized_memory: float = 90.0

    # Limits of the efficiency categories.
    low_cpu_reading: float = 10.0
    low_memory_reading: float = 20.0
    efficient_cpu_floor: float = 20.0
    efficient_memory_floor: float = 30.0
    efficient_cpu_ceiling: float = 80.0
    efficient_memory_ceiling: float = 85.0

    # Limits of the issue rules beyond the alert settings.
    severe_cpu: float = 90.0
    severe_memory: float = 95.0
    high_wait: float = 15.0
    idle_cpu: float = 20.0

    # Limits of the recommendation rules.
    downsize_cpu: float = 30.0
    scale_up_cpu: float = 85.0
    relieve_memory: float = 90.0
    imbalance_gap: float = 40.0


@dataclass(frozen=True)
class RefreshSettings:
    """Cadence of the periodic jobs."""

    # Defaults of the refresh settings.
    refresh_interval_minutes: int = 5
    retention_days: int = 30
