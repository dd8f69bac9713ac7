from fleetlens.streaming.alerts import (
    AlertRule,
    alert_episodes,
    batch_alert_episodes,
    read_windows,
)
from fleetlens.streaming.utilization import (
    read_timeline,
    run_available,
    start_periodic,
    windowed_issues,
    windowed_utilization,
)

__all__ = [
    "AlertRule",
    "alert_episodes",
    "batch_alert_episodes",
    "read_timeline",
    "read_windows",
    "run_available",
    "start_periodic",
    "windowed_issues",
    "windowed_utilization",
]
