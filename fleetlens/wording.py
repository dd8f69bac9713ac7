"""Texts of messages and reports.

Fixed values: the wording and number formats below are part of the results.
They are ``format_string`` templates, filled in on the executors.
"""

# Severities and their order in reports.
SEVERITIES = ("HIGH", "MEDIUM", "LOW", "OTHER")

# Issue rules, in reporting order.
HIGH_CPU = "High CPU"
HIGH_MEMORY = "High Memory"
HIGH_CPU_WAIT = "High CPU Wait"
UNDERUTILIZED = "Underutilized"
ISSUE_MESSAGE = "%s: Cluster %s - %.1f%%"
UNDERUTILIZED_MESSAGE = "%s: Cluster %s - Only %.1f%% CPU"
ISSUE_TAG = "[%s] %s"
NO_ISSUE_DATA = "No cluster data available for analysis"
NO_ISSUES = "No significant performance issues detected"

# Recommendation themes, in reporting order.
THEMES = ("COST OPTIMIZATION", "PERFORMANCE", "MEMORY", "BALANCE", "OTHER")
DOWNSIZE = "%d clusters with <%s%% CPU usage could be downsized"
SCALE_UP = "%d clusters with >%s%% CPU usage may need scaling"
RELIEVE_MEMORY = "%d clusters with >%s%% memory usage need attention"
IMBALANCE = "%d unique clusters show CPU/Memory imbalance"
NO_RECOMMENDATION_DATA = "No data available for recommendations"
NO_RECOMMENDATIONS = "System appears well-optimized"

# Efficiency categories.
CATEGORY_LOW = "Underutilized"
CATEGORY_HIGH = "High Utilization"
CATEGORY_NORMAL = "Normal"

# Alert levels.
LEVEL_CRITICAL = "critical"
LEVEL_WARNING = "warning"
LEVEL_NORMAL = "normal"

# Name of a job without metadata.
UNNAMED_JOB_PREFIX = "Job_"

# Anomaly kinds.
LONG_RUNNING_JOBS = "long_running_jobs"
HIGH_FAILURE_RATES = "high_failure_rates"
UNDERUTILIZED_CLUSTERS = "underutilized_clusters"
OVERUTILIZED_CLUSTERS = "overutilized_clusters"
INEFFICIENT_CLUSTERS = "inefficient_clusters"

# Key figures of the cluster report.
KPI_CLUSTERS = "Clusters analyzed"
KPI_AVG_CPU = "Average CPU utilization"
KPI_PEAK_CPU = "Peak CPU utilization"
KPI_AVG_MEMORY = "Average memory utilization"
KPI_PEAK_MEMORY = "Peak memory utilization"
QUANTILE_CPU = "CPU utilization"
QUANTILE_MEMORY = "Memory utilization"

# Figures of the job report.
JOBS_MONITORED = "Total Jobs Monitored"
JOB_RUNTIME = "Average Job Runtime"
JOB_SUCCESS = "Average Success Rate"
JOB_RUNS = "Total Job Runs"
JOB_FAILURES = "Total Failures"
FLEET_CPU = "Average CPU Utilization"
FLEET_MEMORY = "Average Memory Utilization"
ALL_CPU = "Average CPU Utilization (all groups)"
ALL_MEMORY = "Average Memory Utilization (all groups)"
CLUSTERS_MONITORED = "Total Clusters Monitored"
