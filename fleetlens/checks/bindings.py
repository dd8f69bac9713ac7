"""The six logical tables as views over the provided test tables.

The views are lazy joins and projections; ``FIXTURES.md`` lists the mapping.
``oracle.py`` states the same mapping in SQL.
"""

from __future__ import annotations

from datetime import datetime
from functools import cache, lru_cache

from pyspark.sql import DataFrame, SparkSession

from fleetlens.functions import DayColumn
from fleetlens.session import prepare
from fleetlens.sources.tables import Tables

# Clocks and look-backs of the registered queries.
JOB_AS_OF = datetime(2001, 8, 1, 13)
JOB_DAYS = 365
NODE_AS_OF = datetime(2024, 1, 31, 13)
NODE_DAYS = 7
INFO_DAYS = 30

# Calendar day of a slice, by which look-backs prune.
DAY_COLUMN = "period_date"


def job_run_timeline(orders: DataFrame, lineitem: DataFrame, customer: DataFrame) -> DataFrame:
    """One slice per line item; a run is an order, a job is a customer.

    Orders meet customers first: of the two joins on large tables only the one
    with line items then moves line items, and it leaves them partitioned by run.
    """
    runs = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        "c_nationkey", "o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority"
    )
    start = "timestampadd(MINUTE, (l_linenumber - 1) * 10, o_orderdate)"
    return lineitem.join(runs, lineitem.l_orderkey == runs.o_orderkey).selectExpr(
        "c_nationkey AS workspace_id",
        "o_custkey AS job_id",
        "o_orderkey AS run_id",
        f"{start} AS period_start_time",
        f"timestampadd(MINUTE, CAST(l_quantity AS INT), {start}) AS period_end_time",
        """CASE
            WHEN o_orderstatus = 'P' OR l_linestatus = 'O' THEN NULL
            WHEN o_orderstatus = 'O' OR l_returnflag = 'R' THEN 'SUCCESS'
            WHEN o_orderpriority = '1-URGENT' THEN 'FAILED'
            WHEN o_orderpriority = '2-HIGH' THEN 'TIMEOUT'
            WHEN o_orderpriority = '3-MEDIUM' THEN 'CANCELLED'
            WHEN o_orderpriority = '5-LOW' THEN 'SKIPPED'
            ELSE 'SUCCESS' END AS result_state""",
        # Order dates are midnights and slices start within the next hour.
        f"CAST(o_orderdate AS DATE) AS {DAY_COLUMN}",
    )


def jobs(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """One version per order; every tenth customer is a job without metadata."""
    named = customer.filter("c_custkey % 10 <> 0")
    return orders.join(named, orders.o_custkey == named.c_custkey).selectExpr(
        "c_nationkey AS workspace_id",
        "c_custkey AS job_id",
        "concat(c_name, '/', o_orderpriority) AS name",
        "timestampadd(MICROSECOND, o_orderkey, o_orderdate) AS change_time",
    )


K = "CAST(get_json_object(props, '$.k') AS DOUBLE)"
CLUSTER_ID = "concat('c-', lpad(CAST(user_id % 20 AS STRING), 2, '0'))"


def node_timeline(events: DataFrame) -> DataFrame:
    """One reading per event; an instance is a user. Takes streams as well."""
    return events.selectExpr("*", f"{K} AS k").selectExpr(
        f"{CLUSTER_ID} AS cluster_id",
        "concat('i-', user_id) AS instance_id",
        "(user_id div 20) % 3 = 0 AS driver",
        "ts AS start_time",
        "timestampadd(MINUTE, 1, ts) AS end_time",
        """CASE WHEN event_type = 'error' AND k < 25 THEN NULL
                ELSE (user_id % 20) * 5.0D + value / 50 END AS cpu_user_percent""",
        "k / 20 AS cpu_system_percent",
        """CASE WHEN event_type = 'view' AND k < 25 THEN NULL
                ELSE k / 4 + (user_id % 20) / 4.0D END AS cpu_wait_percent""",
        """CASE WHEN event_type = 'signup' AND k < 10 THEN NULL
                ELSE least(99.0D, (user_id * 7 % 20) * 5.0D + k / 20) END AS mem_used_percent""",
        "CAST(round(value * 100) AS BIGINT) * 10000 AS network_received_bytes",
        """CASE WHEN event_type = 'click' THEN NULL
                ELSE CAST(round(value * 100) AS BIGINT) * 5000 END AS network_sent_bytes""",
    )


def clusters(events: DataFrame) -> DataFrame:
    """One version per sign-up; cluster 13 has no metadata."""
    signups = events.filter("event_type = 'signup' AND user_id % 20 <> 13")
    return signups.selectExpr("*", f"{K} AS k").selectExpr(
        f"{CLUSTER_ID} AS cluster_id",
        "concat('cluster-', user_id % 20, '-v', event_id) AS cluster_name",
        "CASE WHEN k < 50 THEN 'JOB' ELSE 'UI' END AS cluster_source",
        "ts AS change_time",
        "concat('d', user_id % 4) AS driver_node_type_id",
        "concat('w', user_id % 5) AS node_type_id",
        "CAST(k AS BIGINT) % 8 AS num_workers",
    )


def node_types(part: DataFrame) -> DataFrame:
    return part.select("p_type", "p_size").distinct().selectExpr(
        "concat(p_type, '-', p_size) AS node_type",
        "CAST(p_size * 1024 AS BIGINT) AS memory_mb",
        "CAST(p_size % 16 + 1 AS DOUBLE) AS core_count",
        "CAST(p_size % 3 AS BIGINT) AS gpu_count",
    )


def billing_usage(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        f"""named_struct('cluster_id',
                CASE WHEN event_type <> 'view' THEN {CLUSTER_ID} END) AS usage_metadata""",
        "concat('SKU_', event_type) AS sku_name",
        "'DBU' AS usage_unit",
        "CAST(value AS DECIMAL(18, 2)) AS usage_quantity",
        "CAST(ts AS DATE) AS usage_date",
    )


def run_clusters(timeline: DataFrame) -> DataFrame:
    """Slices with the cluster they ran on, one of twenty by job, moved into the weeks of the readings.

    A run keeps its times of day and begins on minute ``run_id * 7919 % 41760`` of January 2024.
    """
    moved = "TIMESTAMP '2024-01-01' + make_dt_interval(0, 0, run_id * 7919 % 41760)"
    of_day = "(CAST({} AS TIMESTAMP) - date_trunc('DAY', CAST(period_start_time AS TIMESTAMP)))"
    start, end = (of_day.format(f"period_{edge}_time") for edge in ("start", "end"))
    return timeline.selectExpr(
        "workspace_id", "job_id", "run_id",
        "concat('c-', lpad(CAST(job_id % 20 AS STRING), 2, '0')) AS cluster_id",
        f"{moved} + {start} AS period_start_time",
        f"{moved} + {end} AS period_end_time",
    )


@lru_cache(maxsize=4)
def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """All six tables bound to one scale-factor folder; bound once per session."""
    prepare(spark)

    @cache
    def raw(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    return Tables(
        spark,
        {
            "job_run_timeline": lambda: job_run_timeline(
                raw("orders"), raw("lineitem"), raw("customer")
            ),
            "jobs": lambda: jobs(raw("orders"), raw("customer")),
            "node_timeline": lambda: node_timeline(raw("events")),
            "clusters": lambda: clusters(raw("events")),
            "node_types": lambda: node_types(raw("part")),
            "billing_usage": lambda: billing_usage(raw("events")),
        },
        day_columns={"job_run_timeline": DayColumn(DAY_COLUMN, complete=True)},
    )
