"""Schemas of the six input tables and the alternative names of their columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


# Input schemas. Key columns may come in other types; operators
# never cast them.
SCHEMAS: dict[str, T.StructType] = {
    "job_run_timeline": _schema(
        workspace_id=T.StringType(),
        job_id=T.StringType(),
        run_id=T.StringType(),
        period_start_time=T.TimestampType(),
        period_end_time=T.TimestampType(),
        result_state=T.StringType(),
    ),
    "jobs": _schema(
        workspace_id=T.StringType(),
        job_id=T.StringType(),
        name=T.StringType(),
        change_time=T.TimestampType(),
    ),
    "node_timeline": _schema(
        cluster_id=T.StringType(),
        instance_id=T.StringType(),
        driver=T.BooleanType(),
        start_time=T.TimestampType(),
        end_time=T.TimestampType(),
        cpu_user_percent=T.DoubleType(),
        cpu_system_percent=T.DoubleType(),
        cpu_wait_percent=T.DoubleType(),
        mem_used_percent=T.DoubleType(),
        network_received_bytes=T.LongType(),
        network_sent_bytes=T.LongType(),
    ),
    "clusters": _schema(
        cluster_id=T.StringType(),
        cluster_name=T.StringType(),
        cluster_source=T.StringType(),
        change_time=T.TimestampType(),
        driver_node_type_id=T.StringType(),
        node_type_id=T.StringType(),
        num_workers=T.LongType(),
    ),
    "node_types": _schema(
        node_type=T.StringType(),
        memory_mb=T.LongType(),
        core_count=T.DoubleType(),
        gpu_count=T.LongType(),
    ),
    "billing_usage": _schema(
        usage_metadata=_schema(cluster_id=T.StringType()),
        sku_name=T.StringType(),
        usage_unit=T.StringType(),
        usage_quantity=T.DecimalType(18, 2),
        usage_date=T.DateType(),
    ),
}

# Names under which some deployments carry a column.
ALIASES: dict[str, dict[str, tuple[str, ...]]] = {
    "jobs": {"name": ("job_name",)},
    "clusters": {
        "driver_node_type_id": ("driver_node_type",),
        "node_type_id": ("worker_node_type",),
        "num_workers": (),
    },
}


def normalize(table: str, df: DataFrame) -> DataFrame:
    """Give aliased columns their standard names; a missing one becomes a typed null."""
    added: dict[str, Column] = {}
    for target, alternatives in ALIASES.get(table, {}).items():
        if target not in df.columns:
            found = next((name for name in alternatives if name in df.columns), None)
            wanted = SCHEMAS[table][target].dataType
            added[target] = F.lit(None).cast(wanted) if found is None else F.col(found)
    return df.withColumns(added) if added else df
