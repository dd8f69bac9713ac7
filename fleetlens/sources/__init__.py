from fleetlens.sources.catalog import (
    availability,
    available_tables,
    describe_table,
    run_sql,
)
from fleetlens.sources.sinks import stage, write_report, write_table
from fleetlens.sources.tables import Tables

__all__ = [
    "Tables",
    "availability",
    "available_tables",
    "describe_table",
    "run_sql",
    "stage",
    "write_report",
    "write_table",
]
