"""Binding of the six logical tables to DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cached_property, partial

from pyspark.sql import DataFrame, SparkSession

from fleetlens.functions.time import DayColumn, mark_day
from fleetlens.schemas import SCHEMAS, normalize

Loader = Callable[[], DataFrame]

# Metadata tables that a deployment may go without.
OPTIONAL = frozenset({"jobs", "clusters"})


class Tables:
    """The input tables of one deployment.

    A table is opened when it is first used. Metadata that the deployment does not
    name is empty but typed; every other table that is used must be bound, and
    one that is named must exist.

    ``day_columns`` names, per table, a column with the calendar day of the row's
    timestamp. Look-backs then prune by it; rows without a day stay.
    """

    def __init__(
        self,
        spark: SparkSession,
        loaders: Mapping[str, Loader],
        day_columns: Mapping[str, DayColumn] | None = None,
    ) -> None:
        unknown = (set(loaders) | set(day_columns or {})) - set(SCHEMAS)
        if unknown:
            raise ValueError(f"unknown tables: {sorted(unknown)}")
        self._spark = spark
        self._loaders = dict(loaders)
        self._day_columns = dict(day_columns or {})

    @classmethod
    def of(
        cls,
        spark: SparkSession,
        frames: Mapping[str, DataFrame],
        day_columns: Mapping[str, DayColumn] | None = None,
    ) -> Tables:
        return cls(spark, {name: partial(_same, df) for name, df in frames.items()}, day_columns)

    @classmethod
    def from_catalog(
        cls,
        spark: SparkSession,
        names: Mapping[str, str],
        day_columns: Mapping[str, DayColumn] | None = None,
    ) -> Tables:
        """Bind catalog tables or views, given as logical name -> table name."""
        absent = sorted(name for name in names.values() if not spark.catalog.tableExists(name))
        if absent:
            raise ValueError(f"tables do not exist: {absent}")
        loaders = {k: partial(spark.table, name) for k, name in names.items()}
        return cls(spark, loaders, day_columns)

    @classmethod
    def from_parquet(
        cls,
        spark: SparkSession,
        paths: Mapping[str, str],
        day_columns: Mapping[str, DayColumn] | None = None,
    ) -> Tables:
        """Bind Parquet paths, given as logical name -> path."""
        loaders = {k: partial(spark.read.parquet, path) for k, path in paths.items()}
        return cls(spark, loaders, day_columns)

    @property
    def spark(self) -> SparkSession:
        return self._spark

    @property
    def present(self) -> frozenset[str]:
        return frozenset(self._loaders)

    def _open(self, name: str) -> DataFrame:
        if name in self._loaders:
            df = normalize(name, self._loaders[name]())
            return mark_day(df, self._day_columns[name]) if name in self._day_columns else df
        if name not in OPTIONAL:
            raise LookupError(f"table {name} is not bound")
        return self._spark.createDataFrame([], SCHEMAS[name])

    @cached_property
    def job_run_timeline(self) -> DataFrame:
        return self._open("job_run_timeline")

    @cached_property
    def jobs(self) -> DataFrame:
        return self._open("jobs")

    @cached_property
    def node_timeline(self) -> DataFrame:
        return self._open("node_timeline")

    @cached_property
    def clusters(self) -> DataFrame:
        return self._open("clusters")

    @cached_property
    def node_types(self) -> DataFrame:
        return self._open("node_types")

    @cached_property
    def billing_usage(self) -> DataFrame:
        return self._open("billing_usage")

    def frames(self) -> dict[str, DataFrame]:
        """All tables that are bound or may be empty."""
        return {name: getattr(self, name) for name in SCHEMAS if name in self.present | OPTIONAL}


def _same(df: DataFrame) -> DataFrame:
    return df
