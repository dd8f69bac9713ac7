"""Catalog look-ups and plain SQL over the bound tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from string import Formatter
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.schemas import SCHEMAS
from fleetlens.sources.tables import Tables


def run_sql(spark: SparkSession, text: str, tables: Tables, **params: Any) -> DataFrame:
    """Run SQL over the bound tables.

    ``{node_timeline}`` in the text stands for a bound table and ``:days`` for a
    parameter. Values travel as typed parameters, never as spliced text.
    """
    used = {name for _, name, _, _ in Formatter().parse(text) if name}
    return spark.sql(text, args=params, **{name: getattr(tables, name) for name in used})


def available_tables(spark: SparkSession, schemas: Sequence[str]) -> DataFrame:
    """One row per table of each schema: (schema_name, table_name)."""
    listed = [
        spark.sql("SHOW TABLES IN IDENTIFIER(:schema)", args={"schema": schema})
        .filter("NOT isTemporary")
        .select(F.lit(schema).alias("schema_name"), F.col("tableName").alias("table_name"))
        for schema in schemas
    ]
    return reduce(DataFrame.unionByName, listed)


def describe_table(df: DataFrame) -> DataFrame:
    """Columns of a table in order: (col_name, data_type)."""
    rows = [(field.name, field.dataType.simpleString()) for field in df.schema]
    return df.sparkSession.createDataFrame(rows, "col_name STRING, data_type STRING")


def availability(tables: Tables, count_rows: bool = False) -> DataFrame:
    """Is each table bound, how wide is it, has it rows?

    Rows are probed by reading one. ``count_rows`` counts them all instead, and adds
    ``n_rows``.
    """
    frames = tables.frames()
    probed = []
    for name, schema in SCHEMAS.items():
        df = frames.get(name)
        if df is None:
            df = tables.spark.createDataFrame([], schema)
        rows = df if count_rows else df.limit(1)
        found = rows.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"),
            F.lit(name in tables.present).alias("present"),
            F.lit(len(df.columns)).alias("n_columns"),
            (F.col("n_rows") > 0).alias("has_rows"),
            "n_rows",
        )
        probed.append(found if count_rows else found.drop("n_rows"))
    return reduce(DataFrame.unionByName, probed)


def require_rows(tables: Tables, *names: str) -> None:
    """Gate before a report: raise unless each of these tables is bound and has a row."""
    for name in names:
        if getattr(tables, name).isEmpty():
            raise LookupError(f"table {name} has no rows")
