from __future__ import annotations

import pytest
from frames import DAY, clusters, readings, slices, utilization

from conftest import rows
from fleetlens.schemas import SCHEMAS, normalize
from fleetlens.sources import (
    Tables,
    availability,
    available_tables,
    describe_table,
    run_sql,
    stage,
    write_report,
    write_table,
)
from fleetlens.sources.sinks import shared_folder


def test_missing_tables_are_empty_and_typed(spark):
    tables = Tables.of(spark, {"node_timeline": readings(spark, ("c", 1.0, 1.0, 1.0, 1.0))})
    assert tables.present == {"node_timeline"}
    assert tables.jobs.count() == 0
    assert tables.jobs.schema == SCHEMAS["jobs"]
    with pytest.raises(ValueError, match="unknown tables"):
        Tables.of(spark, {"nodes": spark.range(1)})
    with pytest.raises(LookupError, match="billing_usage is not bound"):
        _ = tables.billing_usage


def test_availability(spark):
    tables = Tables.of(spark, {"clusters": clusters(spark, ("c", "n", DAY), ("d", "n", DAY))})
    found = {row.table_name: row[1:] for row in availability(tables).collect()}
    assert found["clusters"] == (True, 7, True)
    assert found["job_run_timeline"] == (False, 6, False)
    assert set(found) == set(SCHEMAS)
    counted = {row.table_name: row.n_rows for row in availability(tables, count_rows=True).collect()}
    assert (counted["clusters"], counted["jobs"]) == (2, 0)


def test_aliases(spark):
    old = spark.createDataFrame([("w", "1", "x", DAY)], "workspace_id STRING, job_id STRING, job_name STRING, change_time TIMESTAMP")
    assert normalize("jobs", old).first().name == "x"
    bare = spark.createDataFrame(
        [("c", "n", "UI", DAY, "d1", "w1")],
        "cluster_id STRING, cluster_name STRING, cluster_source STRING, change_time TIMESTAMP, "
        "driver_node_type STRING, worker_node_type STRING",
    )
    row = normalize("clusters", bare).first()
    assert (row.driver_node_type_id, row.node_type_id, row.num_workers) == ("d1", "w1", None)


def test_bind_catalog_and_parquet(spark, tmp_path):
    readings(spark, ("c", 1.0, 1.0, 1.0, 1.0)).createOrReplaceTempView("bound_nodes")
    with pytest.raises(ValueError, match="not_there"):
        Tables.from_catalog(spark, {"node_timeline": "bound_nodes", "jobs": "not_there"})
    tables = Tables.from_catalog(spark, {"node_timeline": "bound_nodes"})
    assert tables.present == {"node_timeline"}
    assert tables.node_timeline.count() == 1
    write_table(tables.node_timeline, str(tmp_path / "nodes"))
    read_back = Tables.from_parquet(spark, {"node_timeline": str(tmp_path / "nodes")})
    assert rows(read_back.node_timeline) == rows(tables.node_timeline)


def test_sql_with_tables_and_parameters(spark):
    tables = Tables.of(spark, {"job_run_timeline": slices(spark, ("1", "r", 0, 1, "FAILED"))})
    text = "SELECT job_id FROM {job_run_timeline} WHERE result_state = :state"
    assert rows(run_sql(spark, text, tables, state="FAILED")) == [("1",)]
    assert rows(run_sql(spark, text, tables, state="x' OR 'a' = 'a")) == []


def test_catalog_listing_and_description(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS telemetry")
    spark.range(1).write.mode("overwrite").saveAsTable("telemetry.node_timeline")
    listed = rows(available_tables(spark, ["telemetry"]))
    assert ("telemetry", "node_timeline") in listed
    described = describe_table(clusters(spark))
    assert rows(described)[:2] == [("cluster_id", "string"), ("cluster_name", "string")]
    assert described.count() == 7


def test_partitioned_output(spark, tmp_path):
    df = utilization(spark, *[(f"c{i}", float(i), 1.0, 1.0, 10, i % 2 == 0) for i in range(20)])
    path = str(tmp_path / "out")
    write_table(df, path, ["driver"])
    assert {p.name for p in (tmp_path / "out").glob("driver=*")} == {"driver=true", "driver=false"}
    assert spark.read.parquet(path).count() == 20
    write_table(df.limit(3), path, ["driver"])
    assert spark.read.parquet(path).count() == 3


def test_report_files_read_in_order(spark, tmp_path):
    lines = spark.range(1000).selectExpr(
        "'s' AS section", "CAST(id % 3 AS INT) AS ord", "CAST(-id AS DOUBLE) AS rank",
        "CAST(id AS STRING) AS line",
    )
    write_report(lines.repartition(7), str(tmp_path / "report"))
    parts = sorted((tmp_path / "report").glob("part-*"))
    written = [line for part in parts for line in part.read_text().splitlines()]
    expected = sorted(range(1000), key=lambda i: (i % 3, -i))
    assert written == [str(i) for i in expected]


def test_staged_frames_lie_in_the_shared_folder(spark):
    staged = stage(spark.range(5), "numbers")
    assert sorted(rows(staged)) == [(i,) for i in range(5)]
    root = spark.conf.get("spark.checkpoint.dir")
    assert all(root in path for path in staged.inputFiles())
    assert shared_folder(spark, "x") != shared_folder(spark, "x")
