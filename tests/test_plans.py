"""Shape of the physical plans over the test tables."""

from __future__ import annotations

import re

import pytest

from fleetlens.checks import bindings, registry
from fleetlens.operators import jobs, nodes
from fleetlens.session import prepare
from fleetlens.sources import stage
from pyspark.sql import functions as F

QUERIES = registry.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.fixture(scope="module")
def timeline(spark, sf_dir):
    """The timeline as one Parquet table, as in production."""
    return stage(bindings.tables(spark, sf_dir).job_run_timeline, "timeline")


def test_lookback_reaches_the_scans(spark, sf_dir):
    nodes_plan = formatted(QUERIES["cluster_utilization_zero"](spark, sf_dir))
    assert "GreaterThanOrEqual(ts,2024-01-24T00:00)" in nodes_plan
    for name in ("job_runtime_metrics", "job_runtime_active"):
        jobs_plan = formatted(QUERIES[name](spark, sf_dir))
        assert "GreaterThanOrEqual(o_orderdate,2000-07-31T00:00)" in jobs_plan
    costs_plan = formatted(QUERIES["cluster_costs"](spark, sf_dir))
    assert "GreaterThanOrEqual(ts,2024-01-24T00:00)" in costs_plan


def test_scans_read_only_the_columns_they_need(spark, timeline):
    no_names = bindings.JOB_DAYS, bindings.JOB_AS_OF
    text = formatted(jobs.recent_job_activity(timeline, *no_names))
    schema = re.search(r"ReadSchema: (struct<.*>)", text).group(1)
    assert "period_end_time" not in schema and "workspace_id" not in schema
    assert "PushedFilters: [IsNotNull(period_start_time), IsNotNull(result_state)" in text or (
        "IsNotNull(result_state)" in text
    )


def test_newest_version_is_limited_before_the_shuffle(spark, sf_dir):
    versions = stage(bindings.tables(spark, sf_dir).jobs, "jobs")
    text = plan(jobs.latest_jobs(versions))
    before, after = text.split("Exchange hashpartitioning")
    assert "WindowGroupLimit" in before and "WindowGroupLimit" in after


def test_run_flags_replace_distinct_counts(spark, sf_dir):
    assert "Expand" not in plan(QUERIES["job_failure_analysis"](spark, sf_dir))


def test_slices_are_aggregated_before_the_shuffle(spark, sf_dir, timeline):
    names = bindings.tables(spark, sf_dir).jobs
    text = plan(jobs.job_health(timeline, names, bindings.JOB_DAYS, bindings.JOB_AS_OF))
    scan = text.index("period_start_time#")
    assert scan > 0
    by_run = re.search(r"Exchange hashpartitioning\(workspace_id#\d+, job_id#\w+, run_id#\w+", text)
    assert by_run and "partial_min(period_start_time" in text[by_run.end() :]


def test_names_join_without_another_shuffle_of_the_jobs(spark, sf_dir, timeline):
    """Beyond broadcast size, statistics and names meet on the partitioning they have."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    adaptive = "spark.sql.adaptive.autoBroadcastJoinThreshold"
    versions = stage(bindings.tables(spark, sf_dir).jobs, "jobs")
    spark.conf.set(key, "-1")
    spark.conf.set(adaptive, "-1")
    try:
        text = plan(jobs.job_health(timeline, versions, bindings.JOB_DAYS, bindings.JOB_AS_OF))
    finally:
        spark.conf.unset(key)
        spark.conf.unset(adaptive)
    assert "SortMergeJoin" in text
    # Slices by run, runs by job, versions by job: nothing else moves.
    assert text.count("Exchange") == 3


def test_top_lists_need_no_full_sort(spark, sf_dir):
    for name in ("cluster_utilization_top20", "simple_job_data", "top_cpu", "top_memory"):
        assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, sf_dir))


def test_issues_read_the_timeline_once(spark, sf_dir):
    df = QUERIES["performance_issues"](spark, sf_dir)
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final


def test_figures_share_one_aggregate_and_unused_ones_are_pruned(spark, sf_dir):
    tables = bindings.tables(spark, sf_dir)
    text = plan(nodes.cluster_utilization_top(tables.node_timeline, 7, bindings.NODE_AS_OF))
    assert "low_cpu_count" not in text and "min(cpu" not in text.replace("partial_", "")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_workers_cross_joins_or_hints(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    for operator in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in text


def test_tables_bucketed_by_job_are_not_shuffled(spark, sf_dir):
    tables = bindings.tables(spark, sf_dir)
    spark.sql("CREATE DATABASE IF NOT EXISTS bucketed")
    for name in ("job_run_timeline", "jobs"):
        writer = getattr(tables, name).write.mode("overwrite").format("parquet")
        writer.bucketBy(8, "workspace_id", "job_id").saveAsTable(f"bucketed.{name}")
    health = jobs.job_health(
        spark.table("bucketed.job_run_timeline"),
        spark.table("bucketed.jobs"),
        bindings.JOB_DAYS,
        bindings.JOB_AS_OF,
    )
    assert "Exchange hashpartitioning" not in plan(health)
    runtime = jobs.runtime_view(health)
    same = QUERIES["job_runtime_metrics"](spark, sf_dir)
    assert runtime.exceptAll(same).count() == 0 and same.exceptAll(runtime).count() == 0


@pytest.fixture
def tight_limits(spark):
    """No broadcasts, and limits at which even the test tables count as skewed."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    # A third of the rows is skew only among many partitions.
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    for key in settings:
        spark.conf.unset(key)


def test_hot_keys_are_split_and_results_stay_whole(spark, sf_dir, duck, tight_limits):
    """A third of the slices in one run, a third of the runs in one job."""
    orders, lineitem, customer = (
        spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("orders", "lineitem", "customer")
    )
    hot_job = "CASE WHEN o_orderkey % 3 = 0 THEN 5 ELSE o_custkey END"
    hot_run = "CASE WHEN l_partkey % 3 = 0 THEN 77 ELSE l_orderkey END"
    prepare(spark)
    # Enough maps for the hot partition to be cut between them.
    timeline = bindings.job_run_timeline(
        orders.repartition(16).withColumn("o_custkey", F.expr(hot_job)),
        lineitem.repartition(16).withColumn("l_orderkey", F.expr(hot_run)),
        customer,
    )
    days = 4000
    found = jobs.run_durations(timeline, days, bindings.JOB_AS_OF)
    rows = sorted(tuple(row) for row in found.collect())
    final = plan(found).split("== Initial Plan ==")[0]
    assert final.count("SortMergeJoin(skew=true)") == 2
    expected = duck.execute(f"""
        SELECT c_nationkey, o_custkey, l_orderkey,
               CAST(max((l_linenumber - 1) * 600 + CAST(l_quantity AS INTEGER) * 60)
                    - min((l_linenumber - 1) * 600) AS BIGINT)
        FROM (SELECT * REPLACE ({hot_run} AS l_orderkey) FROM lineitem)
        JOIN (SELECT * REPLACE ({hot_job} AS o_custkey) FROM orders) ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey
        GROUP BY ALL""").fetchall()
    assert rows == sorted(expected)


def test_building_a_batch_query_starts_no_job(spark, sf_dir):
    spark.sparkContext.setJobGroup("build", "build")
    try:
        for name, query in registry.queries().items():
            if not name.startswith("stream_"):
                query(spark, sf_dir)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("build")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("name", ["simple_job_data", "recent_job_activity"])
def test_slices_collapse_before_grouping_sets(spark, sf_dir, name):
    found = plan(registry.queries()[name](spark, sf_dir))
    assert "HashAggregate" in found[found.index("Expand") :]


@pytest.mark.parametrize("name", ["standard_percentiles", "cluster_quantiles", "reading_percentiles"])
def test_quantiles_keep_no_state_of_all_values(spark, sf_dir, name):
    assert "percentile(" not in plan(registry.queries()[name](spark, sf_dir))
