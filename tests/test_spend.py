"""Clusters that make up most of the usage."""

from __future__ import annotations

import random
from datetime import date
from decimal import Decimal

from conftest import rows
from frames import AS_OF, clusters, empty
from pyspark.sql import functions as F

from fleetlens.operators import spend
from fleetlens.schemas import SCHEMAS

DAY = date(2024, 1, 14)


def usage(spark, *entries):
    """(cluster, amount[, unit[, day]])"""
    made = [
        ((e[0],), "sku", e[2] if len(e) > 2 else "DBU", Decimal(e[1]), e[3] if len(e) > 3 else DAY) for e in entries
    ]
    return spark.createDataFrame(made, SCHEMAS["billing_usage"])


def listed(spark, table, **settings):
    none = empty(spark, "clusters")["clusters"]
    made = spend.expensive_clusters(table, none, 7, AS_OF, digits=None, **settings)
    return sorted(rows(made, "usage_unit", "place", "cluster_id"), key=repr)


def brute(entries, share=80):
    sums: dict = {}
    for cluster, amount, unit in entries:
        if cluster is not None:
            sums.setdefault(unit, {}).setdefault(cluster, Decimal(0))
            sums[unit][cluster] += Decimal(amount)
    found = []
    for unit, of in sums.items():
        order = sorted(((c, a) for c, a in of.items() if a > 0), key=lambda x: (-x[1], x[0]))
        total, running = sum(a for _, a in order), Decimal(0)
        for place, (cluster, amount) in enumerate(order, 1):
            if running * 100 < total * share:
                found.append((unit, place, cluster))
            running += amount
    return sorted(found, key=repr)


def test_random_usage_equals_brute_force(spark):
    rng = random.Random(1)
    entries = [
        (rng.choice([f"c{i}" for i in range(150)] + [None]),
         str(round(rng.choice([0.01, 1, 1, 1000]) * rng.randint(-2, 9), 2)), rng.choice(["DBU", "GB", None]))
        for _ in range(3000)
    ]
    for share in (10, 50, 80, 100):
        assert listed(spark, usage(spark, *entries), share_percent=share) == brute(entries, share)


def test_ties_and_edges(spark):
    table = usage(spark, ("b", "40"), ("a", "40"), ("c", "15"), ("d", "5"), ("e", "0"), ("f", "-3"), (None, "900"))
    assert listed(spark, table) == [("DBU", 1, "a"), ("DBU", 2, "b")]
    assert listed(spark, table, share_percent=80.5)[-1] == ("DBU", 3, "c")
    old = usage(spark, ("a", "1", "DBU", date(2024, 1, 1)))
    assert listed(spark, old) == []
    assert listed(spark, empty(spark, "billing_usage")["billing_usage"]) == []


def test_shares_and_names(spark):
    table = usage(spark, ("a", "75"), ("b", "25"))
    named = clusters(spark, ("a", "large", AS_OF))
    made = spend.expensive_clusters(table, named, 7, AS_OF)
    columns = ("cluster_id", "cluster_name", "share_percent", "running_percent")
    assert sorted(rows(made, *columns)) == [("a", "large", 75.0, 75.0), ("b", None, 25.0, 100.0)]


def test_no_task_sorts_a_unit(spark):
    amounts = spark.range(20_000).select(
        F.expr("IF(id < 0, NULL, 'DBU') AS unit"), F.col("id").alias("key"), F.expr("CAST(1 + id % 3000 AS DECIMAL(18, 2)) AS amount")
    )
    settings = {
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        made = spend.ranked_shares(amounts, "unit", "key", "amount")
        text = made._jdf.queryExecution().executedPlan().toString()
        placed = made.select("place", "running", F.spark_partition_id().alias("task")).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert "SinglePartition" not in text
    assert sorted(row.place for row in placed) == list(range(1, 20_001))
    tasks = [row.task for row in placed]
    assert len(set(tasks)) > 8 and max(map(tasks.count, set(tasks))) < 6000
