from __future__ import annotations

import pytest
from frames import AS_OF, slices

from conftest import rows, ts
from fleetlens.functions import (
    DayColumn,
    calendar_lookback,
    checked_days,
    clamp_days,
    mark_day,
    rolling_lookback,
)

EDGES = ["2024-01-07 23:59:59", "2024-01-08 00:00:00", "2024-01-08 13:00:00", "2024-01-08 13:00:01"]


def edge_rows(spark, kind="TIMESTAMP"):
    timeline = slices(spark, *[(str(i), "r", ts(t), ts(t), None) for i, t in enumerate(EDGES)])
    return timeline.selectExpr("job_id", f"CAST(period_start_time AS {kind}) AS at")


@pytest.mark.parametrize("kind", ["TIMESTAMP", "TIMESTAMP_NTZ"])
def test_calendar_lookback_starts_at_midnight_inclusive(spark, kind):
    kept = calendar_lookback(edge_rows(spark, kind), "at", 7, AS_OF)
    assert sorted(rows(kept, "job_id")) == [("1",), ("2",), ("3",)]


@pytest.mark.parametrize("kind", ["TIMESTAMP", "TIMESTAMP_NTZ"])
def test_rolling_lookback_is_strict(spark, kind):
    kept = rolling_lookback(edge_rows(spark, kind), "at", 7, AS_OF)
    assert rows(kept, "job_id") == [("3",)]


def test_day_column_bounds_the_scan_without_changing_the_result(spark):
    df = mark_day(edge_rows(spark).selectExpr("*", "CAST(at AS DATE) AS day"), DayColumn("day"))
    assert calendar_lookback(df, "at", 7, AS_OF).count() == 3
    assert rolling_lookback(df, "at", 7, AS_OF).count() == 1


def test_only_marked_days_bound_and_rows_without_a_day_stay(spark):
    days = ["DATE '2024-01-10'", "DATE '2023-12-28'", "CAST(NULL AS DATE)"]
    df = spark.sql(" UNION ALL ".join(
        f"SELECT TIMESTAMP '2024-01-10 00:00:00' AS at, {day} AS period_date" for day in days
    ))
    assert calendar_lookback(df, "at", 7, AS_OF).count() == 3
    assert calendar_lookback(mark_day(df, DayColumn("period_date")), "at", 7, AS_OF).count() == 2


def test_a_look_back_needs_a_day():
    assert checked_days(400) == 400
    with pytest.raises(ValueError, match="look-back"):
        checked_days(0)


@pytest.mark.parametrize("days, expected", [(-3, 1), (0, 1), (1, 1), (45, 45), (90, 90), (400, 90)])
def test_clamp_days(days, expected):
    assert clamp_days(days) == expected


def test_day_column_of_another_time_zone_drops_nothing(spark):
    key = "spark.sql.session.timeZone"
    spark.conf.set(key, "Asia/Tokyo")
    try:
        # Midnight in Tokyo lies on the day before in UTC.
        df = spark.sql(
            "SELECT TIMESTAMP '2024-01-08 00:00:00' AS at, DATE '2024-01-07' AS period_date"
        )
        df = mark_day(df, DayColumn("period_date"))
        assert calendar_lookback(df, "at", 7, AS_OF).count() == 1
    finally:
        spark.conf.set(key, "UTC")


def test_clock_is_wall_clock_time_of_the_session(spark):
    key = "spark.sql.session.timeZone"
    spark.conf.set(key, "America/New_York")
    try:
        df = spark.sql(
            "SELECT TIMESTAMP '2024-01-08 00:00:00' AS at "
            "UNION ALL SELECT TIMESTAMP '2024-01-07 23:59:59'"
        )
        assert calendar_lookback(df, "at", 7, AS_OF).count() == 1
        exact = rolling_lookback(df, "at", 7, ts("2024-01-15 00:00:00-05:00"))
        assert exact.count() == 0
        assert rolling_lookback(df, "at", 7, ts("2024-01-15 04:59:59+00:00")).count() == 1
    finally:
        spark.conf.set(key, "UTC")
