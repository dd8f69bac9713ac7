"""Running values over time: the last one and the sum so far, within keys of any size.

A key's rows are cut into slices of time, and only rows of one slice are sorted together. What a
slice needs from those before it is one row: their last value, or their sum. So
a key that holds most of the rows is spread over as many tasks as it has slices.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Length of a slice. A shorter one spreads a key with very many rows a day more widely.
SLICE_SECONDS = 86_400

_MICROS = 1_000_000


def micros(column: str) -> Column:
    """An instant as a plain integer."""
    return F.unix_micros(F.col(column).cast("timestamp"))


def _slice(at: str, seconds: int) -> Column:
    if seconds < 1:
        raise ValueError(f"a slice needs a second or more, not {seconds}")
    return F.expr(f"CAST(floor({at} / {seconds * _MICROS}D) AS BIGINT)")


def asof_join(
    facts: DataFrame,
    versions: DataFrame,
    keys: Sequence[str],
    fact_time: str,
    version_time: str,
    columns: Mapping[str, str],
    tie_break: Sequence[str] = (),
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """Each fact with the version of its key that was valid at its time.

    That is the version with the greatest time not after the fact's, and of several at
    that time the one with the largest ``tie_break``. ``columns`` maps new columns to those of the
    versions. They are null where the key has no version yet, and for facts without a
    time or with a null in a key. Versions without a time are no versions. No fact is lost or doubled.

    Facts and versions are sorted together by slice, facts shuffled once. The last version
    before a slice is put in front of it, for slices with facts.
    """
    clashing = set(columns) & set(facts.columns)
    if clashing:
        raise ValueError(f"columns {sorted(clashing)} are there already")
    names = [f"_key{i}" for i in range(len(keys))]
    place = ["_slice", *names]
    known = versions.dropna(subset=[version_time, *keys]).select(
        *(F.col(key).alias(name) for key, name in zip(keys, names, strict=True)),
        micros(version_time).alias("_at"),
        F.struct(*(F.col(c) for c in tie_break), F.lit(0)).alias("_tie"),
        F.struct(*(F.col(old).alias(new) for new, old in columns.items())).alias("_version"),
    ).withColumn("_slice", _slice("_at", slice_seconds))
    timed = facts.select(
        *(F.col(key).alias(name) for key, name in zip(keys, names, strict=True)),
        micros(fact_time).alias("_at"),
        F.struct(*facts.columns).alias("_fact"),
    ).withColumn("_slice", _slice("_at", slice_seconds))

    # One row for each key and slice with facts or versions: the last version in it.
    ends = known.groupBy(*place).agg(
        F.max_by("_version", F.struct("_at", "_tie")).alias("_version"), F.lit(False).alias("_has_facts")
    )
    used = timed.select(*place).dropna().distinct()
    marks = (
        ends.unionByName(used.withColumn("_has_facts", F.lit(True)), allowMissingColumns=True)
        .groupBy(*place)
        .agg(F.first("_version", ignorenulls=True).alias("_version"), F.max("_has_facts").alias("_has_facts"))
    )
    before = Window.partitionBy(*names).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        marks.withColumn("_version", F.last("_version", ignorenulls=True).over(before))
        .filter("_has_facts AND _version IS NOT NULL")
        .select(*place, "_version")
    )

    rows = timed.unionByName(known, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    # In front of a slice come the carried version (no time), then versions ahead of facts at one instant.
    up_to = (
        Window.partitionBy(*place)
        .orderBy(F.asc_nulls_first("_at"), F.expr("_fact IS NOT NULL"), "_tie")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    valid = F.last("_version", ignorenulls=True).over(up_to)
    return (
        rows.withColumn("_version", valid)
        .filter("_fact IS NOT NULL")
        .select("_fact.*", *(F.col(f"_version.{new}").alias(new) for new in columns))
    )


def running_sums(
    steps: DataFrame,
    keys: Sequence[str],
    at: str,
    sums: Mapping[str, str],
    slice_seconds: int = SLICE_SECONDS,
    following: str | None = None,
) -> DataFrame:
    """Add the sums of columns over a key's steps so far, this one included.

    ``steps`` has one row for each key and instant ``at`` (microseconds). ``sums`` maps new
    columns to summed ones; ``following`` names a column for the instant of the key's next step.
    """
    place = ["_slice", *keys]
    sliced = steps.withColumn("_slice", _slice(at, slice_seconds))
    totals = sliced.groupBy(*place).agg(
        F.min(at).alias("_first"), *(F.sum(old).alias(old) for old in sums.values())
    )
    over_slices = Window.partitionBy(*keys).orderBy("_slice")
    earlier = over_slices.rowsBetween(Window.unboundedPreceding, -1)
    # In front of a slice: what the slices before it add up to, at no instant.
    carried = totals.select(
        *place,
        F.lead("_first").over(over_slices).alias("_next"),
        *(F.coalesce(F.sum(old).over(earlier), F.lit(0)).alias(old) for old in sums.values()),
    )
    inside = Window.partitionBy(*place)
    in_order = inside.orderBy(F.asc_nulls_first(at))
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = {new: F.sum(old).over(so_far) for new, old in sums.items()}
    if following:
        behind = F.last("_next", ignorenulls=True).over(so_far)
        added[following] = F.coalesce(F.lead(at).over(in_order), behind)
    rows = sliced.unionByName(carried, allowMissingColumns=True)
    return rows.withColumns(added).filter(F.col(at).isNotNull()).select(*steps.columns, *added)
