"""Joins and windows that a library's event tables need: as-of, range, sessions, tumbling windows (extensions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.operators.tasks import saved


def last_before(rows: DataFrame, keys: list[str], at: str, value: Column, name: str) -> DataFrame:
    """``rows`` with the last ``value`` that is not null at or before each row's time: an as-of join of a table with
    itself as one window, which never pairs rows."""
    w = Window.partitionBy(*keys).orderBy(at).rangeBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, columns: list[str]) -> DataFrame:
    """``left`` with the ``columns`` of the latest row of ``right`` at or before its time; null if there is none.

    Both sides go through one window in order of time; a row of the right comes before one of the left at one time.
    """
    value = F.struct(*columns)
    names = [c for c in left.columns if c not in keys and c != at]
    a = left.select(*keys, at, F.lit(1).alias("_side"), F.struct(*names).alias("_own") if names else F.lit(None).alias("_own"), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("_found"))
    b = right.select(*keys, at, F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_own"].dataType).alias("_own"), value.alias("_found"))
    w = Window.partitionBy(*keys).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_last", F.last("_found", ignorenulls=True).over(w)).where("_side = 1")
    return both.select(*keys, at, *(F.col(f"_own.{c}").alias(c) for c in names), *(F.col(f"_last.{c}").alias(c) for c in columns))


def in_range(left: DataFrame, right: DataFrame, key: tuple[str, str], value: str, low: Column, high: Column) -> DataFrame:
    """Rows of both sides with one key, and the right's ``value`` between two bounds of the left: a hash join."""
    return left.join(right, (F.col(key[1]) == F.col(key[0])) & F.col(value).between(low, high))


def sessions(rows: DataFrame, key: str, at: str, order: list[str], gap_seconds: int) -> DataFrame:
    """``rows`` with the number of their session: a new one begins after a gap of more than ``gap_seconds``."""
    w = Window.partitionBy(key).orderBy(*order)
    gap = F.timestamp_diff("SECOND", F.date_trunc("second", F.lag(at).over(w)), F.date_trunc("second", at))
    out = rows.withColumn("_gap", gap)
    return out.withColumn("session", F.sum(F.when(F.col("_gap").isNull() | (F.col("_gap") > gap_seconds), 1).otherwise(0)).over(w)).drop("_gap")


def tumbling(rows: DataFrame, at: str, width: str, keys: list[str], value: str) -> DataFrame:
    """Counts and sums of ``value`` in windows of one width, combined on the map side."""
    return rows.groupBy(F.window(at, width).start.alias("start"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("value"))


def with_ordinals(rows: DataFrame, *order: str, name: str = "ordinal", total: str = "of") -> DataFrame:
    """``rows`` with their place in ``order`` over the whole table, from 1, and how many there are.

    Rows are dealt out by ranges of ``order`` and numbered inside their part; the sizes of the parts, one number each, are
    added up, so no task and no window holds more than its own range.  Rows that are equal in ``order`` come in any order.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    # written down, for another run might cut the ranges elsewhere
    dealt = saved(dealt.withColumn("_part", F.shiftright("_id", 33)).withColumn("_place", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id"), "ordinals")
    sizes, before, starts = sorted(tuple(r) for r in dealt.groupBy("_part").agg(F.count("*")).collect()), 0, []
    for part, n in sizes:
        starts.append((part, before))
        before += n
    base = rows.sparkSession.createDataFrame(starts, "_part long, _before long")  # as many rows as partitions
    out = dealt.join(F.broadcast(base), "_part").withColumns({name: F.col("_before") + F.col("_place") + 1, total: F.lit(before).cast("long")})
    return out.select(*rows.columns, name, total)


def overlapping(left: DataFrame, right: DataFrame, on: tuple[str, str], spans: tuple[str, str, str, str], width: float) -> DataFrame:
    """Pairs of rows of one key whose half-open intervals ``[start, end)`` have a point in common.

    ``spans``: start and end of the left, then of the right, as numbers.  Both sides are dealt into bins of ``width``, which
    with the key are the key of a hash join; a pair is taken in the first bin that both are in, so once.  Choose ``width``
    near the usual length: shorter ones copy long intervals, longer ones compare more.  Rows with a null, and empty
    intervals, meet nothing.
    """
    a0, a1, b0, b1 = spans
    bins = lambda start, end: F.sequence(F.floor(F.col(start) / width), F.greatest(F.floor(F.col(start) / width), F.ceil(F.col(end) / width) - 1))
    some = left.where(F.col(a0) < F.col(a1)).withColumn("_bin", F.explode(bins(a0, a1)))
    other = right.where(F.col(b0) < F.col(b1)).withColumn("_other", F.explode(bins(b0, b1)))
    meets = (F.col(on[0]) == F.col(on[1])) & (F.col("_bin") == F.col("_other")) & (F.col(a0) < F.col(b1)) & (F.col(b0) < F.col(a1))
    first = F.floor(F.greatest(a0, b0) / width) == F.col("_bin")
    return some.join(other, meets & first).drop("_bin", "_other")
