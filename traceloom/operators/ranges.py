"""Sums and neighbours along an order, without one task that sorts all rows or all of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.sources.shared import stored

PART = "traceloom_part"


def in_ranges(rows: DataFrame, *order: Column) -> DataFrame:
    """rows, dealt into ranges of the order and stored, with the range's number: it must not change when a task runs again."""
    return stored(rows.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()), "ranges")


def running(rows: DataFrame, order: list[Column], **values: Column) -> DataFrame:
    """rows with the sums of values over all rows before them: ranges of the order are summed apart, then their totals, a row a range."""
    part = in_ranges(rows, *order)
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    totals = part.groupBy(PART).agg(*(F.sum(v).alias(k) for k, v in values.items()))
    starts = totals.select(PART, *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"{k}_start") for k in values))
    own = Window.partitionBy(PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = part.select("*", *(F.coalesce(F.sum(v).over(own), F.lit(0)).alias(f"{k}_own") for k, v in values.items()))
    return sums.join(starts, PART).select(*rows.columns, *((F.col(f"{k}_own") + F.col(f"{k}_start")).alias(k) for k in values))


def running_in_blocks(rows: DataFrame, by: list[str], order: str, width: int, name: str, value: Column, falling: bool = False) -> DataFrame:
    """rows with the sum of a value over the rows of the same key (by) that come before, in the order of whole numbers, rising or falling.

    Blocks of ``width`` numbers are summed apart and then over a key's blocks, so that no task needs all of a key.
    """
    way = (lambda c: F.desc(c)) if falling else (lambda c: F.asc(c))
    blocked = rows.withColumn("traceloom_block", F.floor(F.col(order) / width)).withColumn("traceloom_value", value)
    above = Window.partitionBy(*by).orderBy(way("traceloom_block")).rowsBetween(Window.unboundedPreceding, -1)
    starts = blocked.groupBy(*by, "traceloom_block").agg(F.sum("traceloom_value").alias("total"))
    starts = starts.select(*by, "traceloom_block", F.coalesce(F.sum("total").over(above), F.lit(0)).alias("traceloom_start"))
    own = Window.partitionBy(*by, "traceloom_block").orderBy(way(order)).rowsBetween(Window.unboundedPreceding, -1)
    sums = blocked.withColumn("traceloom_own", F.coalesce(F.sum("traceloom_value").over(own), F.lit(0)))
    return sums.join(starts, [*by, "traceloom_block"]).select(*rows.columns, (F.col("traceloom_own") + F.col("traceloom_start")).alias(name))


def with_next(rows: DataFrame, key: str, order: str, name: str, around: bool = False) -> DataFrame:
    """rows with the next value of order of the same key, null at its end, or there (around) the key's first one.

    A range that has no later row of a key takes the first one of the key's next range; there is a row for each range and key, which is one a range besides
    the keys that lie within one.
    """
    part = in_ranges(rows, F.asc(key), F.asc(order))
    own = part.withColumn("traceloom_own", F.lead(order).over(Window.partitionBy(PART, key).orderBy(order)))
    firsts = part.groupBy(PART, key).agg(F.min(order).alias("traceloom_first"))
    w = Window.partitionBy(key)
    after = F.lead("traceloom_first").over(w.orderBy(PART))
    after = F.coalesce(after, F.min("traceloom_first").over(w)) if around else after
    return own.join(firsts.select(PART, key, after.alias("traceloom_after")), [PART, key]).select(*rows.columns, F.coalesce("traceloom_own", "traceloom_after").alias(name))
