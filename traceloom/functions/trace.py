"""Stateful functions of ordered traces: window expressions where the state allows it, folds over arrays where it doesn't."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.sources.shared import stored


@dataclass(frozen=True)
class Order:
    """What makes up a trace and in which order its scans come."""

    key: str
    by: tuple[str, ...]

    @property
    def window(self):
        return Window.partitionBy(self.key).orderBy(*self.by)

    @property
    def running(self):
        return self.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def persisted(value: Column, order: Order, initial) -> Column:
    """A sparse input: keeps its last given value."""
    return F.coalesce(F.last(value, ignorenulls=True).over(order.running), F.lit(initial))


def latch(on: Column, off: Column, order: Order, reset_dominant: bool = False) -> Column:
    """On from a scan with ``on`` until one with ``off``; holds in between, and is off at first."""
    pick = F.when(off, False).when(on, True) if reset_dominant else F.when(on, True).when(off, False)
    return persisted(pick, order, False)


def rising(signal: Column, order: Order) -> Column:
    return signal & ~F.lag(signal, 1, False).over(order.window)


def next_scan(signal: Column, order: Order) -> Column:
    """The signal at the next scan; null at the last one, where an obligation on it holds vacuously."""
    return F.lead(signal).over(order.window)


def with_on_delay(df: DataFrame, signal: str, preset: int, order: Order, prefix: str = "", delayed: bool = False) -> DataFrame:
    """df with the timer's elapsed scans (et) and output (q); delayed: the output looks at the time before this scan's is added."""
    off_runs = F.sum(F.when(F.col(signal), 0).otherwise(1)).over(order.running)
    run = Window.partitionBy(order.key, "__run").orderBy(*order.by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    et = F.least(F.lit(preset), F.sum(F.col(signal).cast("int")).over(run)).cast("int")
    out = df.withColumn("__run", off_runs).withColumn(prefix + "et", et).drop("__run")
    seen = F.lag(prefix + "et", 1, 0).over(order.window) if delayed else F.col(prefix + "et")
    return out.withColumn(prefix + "q", F.col(signal) & (seen >= preset))


def with_edge_counter(df: DataFrame, pulse: Column, reset: Column, cap: int, order: Order, name: str = "count") -> DataFrame:
    """df with a count of rising edges that saturates at cap; reset wins, and the edge on a reset scan is consumed."""
    marked = df.withColumn("__edge", rising(pulse, order) & ~reset).withColumn("__island", F.sum(reset.cast("int")).over(order.running))
    island = Window.partitionBy(order.key, "__island").orderBy(*order.by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.withColumn(name, F.least(F.lit(cap), F.sum(F.col("__edge").cast("int")).over(island)).cast("int")).drop("__edge", "__island")


def scans_of(df: DataFrame, order: Order, *columns: str) -> DataFrame:
    """One row per trace with its scans as an ordered array: for folds over traces that fit a row."""
    packed = F.array_sort(F.collect_list(F.struct(*order.by, *columns)))
    return df.groupBy(order.key).agg(packed.alias("scans"))


def with_up_down_counter(df: DataFrame, up: Column, down: Column, cap: int, order: Order, name: str = "count", width: int = 256) -> DataFrame:
    """df with a count clamped to 0..cap on either side after each scan, which no window aggregate gives.

    What some scans in a row do to a count x is least(high, greatest(low, x + shift)), whichever scans they are. So blocks of ``width`` scans are
    summed up as three numbers each, a trace's blocks give the count that each of them starts with, and blocks are then stepped through apart: of a
    long trace a task holds a block's rows or three numbers a block. Columns of df must be of types that can be ordered.
    """
    delta = F.coalesce(up, F.lit(False)).cast("int") - F.coalesce(down, F.lit(False)).cast("int")
    clamp = lambda x: F.least(F.lit(cap), F.greatest(F.lit(0), x))
    placed = df.select(F.col(order.key).alias("__key"), (F.row_number().over(order.window) - 1).alias("i"), delta.alias("d"), F.struct(*df.columns).alias("row"))
    packed = placed.groupBy("__key", F.floor(F.col("i") / width).alias("__block")).agg(F.array_sort(F.collect_list(F.struct("i", "d", "row"))).alias("scans"))
    packed = stored(packed, "blocks")
    same = F.struct(F.lit(0).alias("shift"), F.lit(0).alias("low"), F.lit(cap).alias("high"))
    summed = F.aggregate("scans", same, lambda f, s: F.struct((f["shift"] + s["d"]).alias("shift"), clamp(f["low"] + s["d"]).alias("low"), clamp(f["high"] + s["d"]).alias("high")))
    blocks = packed.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("__block", summed.alias("f")))).alias("blocks"))
    ends = stepped(F.col("blocks"), F.lit(0), lambda b, n: F.least(b["f"]["high"], F.greatest(b["f"]["low"], n + b["f"]["shift"])), "int")
    begun = blocks.withColumn("ends", ends).select("__key", F.posexplode("blocks").alias("k", "b"), "ends")
    begun = begun.select(F.col("__key").alias("__of"), F.col("b.__block").alias("__at"), F.when(F.col("k") > 0, F.get("ends", F.col("k") - 1)).otherwise(0).alias("__start"))
    met = packed.join(begun, F.col("__key").eqNullSafe(F.col("__of")) & (F.col("__block") == F.col("__at")))
    counts = stepped(F.col("scans"), F.col("__start"), lambda s, n: clamp(n + s["d"]), "int")
    each = met.select("scans", counts.alias("counts")).select(F.explode(F.arrays_zip("scans", "counts")).alias("x"))
    return each.select("x.scans.row.*", F.col("x.counts").alias(name))


def stepped(scans: Column, start: Column, step, kind: str, width: int = 256) -> Column:
    """The states after each of an array of scans: step makes a state of a scan and the state before it; kind is a state's type.

    States are gathered in pieces of ``width``, so that a long trace is not copied anew at each scan.
    """
    first = lambda now, empty: F.struct(now.alias("now"), F.array().cast(empty).alias("out"))
    once = lambda value, use: F.get(F.transform(F.array(value), use), 0)

    def one(acc, scan):
        return once(step(scan, acc["now"]), lambda new: F.struct(new.alias("now"), F.concat(acc["out"], F.array(new)).alias("out")))

    def piece(acc, part):
        inner = F.aggregate(part, first(acc["now"], f"array<{kind}>"), one)
        return once(inner, lambda done: F.struct(done["now"].alias("now"), F.concat(acc["out"], F.array(done["out"])).alias("out")))

    n = F.ceil(F.size(scans) / width).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(scans, k * width + 1, F.lit(width)))
    return F.when(n > 0, F.aggregate(parts, first(start, f"array<array<{kind}>>"), piece, lambda acc: F.flatten(acc["out"]))).otherwise(F.array().cast(f"array<{kind}>"))
