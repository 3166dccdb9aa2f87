"""Joins over time: the last earlier row of a key (as-of), and intervals that overlap. Neither keeps a key's rows in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.sources.shared import stored

Q = "traceloom_"


def asof_join(
    left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, take: dict[str, str], tie: tuple[str, ...] = (),
    strict: bool = False, within: str | None = None,
) -> DataFrame:
    """left with columns of the last row of right that has its keys and isn't later (strict: is earlier), null where there is none.

    take: columns of right and what they are called in the result. Of right's rows of one key and time the largest by tie counts. within: how much
    earlier it may be, as SQL (``interval 1 hour``, ``10``). Rows of right without a key or time match nothing, nor do such rows of left.

    Rows of both sides are dealt into ranges of (key, time), so a hot key fills several of them. Each range carries its last value on; what
    reaches over a range's end is carried in a second pass over one row a range and key that it begins or ends with.
    """
    t, side, order, spread = f"{Q}t", f"{Q}side", f"{Q}order", f"{Q}spread"
    keys = [f"{Q}k{i}" for i in range(len(on))]
    named = lambda frame: [F.col(k).alias(q) for k, q in zip(on, keys, strict=True)]
    found = F.struct(F.col(right_time).alias(f"{Q}at"), *(F.col(c).alias(name) for c, name in take.items()))
    usable = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in (*on, right_time)))
    rows = left.select(*named(left), F.col(left_time).alias(t), F.lit(0 if strict else 1).alias(side), F.struct(*left.columns).alias(f"{Q}l"), F.xxhash64(*left.columns).alias(spread))
    theirs = right.filter(usable).select(*named(right), F.col(right_time).alias(t), F.lit(1 if strict else 0).alias(side), found.alias(f"{Q}r"), F.struct(*tie, F.lit(0)).alias(order))
    sort = [*keys, t, side, order, spread]
    both = rows.unionByName(theirs, allowMissingColumns=True).repartitionByRange(*sort).withColumn(f"{Q}part", F.spark_partition_id())
    both = stored(both, "asof")
    w = Window.partitionBy(f"{Q}part", *keys).orderBy(t, side, order, spread).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = both.withColumn(f"{Q}own", F.last(f"{Q}r", ignorenulls=True).over(w)).filter(F.col(f"{Q}l").isNotNull()).drop(f"{Q}r", order, spread, side)

    # Keys that a range begins or ends with: two a range at most. Only they can go on in another range.
    key = F.struct(*keys)
    ends = both.groupBy(f"{Q}part").agg(F.min(key).alias("a"), F.max(key).alias("b")).select(F.explode(F.array("a", "b")).alias("k")).select("k.*").distinct()
    last = both.filter(F.col(f"{Q}r").isNotNull()).join(F.broadcast(ends), keys).groupBy(f"{Q}part", *keys).agg(F.max_by(f"{Q}r", F.struct(t, order)).alias(f"{Q}r"))
    parts = both.select(f"{Q}part", *keys).join(F.broadcast(ends), keys).distinct().join(last, [f"{Q}part", *keys], "left")
    before = Window.partitionBy(*keys).orderBy(f"{Q}part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.withColumn(f"{Q}carried", F.last(f"{Q}r", ignorenulls=True).over(before)).filter(F.col(f"{Q}carried").isNotNull()).drop(f"{Q}r")
    met = own.join(F.broadcast(carried), [f"{Q}part", *keys], "left")
    value = F.coalesce(f"{Q}own", f"{Q}carried")
    if within is not None:
        value = F.when(F.col(t) <= value[f"{Q}at"] + F.expr(within), value)
    return met.withColumn(f"{Q}v", value).select(f"{Q}l.*", *(F.col(f"{Q}v")[name].alias(name) for name in take.values()))


#: Bins of a level are so many times as wide as those of the level below.
STEP = 8


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """Pairs of rows with equal keys whose spans, from and to whole numbers, both ends included, have a number in common.

    Columns other than the keys must have different names. Rows without a key or an end, or that end before they begin, have no pairs.

    Spans are dealt to bins of time. The narrowest bins are as wide as the median span; a longer span goes to wider ones, so that
    it is in STEP + 1 bins at most, and to one or two of each width above. A pair meets at the wider of its rows' widths and is given by the
    first bin that both are in. So a hot key is dealt over bins and a long span isn't repeated for each short one.
    """
    length = lambda span: F.col(span[1]) - F.col(span[0])
    real = lambda rows, span: rows.filter(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in on)) & (length(span) >= 0))
    left, right = real(left, left_span), real(right, right_span)
    lengths = left.select(length(left_span).alias("n")).unionByName(right.select(length(right_span).alias("n")))
    middle, longest = lengths.agg(F.percentile_approx("n", 0.5), F.max("n")).first()
    widths = [max(1, int(middle or 0))]
    while widths[-1] * STEP <= int(longest or 0):
        widths.append(widths[-1] * STEP)

    def dealt(rows: DataFrame, span: tuple[str, str], wide: bool | None) -> DataFrame:
        """Rows in bins: of their own width (wide False), of wider ones (True), or of both (None)."""
        own = F.lit(0)
        for w in widths[1:]:
            own = own + F.when(length(span) >= w, 1).otherwise(0)
        table = F.array(*map(F.lit, widths))
        levels = F.sequence(own, F.lit(len(widths) - 1))
        levels = F.array(own) if wide is False else F.slice(levels, F.lit(2), F.lit(len(widths))) if wide else levels
        at = rows.withColumn(f"{Q}level", F.explode(levels)).withColumn(f"{Q}width", F.get(table, F.col(f"{Q}level")))
        first, last = (F.floor(F.col(c) / F.col(f"{Q}width")) for c in span)
        return at.withColumn(f"{Q}bin", F.explode(F.sequence(first, last))).withColumn(f"{Q}first", first).drop(f"{Q}width")

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        pairs = a.join(b.withColumnRenamed(f"{Q}first", f"{Q}other"), [*on, f"{Q}level", f"{Q}bin"])
        pairs = pairs.filter((F.col(f"{Q}bin") == F.greatest(f"{Q}first", f"{Q}other")) & (F.col(left_span[0]) <= F.col(right_span[1])) & (F.col(right_span[0]) <= F.col(left_span[1])))
        return pairs.drop(f"{Q}level", f"{Q}bin", f"{Q}first", f"{Q}other")

    out = met(dealt(left, left_span, False), dealt(right, right_span, None))
    if len(widths) > 1:
        out = out.unionByName(met(dealt(left, left_span, True), dealt(right, right_span, False)))
    return out
