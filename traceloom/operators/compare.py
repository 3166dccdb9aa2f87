"""Comparison of traces step by step, without a trace in one row or one task.

Steps are cut into blocks, and a block is summed up as a hash of its steps and what they show. Only blocks' hashes are joined; where two traces
part is then looked for in the steps of one block each. Traces are aligned by position, and of traces of unequal length only the common steps count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256


def numbered(scans: DataFrame, key: str, by: list[str], block: str, *columns: str) -> DataFrame:
    """key, step (from 0), and columns. block is a column that rises with the order, such as a date: steps are counted within it and then over it."""
    own = Window.partitionBy(key, block).orderBy(*by)
    above = Window.partitionBy(key).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    rows = scans.select(key, block, F.row_number().over(own).alias("traceloom_own"), *columns)
    starts = scans.groupBy(key, block).agg(F.count("*").alias("n")).select(key, block, (F.coalesce(F.sum("n").over(above), F.lit(0)) - 1).alias("traceloom_start"))
    return rows.join(starts, [key, block]).select(key, (F.col("traceloom_start") + F.col("traceloom_own")).alias("step"), *columns)


def block_hashes(steps: DataFrame, key: str, shown: Column, width: int) -> DataFrame:
    """key, block, n, sign: sums of hashes of the steps, two of them, which don't depend on the order in which steps are met."""
    one, two = F.xxhash64("step", shown), F.xxhash64(shown, "step", F.lit(1))
    wide = lambda h: F.sum(h.cast("decimal(20,0)"))
    return steps.groupBy(key, F.floor(F.col("step") / width).alias("block")).agg(F.count("*").alias("n"), F.struct(wide(one).alias("x"), wide(two).alias("y")).alias("sign"))


def first_divergence(a: DataFrame, b: DataFrame, key: str, shown: list[str], width: int = BLOCK) -> DataFrame:
    """Of each trace of a or b (key, step from 0, shown): n_a, n_b, n_mismatch (cells of common steps that differ) and first_step where any does.

    Nulls are equal to nulls. Blocks with equal hashes are equal but for a chance of about 2^-128; of the others all steps are compared,
    first_step is among those of the first of them.
    """
    cells = F.struct(*shown)
    hashes = block_hashes(a, key, cells, width).select(key, "block", F.col("n").alias("n_a"), F.col("sign").alias("sign_a"))
    others = block_hashes(b, key, cells, width).select(key, "block", F.col("n").alias("n_b"), F.col("sign").alias("sign_b"))
    blocks = hashes.join(others, [key, "block"], "full")
    sizes = blocks.groupBy(key).agg(F.coalesce(F.sum("n_a"), F.lit(0)).alias("n_a"), F.coalesce(F.sum("n_b"), F.lit(0)).alias("n_b"))
    odd = blocks.filter("sign_a is not null and sign_b is not null and sign_a <> sign_b").select(key, "block")
    in_block = lambda steps: steps.withColumn("block", F.floor(F.col("step") / width)).join(odd, [key, "block"], "left_semi")
    left = in_block(a).select(key, "step", F.struct(*shown).alias("a"))
    right = in_block(b).select(key, "step", F.struct(*shown).alias("b"))
    unequal = sum((F.when(F.col("a")[c].eqNullSafe(F.col("b")[c]), 0).otherwise(1) for c in shown), F.lit(0))
    found = left.join(right, [key, "step"]).withColumn("k", unequal).filter("k > 0").groupBy(key).agg(F.sum("k").alias("n_mismatch"), F.min("step").alias("first_step"))
    return sizes.join(found, key, "left").withColumn("n_mismatch", F.coalesce("n_mismatch", F.lit(0)))


def branch_bitmap(branch: Column) -> Column:
    """Aggregate: the branches (numbers from 0, up to 32,767) that were taken, as a bitmap."""
    return F.bitmap_construct_agg(F.bitmap_bit_position(branch + 1))


def taken(bitmap: Column, branch: Column) -> Column:
    """Whether a branch's bit is set in a bitmap."""
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(branch / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("getbit", byte, F.pmod(branch, F.lit(8)).cast("int")) == 1, F.lit(False))
