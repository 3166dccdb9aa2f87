"""Sketches that can be merged: distinct counts (HyperLogLog) and quantiles (KLL) of groups, kept as binary columns.

Sketches of fine groups are stored once and merged for any coarser grouping, without reading the rows again. A sketch has a bounded size: about
2^lg_k bytes for distinct values, some kilobytes for quantiles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K, KLL_K = 12, 400


def distinct_bound(lg_k: int = LG_K) -> float:
    """Relative error that an estimate of distinct values passes in less than one case in ten thousand: four standard errors."""
    return 4 * 1.04 / math.sqrt(1 << lg_k)


def rank_bound(k: int = KLL_K) -> float:
    """Error in rank that a quantile passes in less than one case in ten thousand, about twice the bound for one in a hundred, 2.296 / k^0.9021."""
    return 2 * 2.296 / k**0.9021


def sketched(rows: DataFrame, by: list[str], distinct: Column, value: Column, lg_k: int = LG_K, k: int = KLL_K) -> DataFrame:
    """by, n, distinct_sketch and value_sketch of each group; null values are in neither, and a group without any has null there."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.hll_sketch_agg(distinct, lg_k).alias("distinct_sketch"), F.kll_sketch_agg_double(value.cast("double"), k).alias("value_sketch"))


def merged(sketches: DataFrame, by: list[str], k: int = KLL_K) -> DataFrame:
    """The same for coarser groups, from their parts' sketches."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("value_sketch", k).alias("value_sketch"))


def n_distinct(sketch: Column) -> Column:
    return F.hll_sketch_estimate(sketch)


def quantile(sketch: Column, share: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(share))
