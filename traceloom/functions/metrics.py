"""Metrics of repeated trials."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pass_at_k(n: Column, c: Column, k: int, mode: str = "clamp") -> Column:
    """Chance that one of k of the n trials is among the c that passed: 1 - C(n-c, k) / C(n, k), as a product.

    Where n < k: ``clamp`` takes k = n; ``any`` gives 1 if c > 0, else 0 (0 for n = 0); ``unclamped`` gives 1; ``require_n`` null.
    """
    n, c = n.cast("int"), c.cast("int")
    k_own = F.least(F.lit(k), n)
    miss = F.aggregate(
        F.when(k_own > 0, F.sequence(F.lit(0), k_own - 1)).otherwise(F.array().cast("array<int>")), F.lit(1.0), lambda a, i: a * F.greatest(n - c - i, F.lit(0)) / (n - i)
    )
    out = F.when(n - c < k_own, 1.0).otherwise(1.0 - miss)
    if mode == "any":
        return F.when(n < k, (c > 0).cast("double")).otherwise(out)
    if mode == "unclamped":
        return F.when(n < k, 1.0).otherwise(out)
    if mode == "require_n":
        return F.when(n >= k, out)
    return F.when(n > 0, out)


def rate(part: Column, whole: Column) -> Column:
    """A ratio of sums, 0 where there is nothing to count."""
    return F.coalesce(F.try_divide(F.sum(part), F.sum(whole)), F.lit(0.0))


def reward(parsed: Column, compiled: Column, property_share: Column, scenario_share: Column, critical_ok: Column, kind: str) -> Column:
    """Graded rewards. dual: 0 / 0.1 / 0.3 + 0.7 p; task: 0 / 0.1 / 0.2 + 0.4 p + 0.4 s (0.2 + 0.7 p without scenarios); gated: task, but
    at most 0.1 unless every critical property passes."""
    task = F.when(scenario_share.isNull(), 0.2 + 0.7 * property_share).otherwise(0.2 + 0.4 * property_share + 0.4 * scenario_share)
    full = 0.3 + 0.7 * property_share if kind == "dual" else task
    out = F.when(~parsed, 0.0).when(~compiled, 0.1).otherwise(full)
    return F.when(~F.coalesce(critical_ok, F.lit(False)), F.least(out, F.lit(0.1))).otherwise(out) if kind == "gated" else out
