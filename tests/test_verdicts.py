"""Verdict queries against hand-written results and brute force."""

import random

from pyspark.sql import functions as F

from traceloom.functions.metrics import pass_at_k
from traceloom.plans import verdicts as V


def test_best_of_k_sees_successes(spark, sf_dir):
    rows = [("a", "x", False, 1), ("a", "x", True, 2), ("b", "x", False, 1), ("b", "x", False, 2), ("c", "y", False, 10), ("c", "y", True, 11), ("d", "y", True, 1)]
    got = V.best_of(spark.createDataFrame(rows, "task string, tier string, valid boolean, i int"), 10)
    assert sorted(map(tuple, got.collect())) == [("x", 2, 0.5, 4, 2.0), ("y", 2, 0.5, 2, 1.0)]
    trials = V.in_order(spark, sf_dir).collect()
    first = {t: min([r.i for r in trials if r.task == t and r.valid and r.i <= 10], default=None) for t in {r.task for r in trials}}
    got = V.verdict_best_of_k_in_order(spark, sf_dir).collect()
    assert sum(r.tasks for r in got) == len(first) and round(sum(r.success * r.tasks for r in got)) == sum(v is not None for v in first.values()) > 0
    assert sum(r.calls for r in got) == sum(v or 10 for v in first.values()) < 10 * len(first)


def test_bootstrap_draws_like_resampling(spark, sf_dir):
    size, rounds, rng = 80, 2000, random.Random(1)
    values = [rng.random() for _ in range(size)]
    per = spark.createDataFrame([(i, size, v) for i, v in enumerate(values)], "at long, size long, v double")
    by = {}
    for r in V.hashed_draws(per, rounds).collect():
        by.setdefault(r.b, []).append((r["at"], r.v))
    assert len(by) == rounds and all(len(d) == size for d in by.values())
    distinct = sum(len(set(d)) for d in by.values()) / rounds
    assert abs(distinct - size * (1 - (1 - 1 / size) ** size)) < 0.5
    ours = sorted(sum(v for _, v in d) / size for d in by.values())
    brute = sorted(sum(rng.choices(values, k=size)) / size for _ in range(rounds))
    width = lambda m: m[rounds * 39 // 40] - m[rounds // 40]
    assert abs(width(ours) / width(brute) - 1) < 0.1
    got = {r.metric: r for r in V.verdict_bootstrap_resampled(spark, sf_dir).collect()}
    wide = {r.metric: r for r in V.verdict_bootstrap(spark, sf_dir).collect()}
    assert all((got[m].low, got[m].high) == (wide[m].low, wide[m].high) for m in ("valid", "invariant"))


def test_leave_one_out_finds_single_failures(spark, sf_dir):
    rows = [(1, 1, True), (1, 2, False), (2, 1, True), (2, 2, True), (2, 2, False), (3, 1, False), (3, 2, False), (4, 1, False), (5, 1, False), (5, 3, True), (6, 1, True), (6, 3, True)]
    got = V.leave_one_out(spark.createDataFrame(rows, "sample int, scenario int, ok boolean")).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 3, 2, 1.0, 1.0), (2, 2, 3, 2, 1.0, 1.0), (3, 0, 3, 2, 1.0, 1.0)]
    assert V.verdict_leave_one_out_by_order(spark, sf_dir).first().total > 0


# Counts of ten trials for 22 tasks and four models, and published intervals of the mean at k = 1 and k = 10.
COUNTS = """10 10 2 1|7 9 0 0|10 10 0 0|8 10 0 1|9 10 5 1|8 10 5 6|10 10 5 2|5 0 0 0|4 0 0 0|0 0 0 0|10 9 3 1|10 0 0 0|3 3 0 0|1 0 0 0|4 0 0 0|3 0 0 0|3 0 0 0|6 0 0 0|9 10 0 0|6 0 0 0|0 0 0 1|4 10 2 8"""
PUBLISHED = {
    "m0_1": (0.591, 0.455, 0.727), "m0_10": (0.909, 0.773, 1.0), "m1_1": (0.459, 0.264, 0.668), "m1_10": (0.5, 0.273, 0.727),
    "m2_1": (0.1, 0.032, 0.182), "m2_10": (0.273, 0.091, 0.455), "m3_1": (0.095, 0.023, 0.191), "m3_10": (0.364, 0.182, 0.591),
}


def test_intervals_of_the_published_matrix(spark):
    rows = [(i, *map(int, line.split())) for i, line in enumerate(COUNTS.split("|"))]
    per = spark.createDataFrame(rows, "task int, c0 int, c1 int, c2 int, c3 int")
    scores = {f"m{m}_{k}": pass_at_k(F.lit(10), F.col(f"c{m}"), k, "unclamped") for m in range(4) for k in (1, 10)}
    scored = V.numbered(per.select("task", *(c.alias(n) for n, c in scores.items())), "task").drop("task")
    means = V.hashed_draws(scored, V.ROUNDS).groupBy("b").agg(*(F.avg(n).alias(n) for n in scores), (F.avg("m0_1") - F.avg("m1_1")).alias("m0-m1"), (F.avg("m0_1") - F.avg("m3_1")).alias("m0-m3"))
    got = {r.metric: r for r in V.intervals(means, V.ROUNDS, *scores, "m0-m1", "m0-m3").collect()}
    step = 1 / 22 + 0.001  # at k = 10 scores are 0 or 1, so ends of intervals lie on whole parts of 22
    for name, (mean, low, high) in PUBLISHED.items():
        near = step if name.endswith("_10") else 0.03
        assert abs(got[name].mean - mean) < 0.01 and abs(got[name].low - low) < near and abs(got[name].high - high) < near, name
    assert not got["m0-m1"].excludes_0 and got["m0-m3"].excludes_0


def test_hierarchical_draws_widen_the_interval(spark, sf_dir):
    flat = {r.metric: r for r in V.verdict_bootstrap(spark, sf_dir).collect()}["valid"]
    trials = V.verdict_bootstrap_trials(spark, sf_dir).first()
    assert trials.high - trials.low > flat.high - flat.low and abs(trials.mean - flat.mean) < 0.02
