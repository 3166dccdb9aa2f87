"""Joins over time, sketches, the resumable sink and the comparison of traces, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from traceloom.operators import compare, sketches
from traceloom.operators.timejoin import asof_join, overlap_join
from traceloom.plans import timelines
from traceloom.sources.resume import ResumableSink


def plain_asof(left, right, strict, within):
    out = []
    for key, t, name in left:
        fits = [r for r in right if key is not None and t is not None and r[0] == key and r[1] is not None and (r[1] < t if strict else r[1] <= t)]
        best = max(fits, key=lambda r: (r[1], r[2])) if fits else None
        out.append((key, t, name, best[2] if best and (within is None or t <= best[1] + within) else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("strict, within", [(False, None), (True, None), (False, 25)])
def test_asof_with_a_hot_key(spark, strict, within):
    rng = random.Random(3)
    key = lambda: rng.choice([1] * 12 + [2, 3, None])
    left = [(key(), rng.choice([None, *range(4000)]), f"l{i}") for i in range(1500)] + [(1, 5000 + i, f"m{i}") for i in range(50)]
    right = [(key(), rng.choice([None, *range(0, 4000, 7)]), i) for i in range(60)] + [(2, 77, i) for i in range(100, 104)]
    a, b = spark.createDataFrame(left, "k long, t long, name string"), spark.createDataFrame(right, "k long, t long, id long")
    found = asof_join(a, b, ["k"], "t", "t", {"id": "found"}, tie=("id",), strict=strict, within=None if within is None else str(within))
    assert sorted(map(tuple, found.collect()), key=str) == plain_asof(left, right, strict, within)


def test_asof_carries_over_ranges_of_one_key(spark):
    """One value at the beginning, and nothing but rows of the left side in all later ranges."""
    left = spark.range(20_000).select(F.lit(7).alias("k"), F.col("id").alias("t"))
    right = spark.createDataFrame([(7, 10, "first")], "k int, t long, v string")
    found = asof_join(left.repartition(8), right, ["k"], "t", "t", {"v": "v"})
    assert found.filter("v = 'first'").count() == 19_990 and found.filter("v is null and t < 10").count() == 10
    assert asof_join(left, right.limit(0), ["k"], "t", "t", {"v": "v"}).filter("v is null").count() == 20_000
    assert asof_join(left.limit(0), right, ["k"], "t", "t", {"v": "v"}).count() == 0


def test_overlaps_with_long_spans_and_a_hot_key(spark):
    rng = random.Random(4)

    def spans(n, first):
        out = []
        for i in range(n):
            s, size = rng.randrange(-3000, 3000), rng.choice([0, 1, 5, 5, 9, 700, 40_000])
            out.append((rng.choice([1, 1, 1, 2, None]), first + i, s if rng.random() > 0.02 else None, s + rng.randint(0, size)))
        return out + [(1, first + n, 5, 4)]

    left, right = spans(250, 0), spans(200, 1000)
    a, b = spark.createDataFrame(left, "k long, x long, s long, e long"), spark.createDataFrame(right, "k long, y long, u long, v long")
    pairs = overlap_join(a, b, ["k"], ("s", "e"), ("u", "v"))
    got = [(r.x, r.y) for r in pairs.collect()]
    want = {(p[1], q[1]) for p in left for q in right if p[0] == q[0] is not None and None not in (p[2], q[2]) and p[2] <= p[3] and q[2] <= q[3] and p[2] <= q[3] and q[2] <= p[3]}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert overlap_join(a.limit(0), b, ["k"], ("s", "e"), ("u", "v")).count() == 0


def test_no_long_span_is_repeated_for_each_narrow_bin(spark):
    """One span of all time beside many short ones: bins that rows go to stay few."""
    short = spark.range(2000).select(F.lit(1).alias("k"), (F.col("id") * 10).alias("s"), (F.col("id") * 10 + 3).alias("e"))
    wide = spark.createDataFrame([(1, 0, 10**9)], "k int, u long, v long")
    pairs = overlap_join(short, wide, ["k"], ("s", "e"), ("u", "v"))
    assert pairs.count() == 2000
    made = [pairs._jdf.queryExecution().optimizedPlan().toString()]
    assert "Generate explode" in made[0]


def test_sketches_merge_to_what_rows_give(spark):
    rows = spark.range(60_000).select((F.col("id") % 7).alias("g"), (F.col("id") % 30).alias("part"), F.pmod(F.xxhash64("id"), F.lit(9000)).alias("who"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100_000)).alias("v"))
    fine = sketches.sketched(rows, ["g", "part"], F.col("who"), F.col("v"))
    assert dict(fine.dtypes)["distinct_sketch"] == dict(fine.dtypes)["value_sketch"] == "binary"
    merged = sketches.merged(fine, ["g"]).select("g", "n", sketches.n_distinct(F.col("distinct_sketch")).alias("d"), sketches.quantile(F.col("value_sketch"), 0.9).alias("q"))
    exact = rows.groupBy("g").agg(F.count("*").alias("m"), F.count_distinct("who").alias("e"), F.sort_array(F.collect_list("v")).alias("vs"))
    for r in merged.join(exact, "g").collect():
        assert r.n == r.m and abs(r.d - r.e) <= sketches.distinct_bound() * r.e
        assert abs(sum(v <= r.q for v in r.vs) / r.m - 0.9) <= sketches.rank_bound()
    none = spark.createDataFrame([(1, None, None), (1, None, None)], "g int, who long, v double")
    assert sketches.sketched(none, ["g"], F.col("who"), F.col("v")).select("n", sketches.n_distinct(F.col("distinct_sketch"))).first()[:] == (2, 0)


SCHEMA = "g long, v long, run int"


def sums(spark, run, fail=None, calls=None):
    def make(keys):
        calls is not None and calls.append(sorted(r.g for r in keys.collect()))
        bad = F.when(F.col("g") == (fail if fail is not None else -1), F.raise_error(F.lit("broken"))).otherwise(F.col("g"))
        return keys.filter("g <> 5").select(F.explode(F.sequence(F.lit(1), F.lit(3))).alias("v"), bad.cast("long").alias("g"), F.lit(run).alias("run"))

    return make


def test_a_broken_run_leaves_whole_rounds_and_is_resumed(spark, tmp_path):
    sink = ResumableSink(spark, str(tmp_path / "out"), "g", SCHEMA)
    keys, deal = spark.range(12).withColumnRenamed("id", "g"), F.pmod("g", F.lit(4))
    assert sink.rows().count() == 0 and sink.done().count() == 0
    with pytest.raises(Exception, match="broken"):
        sink.write(keys, sums(spark, 1, fail=6), 4, deal)  # in the third round
    assert {r.g for r in sink.done().collect()} == {0, 4, 8, 1, 5, 9}
    assert sorted((r.g, r.v) for r in sink.rows().collect()) == [(g, v) for g in (0, 1, 4, 8, 9) for v in (1, 2, 3)]
    calls = []
    assert sink.write(keys, sums(spark, 2, calls=calls), 4, deal) == 2
    assert calls == [[2, 6, 10], [3, 7, 11]]  # 5 had no rows and is done all the same
    rows = sink.rows().collect()
    assert sorted((r.g, r.v) for r in rows) == [(g, v) for g in range(12) if g != 5 for v in (1, 2, 3)] and {r.g for r in rows if r.run == 1} == {0, 1, 4, 8, 9}
    assert sink.write(keys, sums(spark, 3), 4, deal) == 0 and sink.write(keys.limit(0), sums(spark, 3), 4, deal) == 0
    assert sink.write(spark.range(12, 20).withColumnRenamed("id", "g"), sums(spark, 4), 4) > 0 and sink.done().count() == 20


def test_a_break_before_the_rename_publishes_nothing(spark, tmp_path, monkeypatch):
    sink = ResumableSink(spark, str(tmp_path / "out"), "g", SCHEMA)
    keys = spark.range(6).withColumnRenamed("id", "g")

    def broken(*_):
        raise OSError("no rename")

    monkeypatch.setattr(ResumableSink, "publish", broken)
    with pytest.raises(OSError, match="no rename"):
        sink.write(keys, sums(spark, 1), 2)
    assert sink.rows().count() == 0 and sink.done().count() == 0 and (tmp_path / "out" / ".staged").exists()
    monkeypatch.undo()
    sink.write(keys, sums(spark, 2), 2, most=1)
    assert 0 < sink.done().count() < 6
    sink.write(keys, sums(spark, 2), 2)
    assert sink.done().count() == 6 and not list((tmp_path / "out" / ".staged").glob("*"))


def test_first_divergence_of_unequal_traces(spark):
    rng = random.Random(6)
    a = {k: [(rng.choice([0, 1, None]), rng.randint(0, 3)) for _ in range(rng.choice([0, 1, 30, 900]))] for k in range(40)}
    b = {k: list(v) for k, v in a.items()}
    for k in range(0, 40, 2):
        for _ in range(rng.randint(0, 3)):
            if b[k]:
                i = rng.randrange(len(b[k]))
                b[k][i] = (5, b[k][i][1])
        if k % 4 == 0:
            b[k] = b[k][: len(b[k]) // 2] if k % 8 else b[k] + [(1, 1)] * 40
    frame = lambda traces: spark.createDataFrame([(k, i, *x) for k, own in traces.items() for i, x in enumerate(own)], "trace long, step long, x long, y long").repartition(5)
    got = {r.trace: (r.n_a, r.n_b, r.n_mismatch, r.first_step) for r in compare.first_divergence(frame(a), frame(b), "trace", ["x", "y"], width=16).collect()}
    for k in a:
        pairs = list(zip(a[k], b[k], strict=False))
        off = [i for i, (p, q) in enumerate(pairs) if p != q]
        if a[k] or b[k]:
            assert got[k] == (len(a[k]), len(b[k]), sum((p[0] != q[0]) + (p[1] != q[1]) for p, q in pairs), off[0] if off else None)


def test_steps_are_numbered_across_blocks(spark):
    rows = [(k, d, i) for k in (1, 2) for d in (3, 1, 2) for i in range(4)]
    got = compare.numbered(spark.createDataFrame(rows, "k int, d int, i int"), "k", ["i"], "d", "d", "i").orderBy("k", "step").collect()
    assert [(r.k, r.step, r.d, r.i) for r in got] == [(k, s, s // 4 + 1, s % 4) for k in (1, 2) for s in range(12)]


def test_bitmaps_of_branches(spark):
    rows = spark.createDataFrame([(1, 0), (1, 7), (2, 8), (2, 300), (2, 300)], "trace long, branch long")
    bits = rows.groupBy("trace").agg(compare.branch_bitmap(F.col("branch")).alias("b")).agg(F.bitmap_or_agg("b").alias("b"))
    met = bits.select(*(compare.taken(F.col("b"), F.lit(i).cast("long")).alias(str(i)) for i in (0, 1, 7, 8, 9, 299, 300, 301, 32_767))).first()
    assert list(met) == [True, False, True, True, False, False, True, False, False]


def test_the_resumed_query_has_rows_of_both_runs(spark, sf_dir):
    assert {r.run for r in timelines.sink_resumed(spark, sf_dir).select("run").distinct().collect()} == {1, 2}


def test_sums_and_neighbours_along_an_order(spark):
    from traceloom.operators import ranges

    rng = random.Random(8)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3]), i, rng.randint(0, 9)) for i in range(3000)]
    frame = spark.createDataFrame(rows, "k long, i long, v long").repartition(6)
    total, want = 0, {}
    for k, i, v in sorted(rows):
        want[i] = total
        total += v
    assert {r.i: r.s for r in ranges.running(frame, [F.asc("k"), F.asc("i")], s=F.col("v")).collect()} == want
    for falling in (False, True):
        own, want = {}, {}
        for k, i, v in sorted(rows, key=lambda r: r[1], reverse=falling):
            want[i] = own.get(k, 0)
            own[k] = want[i] + v
        assert {r.i: r.s for r in ranges.running_in_blocks(frame, ["k"], "i", 64, "s", F.col("v"), falling).collect()} == want
    keys = {k: sorted(i for q, i, _ in rows if q == k) for k in (1, 2, 3)}
    after = {i: own[(p + 1) % len(own)] for own in keys.values() for p, i in enumerate(own)}
    assert {r.i: r.n for r in ranges.with_next(frame, "k", "i", "n", around=True).collect()} == after
    assert {r.i for r in ranges.with_next(frame, "k", "i", "n").filter("n is null").collect()} == {own[-1] for own in keys.values()}
    assert ranges.with_next(frame.limit(0), "k", "i", "n").count() == 0 and ranges.running(frame.limit(0), [F.asc("i")], s=F.col("v")).count() == 0
