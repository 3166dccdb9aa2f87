"""Live traces on real streams: rows out of order, late rows, state at the end, and metrics of each step."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from traceloom.functions import trace as T
from traceloom.plans import traces
from traceloom.streaming import live, metrics, timed

SCANS = "user_id long, ts timestamp, event_id long, run boolean, pulse boolean, reset boolean"


@pytest.fixture()
def stateful(spark):
    before = {k: spark.conf.get(k, None) for k in timed.STATE_STORE}
    for k, v in timed.STATE_STORE.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run(spark, stream, name, out, checkpoint):
    query = stream.writeStream.queryName(name).format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out), query


def test_timers_and_counters_of_a_shuffled_stream(stateful, sf_dir, tmp_path):
    spark = stateful
    scans = traces.scans(spark, sf_dir).withColumn("run", ~F.col("trip")).select("user_id", "ts", "event_id", "run", "pulse", "reset")
    rows = scans.collect()
    random.Random(5).shuffle(rows)
    source, n = tmp_path / "in", 4
    kind = scans.schema
    for i in range(n):
        spark.createDataFrame(rows[i::n], kind).coalesce(1).write.parquet(str(source / f"part={i}"))
    last = max(r.ts for r in rows)
    beat = [(0, last + dt.timedelta(days=d), None, None, None, None) for d in (4000, 8000)]
    for i, b in enumerate(beat):  # the last rows only pass when time goes on, and traces end when they were silent
        spark.createDataFrame([b], kind).coalesce(1).write.parquet(str(source / f"part={n + i}"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(source / "part=*"))
    found, query = run(spark, timed.live_timed(stream, traces.PRESET, traces.COUNTER_CAP, late="3650 days", idle_ms=86_400_000), "timed", str(tmp_path / "out"), str(tmp_path / "cp"))
    assert len(query.recentProgress) >= 4 and timed.late_rows(query.recentProgress) == 0
    timer, counter = traces.trace_on_delay(spark, sf_dir), traces.trace_edge_counter(spark, sf_dir).drop("full")
    want = timer.join(counter, "event_id").select("event_id", "et", "q", "n")
    got = found.select("event_id", "et", "q", "n")
    assert got.count() == len(rows) and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert sum(op["numRowsTotal"] for op in json.loads(query.lastProgress.json)["stateOperators"]) == 0


def test_late_scans_are_dropped_and_counted(stateful, tmp_path):
    spark, start = stateful, dt.datetime(2024, 1, 1)
    at = lambda m: start + dt.timedelta(minutes=m)
    batches = [
        [(1, at(3), 3, True, False, False), (1, at(1), 1, True, True, False), (2, at(2), 20, None, True, None)],
        [(1, at(2), 2, True, True, False), (1, at(40), 40, True, True, False)],  # 2 comes out of order, but within the delay
        [(1, at(42), 42, False, False, False)],  # the delay counts from what the batches before this one had
        [(1, at(4), 4, False, False, True), (1, at(45), 45, True, False, False), (3, at(5), 50, True, True, False)],  # 4 and 50 come too late
        [(9, at(200), None, None, None, None)],
        [(9, at(500), None, None, None, None)],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCANS).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    stream = spark.readStream.schema(SCANS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part=*"))
    heard = metrics.StepMetrics(spark, str(tmp_path / "steps"))
    spark.streams.addListener(heard)
    try:
        rows = metrics.observed(stream, "seen", n=F.count(F.lit(1)), runs=F.count_if("run"))
        found, query = run(spark, timed.live_timed(rows, 2, 3, late="10 minutes", idle_ms=3_600_000), "late", str(tmp_path / "out"), str(tmp_path / "cp"))
        steps = {}
        for _ in range(50):
            steps = {r.batch: r for r in spark.read.json(str(tmp_path / "steps")).collect()} if (tmp_path / "steps").exists() else {}
            if len(steps) >= len(query.recentProgress):
                break
            spark.sparkContext._jvm.Thread.sleep(200)
    finally:
        spark.streams.removeListener(heard)
    got = {r.event_id: (r.user_id, r.et, r.q, r.n) for r in found.collect()}
    assert got == {1: (1, 1, False, 1), 2: (1, 2, True, 1), 3: (1, 2, True, 1), 20: (2, 0, False, 1), 40: (1, 2, True, 2), 42: (1, 0, False, 2), 45: (1, 1, False, 2)}
    assert timed.late_rows(query.recentProgress) == 2
    assert sum(op["numRowsTotal"] for op in json.loads(query.lastProgress.json)["stateOperators"]) == 0
    assert not heard.failed and sum(r.late_rows for r in steps.values()) == 2 and sum(r.rows_in for r in steps.values()) == 11
    assert [steps[i].seen_n for i in range(6)] == [len(b) for b in batches] and steps[0].seen_runs == 2


def test_windows_and_sessions_of_a_stream_with_late_rows(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    at = lambda m: start + dt.timedelta(minutes=m)
    batches = [[(1, at(1), True), (1, at(50), False), (2, at(20), True)], [(1, at(55), True), (1, at(180), False)], [(2, at(183), False)], [(1, at(30), True), (2, at(185), True)], [(9, at(900), False)], [(9, at(990), False)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "user_id long, ts timestamp, trip boolean").coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    stream = lambda: spark.readStream.schema("user_id long, ts timestamp, trip boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part=*"))
    found, query = run(spark, live.trips_by_window(stream()), "windows", str(tmp_path / "w"), str(tmp_path / "wc"))
    assert {r.start: (r.n_scans, r.n_trips) for r in found.collect()} == {start: (4, 3), at(180): (3, 1), at(900): (1, 0)}  # the row of minute 30 came too late
    assert timed.late_rows(query.recentProgress) == 1
    found, query = run(spark, live.sessions(stream()), "sessions", str(tmp_path / "s"), str(tmp_path / "sc"))
    assert {(r.user_id, r.start, r.n_scans) for r in found.collect()} == {(1, at(1), 1), (1, at(50), 2), (2, at(20), 1), (1, at(180), 1), (2, at(183), 2), (9, at(900), 1)}
    assert timed.late_rows(query.recentProgress) == 1


def plain_step(groups):
    sds, zero, nonzero, n, total = [], 0, 0, 0, 0.0
    for g in groups:
        n, total = n + len(g), total + sum(g)
        if len(g) < 2:
            continue
        mean = sum(g) / len(g)
        sds.append((sum((x - mean) ** 2 for x in g) / len(g)) ** 0.5)
        zero += sds[-1] == 0
        nonzero += sum(x != mean for x in g) if sds[-1] else 0
    k = max(1, len(sds))
    return {"n": n, "reward_mean": total / n, "group_reward_std_mean": sum(sds) / k, "zero_variance_group_frac": zero / k, "nonzero_advantage_frac": nonzero / n}


def test_each_step_leaves_its_diagnostics(spark, tmp_path):
    rng = random.Random(1)
    steps = [[[rng.choice([0.0, 0.5, 1.0]) for _ in range(rng.choice([1, 2, 4]))] for _ in range(12)] for _ in range(4)] + [[[0.5, 0.5], [1.0]]]
    for i, groups in enumerate(steps):
        rows = [(f"{i}-{g}", x) for g, own in enumerate(groups) for x in own]
        spark.createDataFrame(rows, "grp string, reward double").coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    stream = spark.readStream.schema("grp string, reward double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part=*"))
    query = stream.writeStream.foreachBatch(metrics.to_step_sink(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(spark.read.json(str(tmp_path / "out")).collect(), key=lambda r: r.step)
    want = {json.dumps({k: round(v, 4) for k, v in plain_step(g).items()}) for g in steps}
    assert len(got) == 5 and {json.dumps({k: float(r[k]) if k != "n" else r[k] for k in plain_step(steps[0])}) for r in got} == want


def test_timer_of_the_library_is_the_streams(spark):
    """The same few scans through the window form."""
    rows = [(1, i, i, r) for i, r in enumerate([True, True, False, True])]
    got = T.with_on_delay(spark.createDataFrame(rows, "user_id long, ts long, event_id long, run boolean"), "run", 2, T.Order("user_id", ("ts", "event_id"))).orderBy("ts").collect()
    assert [(r.et, r.q) for r in got] == [(1, False), (2, True), (0, False), (1, False)]
