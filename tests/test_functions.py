from pyspark.sql import functions as F

from traceloom.functions import trace as T
from traceloom.functions.metrics import pass_at_k, reward

ORDER = T.Order("k", ("i",))


def trace(spark, **signals):
    n = len(next(iter(signals.values())))
    return spark.createDataFrame([(0, i, *(bool(int(s[i])) for s in signals.values())) for i in range(n)], "k int, i int, " + ", ".join(f"{s} boolean" for s in signals))


def column(df, name):
    return [int(r[name]) for r in df.orderBy("i").collect()]


def test_latches(spark):
    df = trace(spark, on="1001", off="0011")
    df = df.withColumns({"s": T.latch(F.col("on"), F.col("off"), ORDER), "r": T.latch(F.col("on"), F.col("off"), ORDER, reset_dominant=True)})
    assert column(df, "s") == [1, 1, 0, 1]
    assert column(df, "r") == [1, 1, 0, 0]


def test_on_delay(spark):
    df = trace(spark, run="11101")
    assert column(T.with_on_delay(df, "run", 2, ORDER), "et") == [1, 2, 2, 0, 1]
    assert column(T.with_on_delay(df, "run", 2, ORDER), "q") == [0, 1, 1, 0, 0]
    assert column(T.with_on_delay(df, "run", 2, ORDER, delayed=True), "q") == [0, 0, 1, 0, 0]


def test_edge_counter(spark):
    df = trace(spark, p="1101010", r="0000001")
    assert column(T.with_edge_counter(df, F.col("p"), F.col("r"), 2, ORDER), "count") == [1, 1, 1, 2, 2, 2, 0]
    df = trace(spark, p="11", r="10")
    assert column(T.with_edge_counter(df, F.col("p"), F.col("r"), 2, ORDER), "count") == [0, 0]


def test_pass_at_k(spark):
    cases = [(5, 5, 1), (5, 0, 1), (5, 0, 5), (5, 1, 3), (3, 1, 5), (3, 0, 5), (0, 0, 1)]
    want = {"clamp": [1, 0, 0, 0.6, 1, 0, None], "any": [1, 0, 0, 0.6, 1, 0, 0], "unclamped": [1, 0, 0, 0.6, 1, 1, 1]}
    for mode, values in want.items():
        for (n, c, k), v in zip(cases, values, strict=True):
            got = spark.range(1).select(pass_at_k(F.lit(n), F.lit(c), k, mode)).first()[0]
            assert (got is None) == (v is None) and (v is None or abs(got - v) < 1e-9), (mode, n, c, k)


def test_rewards(spark):
    def one(parsed, compiled, p, s, critical, kind):
        s = F.lit(None).cast("double") if s is None else F.lit(s)
        return spark.range(1).select(reward(F.lit(parsed), F.lit(compiled), F.lit(p), s, F.lit(critical), kind)).first()[0]

    assert [one(False, False, 0.0, 0.0, False, k) for k in ("dual", "task", "gated")] == [0, 0, 0]
    assert [round(one(True, True, 0.5, 1.0, False, k), 9) for k in ("dual", "task", "gated")] == [0.65, 0.8, 0.1]
    assert [round(one(True, True, 1.0, None, True, k), 9) for k in ("dual", "task", "gated")] == [1.0, 0.9, 0.9]


def test_up_down_counter_over_batches(spark):
    import random

    rng = random.Random(3)
    rows = [(k, i, rng.random() < 0.5, rng.random() < 0.4) for k in range(3) for i in range(25_000 if k == 1 else 40)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, i int, u boolean, d boolean")
    got = {(r.k, r.i): r.n for r in T.with_up_down_counter(df, F.col("u"), F.col("d"), 3, ORDER, "n").collect()}
    n = {}
    for k, i, u, d in sorted(rows):
        n[k] = min(3, max(0, n.get(k, 0) + u - d))
        assert got[k, i] == n[k]
    assert len(got) == len(rows)


def test_long_folds_are_gathered_in_pieces(spark):
    total = lambda scan, now: F.struct((now["s"] + scan).alias("s"))
    for size in (0, 1, 255, 256, 257, 5000):
        scans = F.sequence(F.lit(1), F.lit(size)) if size else F.array().cast("array<int>")
        got = spark.range(1).select(T.stepped(scans, F.struct(F.lit(0).alias("s")), total, "struct<s:int>").alias("x")).first().x
        assert [r.s for r in got] == [i * (i + 1) // 2 for i in range(1, size + 1)]


def test_rewards_of_every_outcome(spark):
    # Parsed, compiled, share of properties, share of scenarios (none: no scenarios), critical property held; and the three rewards.
    cases = [
        (False, False, 0.0, 0.0, False, 0.0, 0.0, 0.0), (True, False, 0.0, 0.0, False, 0.1, 0.1, 0.1), (True, True, 0.0, 1.0, False, 0.3, 0.6, 0.1), (True, True, 1.0, 1.0, True, 1.0, 1.0, 1.0),
        (True, True, 0.5, 1.0, True, 0.65, 0.8, 0.8), (True, True, 0.5, 1.0, False, 0.65, 0.8, 0.1), (True, True, 1.0, None, True, 1.0, 0.9, 0.9), (True, True, 0.0, None, False, 0.3, 0.2, 0.1),
    ]
    df = spark.createDataFrame(cases, "parsed boolean, compiled boolean, p double, s double, ok boolean, dual double, task double, gated double")
    c = F.col
    for row in df.select(*(reward(c("parsed"), c("compiled"), c("p"), c("s"), c("ok"), k).alias(k + "_") for k in ("dual", "task", "gated")), "dual", "task", "gated").collect():
        assert [round(x, 9) for x in row[:3]] == list(row[3:])
