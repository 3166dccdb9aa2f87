"""Queries of the invariant engine: verdicts over all reachable states, and folds against windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from traceloom.functions import trace as T
from traceloom.operators.controller import Controller, check, reachable, run_traces, vacuous
from traceloom.plans.traces import ALARM, KEY, S, scans
from traceloom.sources.tables import table


def latch(first: str) -> Controller:
    def step(e):
        on, off = F.when(e["set"], True), F.when(e["reset"], False)
        return {"q": F.coalesce(on, off, e["q"]) if first == "set" else F.coalesce(off, on, e["q"])}

    return Controller({"set": None, "reset": None}, {"q": False}, step)


def counter(guard: int) -> Controller:
    """Counts scans with a pulse while the count is below the guard."""
    step = lambda e: {"c": F.when(e["reset"], 0).when(e["pulse"] & (e["c"] < guard), e["c"] + 1).otherwise(e["c"])}
    return Controller({"pulse": None, "reset": None}, {"c": 0}, step, {"c": (0, 9)})


def timer(preset: int) -> Controller:
    def step(e):
        et = F.when(e["run"], F.least(F.lit(preset), e["et"] + 1)).otherwise(0)
        return {"et": et, "q": e["run"] & (et >= preset)}

    return Controller({"run": None}, {"et": 0, "q": False}, step)


MODELS = {
    "counter_3": (counter(3), {"c <= 3": lambda e: e["c"] <= 3, "c >= 0": lambda e: e["c"] >= 0}, {}),
    "counter_4": (counter(4), {"c <= 3": lambda e: e["c"] <= 3, "c >= 0": lambda e: e["c"] >= 0}, {}),
    "latch_reset": (latch("reset"), {"reset -> !q": lambda e: ~e["reset"] | ~e["q"]}, {"q -> X(q | reset)": lambda a, b: ~a["q"] | b["q"] | b["reset"]}),
    "latch_set": (latch("set"), {"reset -> !q": lambda e: ~e["reset"] | ~e["q"]}, {"q -> X(q | reset)": lambda a, b: ~a["q"] | b["q"] | b["reset"]}),
    "timer_2": (timer(2), {"q -> run": lambda e: ~e["q"] | e["run"]}, {}),
}


def over_models(spark, sf_dir, find):
    """What find gives for each model, for all suppliers that use it; a supplier's nation says which model that is. A model is searched once."""
    found = reduce(lambda a, b: a.unionByName(b), [find(*m).withColumn("model", F.lit(k)) for k, m in MODELS.items()])
    names = F.array(*map(F.lit, MODELS))
    users = table(spark, sf_dir, "supplier").select("s_suppkey", F.get(names, F.pmod("s_nationkey", F.lit(len(MODELS))).cast("int")).alias("model"))
    return users.join(found, "model")


def invariant_verdicts(spark, sf_dir):
    """Verdicts of all models with the lengths of shortest counterexamples."""
    return over_models(spark, sf_dir, lambda c, always, then: check(spark, c, always, then).select("property", "status", "length"))


def invariant_states(spark, sf_dir):
    """Reachable states of each model and the round in which each is first met."""
    return over_models(spark, sf_dir, lambda c, always, then: reachable(spark, c).select(F.to_json("state").alias("state"), "round"))


def invariant_vacuity(spark, sf_dir):
    """Properties that a controller which does nothing has as well."""
    return over_models(spark, sf_dir, lambda c, always, then: vacuous(spark, c, always))


def trace_fold_against_window(spark, sf_dir):
    """Of each trace, scans at which the fold of the latch differs from its window form."""
    rows = scans(spark, sf_dir).select("user_id", "ts", "event_id", F.col("trip").alias("set"), "reset")
    folded = run_traces(rows, latch("set"), KEY).select("user_id", F.explode(F.arrays_zip("scans", "states")).alias("x")).select("user_id", F.col("x.scans.event_id").alias("event_id"), F.col("x.states.q").alias("q"))
    alarm = rows.withColumn("alarm", T.latch(F.col("set"), F.col("reset"), KEY)).select("user_id", "event_id", "alarm")
    both = folded.join(alarm, ["user_id", "event_id"])
    return both.groupBy("user_id").agg(F.count("*").alias("n_scans"), F.count_if("q").alias("n_alarm"), F.count_if(F.col("q") != F.col("alarm")).alias("n_differ"))


#: Breadth-first search in SQL; 9 rounds are enough for these models.
SEARCH = """b AS (SELECT unnest([TRUE, FALSE]) AS v), i AS (SELECT x.v AS x, y.v AS y FROM b x, b y),
    ls(q, d) AS (SELECT FALSE, 0 UNION SELECT x OR (q AND NOT y), d + 1 FROM ls, i WHERE d < 9),
    lr(q, d) AS (SELECT FALSE, 0 UNION SELECT NOT y AND (x OR q), d + 1 FROM lr, i WHERE d < 9),
    c3(c, d) AS (SELECT 0, 0 UNION SELECT CASE WHEN y THEN 0 WHEN x AND c < 3 THEN c + 1 ELSE c END, d + 1 FROM c3, i WHERE d < 9),
    c4(c, d) AS (SELECT 0, 0 UNION SELECT CASE WHEN y THEN 0 WHEN x AND c < 4 THEN c + 1 ELSE c END, d + 1 FROM c4, i WHERE d < 9),
    t2(et, q, d) AS (SELECT 0, FALSE, 0 UNION SELECT CASE WHEN v THEN least(2, et + 1) ELSE 0 END, v AND et + 1 >= 2, d + 1 FROM t2, b WHERE d < 9)"""


def sql_verdict(model, name, source, bad, extra):
    return f"""SELECT '{model}' AS model, '{name}' AS property, CASE WHEN count(*) > 0 THEN 'fail' ELSE 'pass' END AS status, CAST(min(d) + {extra} AS INTEGER) AS length
               FROM (SELECT d FROM {source} WHERE {bad})"""


def sql_latch(model, s, step, then):
    one = f"(SELECT d, x, y, {step} AS n FROM {s}, i)"
    two = f"(SELECT d, n, y2, {then} AS m FROM (SELECT d, {step} AS n FROM {s}, i), (SELECT x AS x2, y AS y2 FROM i))"
    return [sql_verdict(model, "reset -> !q", one, "y AND n", 1), sql_verdict(model, "q -> X(q | reset)", two, "n AND NOT m AND NOT y2", 2)]


VERDICTS = " UNION ALL ".join([
    *sql_latch("latch_set", "ls", "x OR (q AND NOT y)", "x2 OR (n AND NOT y2)"),
    *sql_latch("latch_reset", "lr", "NOT y AND (x OR q)", "NOT y2 AND (x2 OR n)"),
    *(sql_verdict(f"counter_{g}", p, f"c{g}", bad, 0) for g in (3, 4) for p, bad in (("c <= 3", "c > 3"), ("c >= 0", "c < 0"))),
    sql_verdict("timer_2", "q -> run", "(SELECT d, v, v AND et + 1 >= 2 AS n FROM t2, b)", "n AND NOT v", 1),
])

USERS = f"(SELECT s_suppkey, ([{', '.join(f"'{k}'" for k in MODELS)}])[CAST(s_nationkey % {len(MODELS)} AS BIGINT) + 1] AS model FROM supplier)"
ORACLE_SQL = {
    "invariant_verdicts": f"WITH RECURSIVE {SEARCH}, v AS ({VERDICTS}) SELECT * FROM {USERS} JOIN v USING (model)",
    "invariant_states": f"""WITH RECURSIVE {SEARCH}, a AS (
        SELECT 'latch_set' AS model, '{{"q":' || q || '}}' AS state, d FROM ls UNION ALL SELECT 'latch_reset', '{{"q":' || q || '}}', d FROM lr
        UNION ALL SELECT 'counter_3', '{{"c":' || c || '}}', d FROM c3 UNION ALL SELECT 'counter_4', '{{"c":' || c || '}}', d FROM c4
        UNION ALL SELECT 'timer_2', '{{"et":' || et || ',"q":' || q || '}}', d FROM t2)
        SELECT * FROM {USERS} JOIN (SELECT model, state, CAST(min(d) AS INTEGER) AS round FROM a GROUP BY 1, 2) USING (model)""",
    "invariant_vacuity": f"""SELECT * FROM {USERS} JOIN (VALUES ('counter_3', 'c <= 3', TRUE), ('counter_3', 'c >= 0', TRUE), ('counter_4', 'c <= 3', TRUE), ('counter_4', 'c >= 0', TRUE),
        ('latch_reset', 'reset -> !q', TRUE), ('latch_set', 'reset -> !q', TRUE), ('timer_2', 'q -> run', TRUE)) v(model, property, vacuous) USING (model)""",
    "trace_fold_against_window": f"WITH {S}, {ALARM} SELECT user_id, count(*) AS n_scans, count(*) FILTER (alarm) AS n_alarm, CAST(0 AS BIGINT) AS n_differ FROM a GROUP BY 1",
}
QUERIES = {k: globals()[k] for k in ORACLE_SQL}
