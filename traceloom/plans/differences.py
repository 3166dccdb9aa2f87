"""Queries that compare traces: a timer against two other ones step by step, and what branches traces have been through."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceloom.functions import trace as T
from traceloom.operators import compare
from traceloom.plans.traces import HIGH, KEY, LOW, PRESET, S, TON, W, scans, trace_timer_events
from traceloom.sources.shared import stored

#: The second timer's run ends after so many scans.
STEPS = 45
POOLS = 3
#: Branches of a controller, by number: of a chain of conditions, and labels of a choice.
CONDITIONS = ("trip", "full", "empty", "start", "else")
LABELS = ("click", "view", "purchase", "signup", "error", "refund")
FIRST_LABEL = 8


def three_timers(spark, sf_dir):
    """Steps of each user with the output of a timer, of one whose output is a scan late, and of such a one with its preset less one."""
    run = scans(spark, sf_dir).withColumn("run", ~F.col("trip"))
    timed = T.with_on_delay(run, "run", PRESET, KEY)
    timed = T.with_on_delay(timed, "run", PRESET, KEY, prefix="late_", delayed=True)
    timed = T.with_on_delay(timed, "run", PRESET - 1, KEY, prefix="less_", delayed=True)
    shown = timed.withColumns({"day": F.to_date("ts"), "ok": ~F.col("q"), "late_ok": ~F.col("late_q"), "less_ok": ~F.col("less_q")})
    return stored(compare.numbered(shown, "user_id", ["ts", "event_id"], "day", "q", "ok", "late_q", "late_ok", "less_q", "less_ok", "run"), "steps")


def against(steps, other: str):
    own = steps.select("user_id", "step", "q", "ok")
    theirs = steps.filter(F.col("step") < STEPS).select("user_id", "step", F.col(f"{other}_q").alias("q"), F.col(f"{other}_ok").alias("ok"))
    return compare.first_divergence(own, theirs, "user_id", ["q", "ok"], width=16)


def trace_divergence(spark, sf_dir):
    """Of each user the steps of both runs, the cells in which they differ, and the first step that does."""
    out = against(three_timers(spark, sf_dir), "late")
    return out.select("user_id", "n_a", "n_b", F.col("n_mismatch").cast("long").alias("n_mismatch"), F.col("first_step").cast("long").alias("first_step"))


def trace_divergence_pools(spark, sf_dir):
    """Status of the comparison with both other timers, counted for each pool of users and for all of them."""
    steps = three_timers(spark, sf_dir)
    used = steps.groupBy("user_id").agg(F.bool_or("run").alias("timer"))
    raw = against(steps, "late").select("user_id", F.col("n_mismatch").alias("raw"), (F.col("n_a") != F.col("n_b")).alias("cut"))
    less = against(steps, "less").select("user_id", F.col("n_mismatch").alias("less"))
    rows = used.join(raw, "user_id").join(less, "user_id").withColumn("pool", F.explode(F.array(F.pmod("user_id", F.lit(POOLS)).cast("string"), F.lit("all"))))
    timer, exact, fits = F.col("timer"), F.col("raw") == 0, F.col("less") == 0
    return rows.groupBy("pool").agg(
        F.count("*").alias("n"), F.count_if(timer).alias("timer_traces"), F.count_if(~timer).alias("timerless"), F.count_if(exact).alias("raw_exact"), F.count_if(timer & ~exact).alias("raw_mismatch_timer"),
        F.count_if(~timer & ~exact).alias("raw_mismatch_timerless"), F.count_if(timer & fits).alias("comp_exact"), F.count_if(timer & ~fits).alias("comp_mismatch"), F.count_if("cut").alias("cut_short"),
    )


def branches(spark, sf_dir):
    """Scans with the condition and the label that they go through, as numbers."""
    level = F.col("level")
    chain = F.when(F.col("trip"), 0).when(level >= HIGH, 1).when(level <= LOW, 2).when(F.col("start"), 3).otherwise(4)
    kind = F.when(F.col("trip"), "error").when(F.col("reset"), "signup").when(F.col("start"), "click").when(F.col("pulse"), "purchase").otherwise("view")
    label = F.array_position(F.array(*map(F.lit, LABELS)), kind) - 1 + FIRST_LABEL
    return scans(spark, sf_dir).select("user_id", F.explode(F.array(chain.cast("long"), label)).alias("branch"))


def trace_branches(spark, sf_dir):
    """Branches met of each pool and of all, out of how many, the ones never met; and timers by which of their events were seen.

    A trace's branches are a bitmap, and bitmaps of traces are united.
    """
    traces = branches(spark, sf_dir).groupBy("user_id").agg(compare.branch_bitmap(F.col("branch")).alias("bits"))
    in_pools = lambda rows: rows.withColumn("pool", F.explode(F.array(F.pmod("user_id", F.lit(POOLS)).cast("string"), F.lit("all"))))
    pools = in_pools(traces).groupBy("pool").agg(F.count("*").alias("n_traces"), F.bitmap_or_agg("bits").alias("bits"))
    met = lambda first, names: [compare.taken(F.col("bits"), F.lit(first + i).cast("long")) for i in range(len(names))]
    hits = lambda flags: sum((f.cast("long") for f in flags), F.lit(0).cast("long"))
    conditions, labels = met(0, CONDITIONS), met(FIRST_LABEL, LABELS)
    never = F.array_compact(F.array(*(F.when(~f, n) for f, n in zip([*conditions, *labels], [*CONDITIONS, *LABELS], strict=True))))
    named = pools.select("pool", "n_traces", hits(conditions).alias("if_hit"), hits(labels).alias("case_hit"), F.array_join(never, ",").alias("never"))
    rose, expired, stopped = (F.col(f"n_{c}") > 0 for c in ("rise", "expire", "stop"))
    timers = in_pools(trace_timer_events(spark, sf_dir)).groupBy("pool").agg(
        F.count_if(~rose).alias("never_rose"), F.count_if(rose & ~expired).alias("rose_never_expired"), F.count_if(expired & ~stopped).alias("expired_never_reset"),
        F.count_if(rose & expired & stopped).alias("all_three"),
    )
    return named.join(timers, "pool").withColumn("if_total", F.lit(len(CONDITIONS))).withColumn("case_total", F.lit(len(LABELS)))


THREE = f"""{S}, {TON}, u AS (SELECT *, row_number() {W} - 1 AS step, CAST(least({PRESET - 1}, et) AS INTEGER) AS et1 FROM q),
    o AS (SELECT user_id, step, run, q, run AND before >= {PRESET} AS late_q, run AND coalesce(lag(et1) OVER (PARTITION BY user_id ORDER BY step), 0) >= {PRESET - 1} AS less_q FROM u)"""
COMPARED = """d AS (SELECT user_id, count(*) AS n_a, count(*) FILTER (step < {n}) AS n_b, 2 * count(*) FILTER (step < {n} AND q <> late_q) AS raw,
        2 * count(*) FILTER (step < {n} AND q <> less_q) AS less, min(step) FILTER (step < {n} AND q <> late_q) AS first_step, bool_or(run) AS timer FROM o GROUP BY 1)""".format(n=STEPS)
IN_POOLS = f"unnest([CAST(user_id % {POOLS} AS VARCHAR), 'all']) AS pool"
ORACLE_SQL = {
    "trace_divergence": f"WITH {THREE}, {COMPARED} SELECT user_id, n_a, n_b, raw AS n_mismatch, first_step FROM d",
    "trace_divergence_pools": f"""WITH {THREE}, {COMPARED}, p AS (SELECT *, {IN_POOLS} FROM d)
        SELECT pool, count(*) AS n, count(*) FILTER (timer) AS timer_traces, count(*) FILTER (NOT timer) AS timerless, count(*) FILTER (raw = 0) AS raw_exact,
               count(*) FILTER (timer AND raw > 0) AS raw_mismatch_timer, count(*) FILTER (NOT timer AND raw > 0) AS raw_mismatch_timerless,
               count(*) FILTER (timer AND less = 0) AS comp_exact, count(*) FILTER (timer AND less > 0) AS comp_mismatch, count(*) FILTER (n_a <> n_b) AS cut_short FROM p GROUP BY 1""",
    "trace_branches": f"""WITH {S}, b AS (SELECT user_id, unnest([CASE WHEN trip THEN 'trip' WHEN level >= {HIGH} THEN 'full' WHEN level <= {LOW} THEN 'empty' WHEN "start" THEN 'start' ELSE 'else' END,
            CASE WHEN trip THEN 'error' WHEN reset THEN 'signup' WHEN "start" THEN 'click' WHEN pulse THEN 'purchase' ELSE 'view' END]) AS name, unnest(['if', 'case']) AS kind FROM s),
        a AS (SELECT 'if' AS kind, unnest([{", ".join(f"'{c}'" for c in CONDITIONS)}]) AS name, unnest(range({len(CONDITIONS)})) AS i
              UNION ALL SELECT 'case', unnest([{", ".join(f"'{c}'" for c in LABELS)}]), unnest(range({FIRST_LABEL}, {FIRST_LABEL + len(LABELS)}))),
        p AS (SELECT pool, kind, name, count(DISTINCT user_id) AS n FROM (SELECT *, {IN_POOLS} FROM b) GROUP BY 1, 2, 3),
        k AS (SELECT pool, count(DISTINCT user_id) AS n_traces FROM (SELECT user_id, {IN_POOLS} FROM s) GROUP BY 1),
        h AS (SELECT k.pool, n_traces, count(p.n) FILTER (a.kind = 'if') AS if_hit, count(p.n) FILTER (a.kind = 'case') AS case_hit, coalesce(string_agg(a.name, ',' ORDER BY a.i) FILTER (p.n IS NULL), '') AS never
              FROM k CROSS JOIN a LEFT JOIN p ON p.pool = k.pool AND p.kind = a.kind AND p.name = a.name GROUP BY 1, 2),
        {TON}, e AS (SELECT *, coalesce(lag(q) {W}, FALSE) AS q0 FROM q),
        m AS (SELECT user_id, bool_or(q AND NOT q0) AS rose, bool_or(et = {PRESET} AND before < {PRESET}) AS expired, bool_or(et = 0 AND before > 0) AS stopped FROM e GROUP BY 1),
        v AS (SELECT pool, count(*) FILTER (NOT rose) AS never_rose, count(*) FILTER (rose AND NOT expired) AS rose_never_expired, count(*) FILTER (expired AND NOT stopped) AS expired_never_reset,
                     count(*) FILTER (rose AND expired AND stopped) AS all_three FROM (SELECT *, {IN_POOLS} FROM m) GROUP BY 1)
        SELECT h.*, never_rose, rose_never_expired, expired_never_reset, all_three, {len(CONDITIONS)} AS if_total, {len(LABELS)} AS case_total FROM h JOIN v USING (pool)""",
}
QUERIES = {k: globals()[k] for k in ORACLE_SQL}
