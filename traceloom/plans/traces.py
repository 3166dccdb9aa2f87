"""Queries over event traces: latches, timers, counters and obligations, one trace for each user."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceloom.functions import trace as T
from traceloom.sources.tables import table

KEY = T.Order("user_id", ("ts", "event_id"))
COUNTER_CAP, PRESET, LOW, HIGH = 3, 2, 20, 80


def scans(spark, sf_dir):
    """The events as scans with input signals."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "user_id", "ts", "event_id",
        (kind == "error").alias("trip"), (kind == "signup").alias("reset"), (kind == "click").alias("start"), (kind == "purchase").alias("pulse"),
        F.least(F.lit(100), F.floor("value")).cast("int").alias("level"),
    )


def trace_alarm_latch(spark, sf_dir):
    """Scans with the alarm on, and violations of G(trip -> alarm)."""
    alarm = scans(spark, sf_dir).withColumn("alarm", T.latch(F.col("trip"), F.col("reset"), KEY))
    return alarm.groupBy("user_id").agg(F.count("*").alias("n_scans"), F.count_if("alarm").alias("n_alarm"), F.count_if(F.col("trip") & ~F.col("alarm")).alias("n_violations"))


def trace_latch_dominance(spark, sf_dir):
    """Where set-dominant and reset-dominant latches differ, when both inputs can be on at once."""
    both = scans(spark, sf_dir).withColumns({"on": F.col("trip") | F.col("start"), "off": F.col("reset") | F.col("start")})
    out = both.withColumns({"set_first": T.latch(F.col("on"), F.col("off"), KEY), "reset_first": T.latch(F.col("on"), F.col("off"), KEY, reset_dominant=True)})
    return out.groupBy("user_id").agg(F.count_if("set_first").alias("n_set"), F.count_if("reset_first").alias("n_reset"), F.count_if(F.col("set_first") != F.col("reset_first")).alias("n_differ"))


def trace_hysteresis(spark, sf_dir):
    out = scans(spark, sf_dir).withColumn("fill", T.latch(F.col("level") <= LOW, F.col("level") >= HIGH, KEY, reset_dominant=True))
    return out.select("event_id", "level", "fill")


def trace_on_delay(spark, sf_dir):
    return T.with_on_delay(scans(spark, sf_dir).withColumn("run", ~F.col("trip")), "run", PRESET, KEY).select("event_id", "et", "q")


def trace_on_delay_delayed(spark, sf_dir):
    return T.with_on_delay(scans(spark, sf_dir).withColumn("run", ~F.col("trip")), "run", PRESET, KEY, delayed=True).select("event_id", "et", "q")


def trace_timer_events(spark, sf_dir):
    """Scans at which the timer's output rises, its time expires anew, or a running time is reset."""
    timed = T.with_on_delay(scans(spark, sf_dir).withColumn("run", ~F.col("trip")), "run", PRESET, KEY)
    w, et = KEY.window, F.col("et")
    before = F.lag("et", 1, 0).over(w)
    marked = timed.withColumns({"rise": T.rising(F.col("q"), KEY), "expire": (et == PRESET) & (before < PRESET), "stop": (et == 0) & (before > 0)})
    return marked.groupBy("user_id").agg(*(F.count_if(c).alias(f"n_{c}") for c in ("rise", "expire", "stop")))


def trace_rising_edges(spark, sf_dir):
    return scans(spark, sf_dir).withColumn("edge", T.rising(F.col("pulse"), KEY)).groupBy("user_id").agg(F.count_if("edge").alias("n_edges"))


def trace_edge_counter(spark, sf_dir):
    out = T.with_edge_counter(scans(spark, sf_dir), F.col("pulse"), F.col("reset"), COUNTER_CAP, KEY)
    return out.select("event_id", F.col("count").alias("n"), (F.col("count") >= COUNTER_CAP).alias("full"))


def trace_up_down_counter(spark, sf_dir):
    """A counter clamped on both sides; per trace its last and largest count."""
    out = T.with_up_down_counter(scans(spark, sf_dir).select("user_id", "ts", "event_id", "pulse", "start"), F.col("pulse"), F.col("start"), 4, KEY, "n")
    return out.groupBy("user_id").agg(F.max_by("n", F.struct("ts", "event_id")).alias("n_last"), F.max("n").alias("n_max"), F.count("*").alias("n_scans"))


def trace_persisted_input(spark, sf_dir):
    """The level of purchases only, kept in between."""
    return scans(spark, sf_dir).select("event_id", T.persisted(F.when(F.col("pulse"), F.col("level")), KEY, 0).alias("held"))


def trace_next_obligation(spark, sf_dir):
    """Violations of G(alarm -> X(alarm | reset)), vacuous at the last scan."""
    out = scans(spark, sf_dir).withColumn("alarm", T.latch(F.col("trip"), F.col("reset"), KEY))
    then = F.coalesce(T.next_scan(F.col("alarm") | F.col("reset"), KEY), F.lit(True))
    return out.withColumn("bad", F.col("alarm") & ~then).groupBy("user_id").agg(F.count_if("bad").alias("n_violations"))


def trace_first_mismatch(spark, sf_dir):
    """Of each trace, the first scan where the alarm isn't what a memoryless controller would give; null if none."""
    out = scans(spark, sf_dir).withColumns({"alarm": T.latch(F.col("trip"), F.col("reset"), KEY), "step": F.row_number().over(KEY.window)})
    return out.groupBy("user_id").agg(F.min(F.when(F.col("alarm") != F.col("trip"), F.col("step"))).alias("first_step"))


def trace_activity(spark, sf_dir):
    """Activation frequency, and whether the output is the same as always off, always on or any constant."""
    out = scans(spark, sf_dir).withColumn("alarm", T.latch(F.col("trip"), F.col("reset"), KEY)).groupBy("user_id")
    return out.agg(F.avg(F.col("alarm").cast("int")).alias("active"), F.bool_and(~F.col("alarm")).alias("all_off"), F.bool_and("alarm").alias("all_on"), (F.count_distinct("alarm") <= 1).alias("constant"))


def trace_level_span(spark, sf_dir):
    w = KEY.running
    return scans(spark, sf_dir).select("event_id", F.min("level").over(w).alias("low"), F.max("level").over(w).alias("high"))


def trace_contiguous_groups(spark, sf_dir):
    """Groups of 8 scans by position: mean of the groups' population deviations, and groups without variance."""
    place = F.floor((F.row_number().over(KEY.window) - 1) / 8)
    groups = scans(spark, sf_dir).withColumn("g", place).groupBy("user_id", "g").agg(F.stddev_pop("level").alias("sd"), F.count("*").alias("n")).filter("n >= 2")
    return groups.groupBy("user_id").agg(F.round(F.avg("sd"), 6).alias("mean_sd"), F.count_if(F.col("sd") == 0).alias("n_flat"))


def trace_coverage(spark, sf_dir):
    """How many traces show each event of the timer, and how many all three."""
    per = trace_timer_events(spark, sf_dir)
    seen = F.array_compact(F.array(*(F.when(F.col(f"n_{c}") > 0, c) for c in ("rise", "expire", "stop"))))
    rows = per.withColumn("seen", seen)
    every = F.size(F.array_except(F.array(F.lit("rise"), F.lit("expire"), F.lit("stop")), "seen")) == 0
    return rows.agg(F.count("*").alias("traces"), *(F.count_if(F.array_contains("seen", c)).alias(c) for c in ("rise", "expire", "stop")), F.count_if(every).alias("complete"))


#: Scans of a generated trace, and chances in hundredths that a boolean or a number changes at a scan.
N_SCANS, FLIP, REDRAW = 40, 35, 40


def draw(below: int, *parts):
    """A whole number from 0 to below, fixed by the parts."""
    word = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.pmod(F.conv(F.substring(word, 1, 15), 16, 10).cast("long"), F.lit(below)).cast("int")


def trace_generated(spark, sf_dir):
    """Seven test traces for each supplier as a seed, of a boolean a and a number n from 0 to 5: three random walks, all held, toggled at each scan,
    and high then low and the other way round."""
    k, t, key = F.col("scan"), F.col("trace"), F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("trace")).select("*", F.explode(F.sequence(F.lit(0), F.lit(N_SCANS - 1))).alias("scan"))
    flip = (draw(100, F.lit("f"), key, t, k) < FLIP).cast("int")
    fresh = F.when((k == 0) | (draw(100, F.lit("r"), key, t, k) < REDRAW), draw(6, F.lit("n"), key, t, k))
    order = T.Order("__t", ("scan",))
    walks = rows.filter("trace < 3").withColumn("__t", F.concat_ws(":", "s_suppkey", "trace"))
    walks = walks.select("s_suppkey", "trace", "scan", ((draw(2, F.lit("b"), key, t) + F.sum(flip).over(order.running)) % 2 == 1).alias("a"), T.persisted(fresh, order, 0).alias("n"))
    high = F.when(t == 3, True).when(t == 4, k % 2 == 0).when(t == 5, k < N_SCANS // 2).otherwise(k >= N_SCANS // 2)
    fixed = rows.filter("trace >= 3").select("s_suppkey", "trace", "scan", high.alias("a"), F.when(t == 4, k % 6).otherwise(F.when(high, 5).otherwise(0)).alias("n"))
    return walks.unionByName(fixed)


def trace_timer_table(spark, sf_dir):
    """Each user's timers with presets 1 to 3 side by side: scans at which the time stands at the preset, with the output on, and with the late output on."""
    rows, out = scans(spark, sf_dir).select("user_id", "ts", "event_id", (~F.col("trip")).alias("run")), None
    for pt in (1, 2, 3):
        timed = T.with_on_delay(T.with_on_delay(rows, "run", pt, KEY), "run", pt, KEY, prefix="late_", delayed=True)
        part = timed.groupBy("user_id").agg(F.sum("et").alias("total"), F.count_if(F.col("et") == pt).alias("full"), F.count_if("q").alias("on"), F.count_if("late_q").alias("late"))
        part = part.withColumn("pt", F.lit(pt))
        out = part if out is None else out.unionByName(part)
    return out


S = """s AS (SELECT user_id, ts, event_id, event_type = 'error' AS trip, event_type = 'signup' AS reset, event_type = 'click' AS "start",
           event_type = 'purchase' AS pulse, CAST(least(100, floor(value)) AS INTEGER) AS level FROM events)"""
W = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"
ALARM = f"a AS (SELECT *, coalesce(last_value(CASE WHEN trip THEN TRUE WHEN reset THEN FALSE END IGNORE NULLS) {W}, FALSE) AS alarm FROM s)"
TON = f"""r AS (SELECT *, NOT trip AS run, sum(CASE WHEN trip THEN 1 ELSE 0 END) {W} AS g FROM s),
    t AS (SELECT *, CAST(least({PRESET}, sum(CASE WHEN run THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id)) AS INTEGER) AS et FROM r),
    q AS (SELECT *, run AND et >= {PRESET} AS q, coalesce(lag(et) {W}, 0) AS before FROM t)"""

HASH = "CAST('0x' || md5({p})[1:15] AS BIGINT)"
ORACLE_SQL = {
    "trace_alarm_latch": f"WITH {S}, {ALARM} SELECT user_id, count(*) AS n_scans, count(*) FILTER (alarm) AS n_alarm, count(*) FILTER (trip AND NOT alarm) AS n_violations FROM a GROUP BY 1",
    "trace_latch_dominance": f"""WITH {S}, b AS (SELECT *, trip OR "start" AS on_, reset OR "start" AS off_ FROM s),
        l AS (SELECT *, coalesce(last_value(CASE WHEN on_ THEN 1 WHEN off_ THEN 0 END IGNORE NULLS) {W}, 0) AS x,
                        coalesce(last_value(CASE WHEN off_ THEN 0 WHEN on_ THEN 1 END IGNORE NULLS) {W}, 0) AS y FROM b)
        SELECT user_id, count(*) FILTER (x = 1) AS n_set, count(*) FILTER (y = 1) AS n_reset, count(*) FILTER (x <> y) AS n_differ FROM l GROUP BY 1""",
    "trace_hysteresis": f"WITH {S} SELECT event_id, level, coalesce(last_value(CASE WHEN level >= {HIGH} THEN FALSE WHEN level <= {LOW} THEN TRUE END IGNORE NULLS) {W}, FALSE) AS fill FROM s",
    "trace_on_delay": f"WITH {S}, {TON} SELECT event_id, et, q FROM q",
    "trace_on_delay_delayed": f"WITH {S}, {TON} SELECT event_id, et, run AND before >= {PRESET} AS q FROM q",
    "trace_timer_events": f"""WITH {S}, {TON}, e AS (SELECT *, coalesce(lag(q) {W}, FALSE) AS q0 FROM q)
        SELECT user_id, count(*) FILTER (q AND NOT q0) AS n_rise, count(*) FILTER (et = {PRESET} AND before < {PRESET}) AS n_expire, count(*) FILTER (et = 0 AND before > 0) AS n_stop FROM e GROUP BY 1""",
    "trace_rising_edges": f"WITH {S}, e AS (SELECT *, pulse AND NOT coalesce(lag(pulse) {W}, FALSE) AS edge FROM s) SELECT user_id, count(*) FILTER (edge) AS n_edges FROM e GROUP BY 1",
    "trace_edge_counter": f"""WITH {S}, e AS (SELECT *, pulse AND NOT coalesce(lag(pulse) {W}, FALSE) AND NOT reset AS edge, sum(CASE WHEN reset THEN 1 ELSE 0 END) {W} AS g FROM s),
        c AS (SELECT event_id, CAST(least({COUNTER_CAP}, sum(CASE WHEN edge THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id)) AS INTEGER) AS n FROM e)
        SELECT event_id, n, n >= {COUNTER_CAP} AS "full" FROM c""",
    "trace_generated": f"""WITH r AS (SELECT s_suppkey, CAST(t AS INTEGER) AS trace, CAST(k AS INTEGER) AS scan FROM supplier, range(7) a(t), range({N_SCANS}) b(k)),
        w AS (SELECT *, {HASH.format(p="'f:' || s_suppkey || ':' || trace || ':' || scan")} % 100 < {FLIP} AS flip, {HASH.format(p="'b:' || s_suppkey || ':' || trace")} % 2 AS b,
              CASE WHEN scan = 0 OR {HASH.format(p="'r:' || s_suppkey || ':' || trace || ':' || scan")} % 100 < {REDRAW} THEN {HASH.format(p="'n:' || s_suppkey || ':' || trace || ':' || scan")} % 6 END AS fresh FROM r WHERE trace < 3)
        SELECT s_suppkey, trace, scan, (b + count(*) FILTER (flip) OVER o) % 2 = 1 AS a, CAST(last_value(fresh IGNORE NULLS) OVER o AS INTEGER) AS n FROM w WINDOW o AS (PARTITION BY s_suppkey, trace ORDER BY scan ROWS UNBOUNDED PRECEDING)
        UNION ALL SELECT s_suppkey, trace, scan, CASE trace WHEN 3 THEN true WHEN 4 THEN scan % 2 = 0 WHEN 5 THEN scan < {N_SCANS // 2} ELSE scan >= {N_SCANS // 2} END,
            CASE WHEN trace = 4 THEN scan % 6 WHEN trace = 3 OR (trace = 5) = (scan < {N_SCANS // 2}) THEN 5 ELSE 0 END FROM r WHERE trace >= 3""",
    "trace_up_down_counter": f"""WITH RECURSIVE {S}, o AS (SELECT user_id, row_number() {W} AS i, pulse, "start" FROM s),
        c AS (SELECT user_id, CAST(0 AS BIGINT) AS i, 0 AS n FROM o GROUP BY 1
              UNION ALL SELECT o.user_id, o.i, greatest(0, least(4, c.n + CAST(pulse AS INTEGER) - CAST("start" AS INTEGER))) FROM c JOIN o ON o.user_id = c.user_id AND o.i = c.i + 1)
        SELECT user_id, max_by(n, i) AS n_last, max(n) AS n_max, count(*) AS n_scans FROM c WHERE i > 0 GROUP BY 1""",
    "trace_persisted_input": f"WITH {S} SELECT event_id, coalesce(last_value(CASE WHEN pulse THEN level END IGNORE NULLS) {W}, 0) AS held FROM s",
    "trace_next_obligation": f"""WITH {S}, {ALARM}, x AS (SELECT *, coalesce(lead(alarm OR reset) {W}, TRUE) AS nxt FROM a)
        SELECT user_id, count(*) FILTER (alarm AND NOT nxt) AS n_violations FROM x GROUP BY 1""",
    "trace_first_mismatch": f"WITH {S}, {ALARM}, n AS (SELECT *, row_number() {W} AS step FROM a) SELECT user_id, CAST(min(CASE WHEN alarm <> trip THEN step END) AS INTEGER) AS first_step FROM n GROUP BY 1",
    "trace_activity": f"WITH {S}, {ALARM} SELECT user_id, avg(CAST(alarm AS INTEGER)) AS active, bool_and(NOT alarm) AS all_off, bool_and(alarm) AS all_on, count(DISTINCT alarm) <= 1 AS constant FROM a GROUP BY 1",
    "trace_level_span": f"WITH {S} SELECT event_id, min(level) {W} AS low, max(level) {W} AS high FROM s",
    "trace_contiguous_groups": f"""WITH {S}, p AS (SELECT user_id, level, (row_number() {W} - 1) // 8 AS g FROM s),
        d AS (SELECT user_id, g, stddev_pop(level) AS sd, count(*) AS n FROM p GROUP BY 1, 2 HAVING count(*) >= 2)
        SELECT user_id, round(avg(sd), 6) AS mean_sd, count(*) FILTER (sd = 0) AS n_flat FROM d GROUP BY 1""",
    "trace_timer_table": f"""WITH {S}, r AS (SELECT *, NOT trip AS run, sum(CASE WHEN trip THEN 1 ELSE 0 END) {W} AS g FROM s),
        k AS (SELECT *, sum(CASE WHEN run THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS held FROM r),
        p AS (SELECT *, unnest([1, 2, 3]) AS pt, coalesce(lag(held) {W}, 0) AS before FROM k)
        SELECT user_id, CAST(pt AS INTEGER) AS pt, CAST(sum(least(pt, held)) AS BIGINT) AS total, count(*) FILTER (least(pt, held) = pt) AS full, count(*) FILTER (run AND held >= pt) AS "on",
               count(*) FILTER (run AND before >= pt) AS late FROM p GROUP BY 1, 2""",
}
ORACLE_SQL["trace_coverage"] = f"""SELECT count(*) AS traces, count(*) FILTER (n_rise > 0) AS rise, count(*) FILTER (n_expire > 0) AS expire, count(*) FILTER (n_stop > 0) AS stop,
    count(*) FILTER (n_rise > 0 AND n_expire > 0 AND n_stop > 0) AS complete FROM ({ORACLE_SQL["trace_timer_events"]})"""
QUERIES = {k: globals()[k] for k in ORACLE_SQL}
