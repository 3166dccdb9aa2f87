"""Queries over time and in parts: as-of and interval joins, sketches that are rolled up, a sink that is resumed."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceloom.operators import sketches
from traceloom.operators.timejoin import asof_join, overlap_join
from traceloom.sources.resume import ResumableSink
from traceloom.sources.shared import new_path
from traceloom.sources.tables import table

ROUNDS, BROKEN_AFTER, MIDDLE = 8, 3, 0.5


def events_of(spark, sf_dir, kind: str):
    return table(spark, sf_dir, "events").filter(F.col("event_type") == kind)


def join_asof_click(spark, sf_dir):
    """Each purchase with the user's last click before it; clicks of one time by the largest id."""
    left, right = events_of(spark, sf_dir, "purchase").select("event_id", "user_id", "ts", "value"), events_of(spark, sf_dir, "click").select("event_id", "user_id", "ts", "value")
    out = asof_join(left, right, ["user_id"], "ts", "ts", {"event_id": "click_id", "value": "click_value"}, tie=("event_id",), strict=True)
    return out.select("event_id", "user_id", "click_id", "click_value")


def join_asof_within(spark, sf_dir):
    """Each error with the last event of its user that isn't one, if that is at most three days older."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    left, right = rows.filter("event_type = 'error'").drop("event_type"), rows.filter("event_type <> 'error'")
    out = asof_join(left, right, ["user_id"], "ts", "ts", {"event_id": "before_id", "event_type": "before_type"}, tie=("event_id",), within="interval 3 days")
    return out.select("event_id", "before_id", "before_type")


def open_lines(spark, sf_dir):
    """Order lines as spans of days from order to shipment."""
    days = lambda c: F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date"))
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), days("l_shipdate").alias("until"))
    return lines.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), days("o_orderdate").alias("since")), "l_orderkey").drop("l_orderkey")


def join_overlap(spark, sf_dir):
    """Of each supplier the pairs of lines that were open on a common day, the days they share, and the most days a pair shares."""
    one = open_lines(spark, sf_dir)
    other = one.select("l_suppkey", F.col("line").alias("line_b"), F.col("since").alias("since_b"), F.col("until").alias("until_b"))
    pairs = overlap_join(one, other, ["l_suppkey"], ("since", "until"), ("since_b", "until_b")).filter("line < line_b")
    shared = F.least("until", "until_b") - F.greatest("since", "since_b") + 1
    return pairs.groupBy("l_suppkey").agg(F.count("*").alias("n_pairs"), F.sum(shared).alias("shared_days"), F.max(shared).cast("long").alias("most_days"))


def sketch_roll_up(spark, sf_dir):
    """Users and the middle value of each kind of event and of all, exactly, and whether what the sketches of days say of them is within their bounds.

    Days are sketched once; kinds and the whole are merged from them. An estimate of distinct users may be off by a share of them, a
    quantile by a share of the rows in rank.
    """
    events = table(spark, sf_dir, "events").select("user_id", "event_type", F.to_date("ts").alias("day"), "value")
    days = sketches.sketched(events, ["event_type", "day"], F.col("user_id"), F.col("value"))
    kinds = sketches.merged(days, ["event_type"])
    total = sketches.merged(kinds.withColumn("event_type", F.lit("all")), ["event_type"])
    said = kinds.unionByName(total).select("event_type", "n", sketches.n_distinct(F.col("distinct_sketch")).alias("said_users"), sketches.quantile(F.col("value_sketch"), MIDDLE).alias("said_middle"))
    both = events.select(F.explode(F.array("event_type", F.lit("all"))).alias("event_type"), "user_id", "value")
    exact = both.groupBy("event_type").agg(F.count_distinct("user_id").alias("n_users"))
    ranked = both.join(F.broadcast(said.select("event_type", "said_middle")), "event_type")  # a row for each kind of event
    rank = ranked.groupBy("event_type").agg(F.avg((F.col("value") < F.col("said_middle")).cast("double")).alias("low"), F.avg((F.col("value") <= F.col("said_middle")).cast("double")).alias("high"))
    out = said.join(exact, "event_type").join(rank, "event_type")
    near = (F.col("low") <= MIDDLE + sketches.rank_bound()) & (F.col("high") >= MIDDLE - sketches.rank_bound())
    users = F.abs(F.col("said_users") - F.col("n_users")) <= F.greatest(F.lit(1.0), sketches.distinct_bound() * F.col("n_users"))
    return out.select("event_type", "n", "n_users", users.alias("users_within"), near.alias("middle_within"))


class Broken(Exception):
    pass


def sink_resumed(spark, sf_dir):
    """Sums of each supplier from a sink whose first run broke in the middle of a round; ``run`` tells which run made them.

    Suppliers are dealt to rounds by key. Each round reads the lines again, for its suppliers only.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity")
    sink = ResumableSink(spark, new_path(spark, "resumed"), "l_suppkey", "l_suppkey long, n long, quantity double, run int")
    rounds_left = iter(range(BROKEN_AFTER))

    def make(run: int):
        def rows(keys):
            if run == 1 and next(rounds_left, None) is None:
                raise Broken
            sums = lines.join(keys, "l_suppkey", "left_semi").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
            return sums.withColumn("run", F.lit(run))

        return rows

    bucket = F.pmod("l_suppkey", F.lit(ROUNDS))
    try:
        sink.write(lines.select("l_suppkey"), make(1), ROUNDS, bucket)
    except Broken:
        pass
    sink.write(lines.select("l_suppkey"), make(2), ROUNDS, bucket)
    return sink.rows()


ORACLE_SQL = {
    "join_asof_click": """WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
        c AS (SELECT user_id, ts, max(event_id) AS click_id, max_by(value, event_id) AS click_value FROM events WHERE event_type = 'click' GROUP BY 1, 2)
        SELECT event_id, p.user_id, click_id, click_value FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts > c.ts""",
    "join_asof_within": """WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'),
        c AS (SELECT user_id, ts, max(event_id) AS before_id, max_by(event_type, event_id) AS before_type FROM events WHERE event_type <> 'error' GROUP BY 1, 2),
        j AS (SELECT event_id, before_id, before_type, p.ts <= c.ts + INTERVAL 3 DAY AS near FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.ts)
        SELECT event_id, CASE WHEN near THEN before_id END AS before_id, CASE WHEN near THEN before_type END AS before_type FROM j""",
    "join_overlap": """WITH s AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS line, CAST(o_orderdate AS DATE) AS since, CAST(l_shipdate AS DATE) AS until
                  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
        p AS (SELECT a.l_suppkey, least(a.until, b.until) - greatest(a.since, b.since) + 1 AS shared FROM s a JOIN s b
              ON a.l_suppkey = b.l_suppkey AND a.line < b.line AND a.since <= b.until AND b.since <= a.until AND a.since <= a.until AND b.since <= b.until)
        SELECT l_suppkey, count(*) AS n_pairs, CAST(sum(shared) AS BIGINT) AS shared_days, max(shared) AS most_days FROM p GROUP BY 1""",
    "sketch_roll_up": """SELECT coalesce(event_type, 'all') AS event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, TRUE AS users_within, TRUE AS middle_within
        FROM events GROUP BY ROLLUP (event_type)""",
    "sink_resumed": f"""SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 2) AS quantity, CAST(CASE WHEN l_suppkey % {ROUNDS} < {BROKEN_AFTER} THEN 1 ELSE 2 END AS INTEGER) AS run
        FROM lineitem GROUP BY 1""",
}
QUERIES = {k: globals()[k] for k in ORACLE_SQL}
