"""Queries of set operations, limits and samples: what is first, what is left, who is next."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from traceloom.operators.ranges import running, with_next
from traceloom.sources.records import first_given, not_done
from traceloom.sources.tables import table

PER_GROUP, TOP, STRIDE = 3, 64, 50


def set_first_of_equal(spark, sf_dir):
    """Turns with the same text once: that of the least conversation and turn. Shuffles digests and keys, never texts."""
    rows = table(spark, sf_dir, "conversations").select(F.sha1(F.col("text").cast("binary")).alias("digest"), "conv_id", "turn")
    return rows.groupBy("digest").agg(F.min(F.struct("conv_id", "turn")).alias("m"), F.count("*").alias("n_equal")).select("digest", "m.*", "n_equal")


def set_not_done(spark, sf_dir):
    """Documents without labels: what is still to do."""
    return not_done(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


def set_common_keys(spark, sf_dir):
    """Users who both signed up and had an error."""
    events = table(spark, sf_dir, "events")
    return events.filter("event_type = 'signup'").select("user_id").intersect(events.filter("event_type = 'error'").select("user_id"))


def set_missing_steps(spark, sf_dir):
    """Of each user the kinds of event never seen, and whether all of three are there."""
    want = F.array(*map(F.lit, ("click", "error", "purchase")))
    seen = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("s"))
    missing = F.array_except(want, "s")
    return seen.select("user_id", F.array_join(missing, ",").alias("missing"), (F.size(missing) == 0).alias("complete"))


def set_first_per_group(spark, sf_dir):
    """The first few orders of each customer (a limit for each group)."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("place"))
    return rows.filter(F.col("place") <= PER_GROUP)


def set_top_spread(spark, sf_dir):
    """The suppliers whose discounts vary most."""
    spread = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.stddev_pop("l_discount"), 9).alias("sd"))
    return spread.orderBy(F.desc("sd"), "l_suppkey").limit(TOP)


def set_stride_sample(spark, sf_dir):
    """Every so-manieth part by key order: places floor(i * n / STRIDE). Places are running sums over ranges of keys, not from one sorted task."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    n = parts.count()
    places = F.array(*(F.lit(i * n // STRIDE) for i in range(STRIDE)))
    return running(parts, [F.asc("p_partkey")], place=F.lit(1)).filter(F.array_contains(places, F.col("place").cast("int"))).select("p_partkey", "p_name")


def set_neighbour(spark, sf_dir):
    """Each customer of a nation with the next one by key, the last with the first: no one is their own neighbour where there are two."""
    return with_next(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey"), "c_nationkey", "c_custkey", "neighbour", around=True).select("c_custkey", "neighbour")


def set_tier_order(spark, sf_dir):
    """Orders by priority, in a stated order of the tiers."""
    rank = F.when(F.col("o_orderpriority").startswith("1"), 0).when(F.col("o_orderpriority").startswith("2"), 1).otherwise(2)
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).withColumn("tier_rank", rank).orderBy("tier_rank", "o_orderpriority")


def set_first_given(spark, sf_dir):
    """The first field with text of a document: source, else language, else its id."""
    rows = table(spark, sf_dir, "documents").withColumn("id_text", F.col("doc_id").cast("string"))
    return rows.select("doc_id", first_given("source", "lang", "id_text").alias("given"))


def set_prefix_join(spark, sf_dir):
    """Names of nations to the first region (by key) whose name starts alike: the fallback for ids cut short, for the few unmatched rows."""
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    key = F.substring("n_name", 1, 1)
    found = nations.join(regions.withColumn("k", F.substring("r_name", 1, 1)), key == F.col("k"), "left").groupBy("n_nationkey").agg(F.min(F.struct("r_regionkey", "r_name")).alias("m"))
    return found.select("n_nationkey", F.col("m.r_name").alias("region"))


ORACLE_SQL = {
    "set_first_of_equal": """SELECT sha1(text) AS digest, min(struct_pack(conv_id, turn)).conv_id AS conv_id, min(struct_pack(conv_id, turn)).turn AS turn, count(*) AS n_equal
                             FROM conversations GROUP BY 1""",
    "set_not_done": "SELECT doc_id, lang FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)",
    "set_common_keys": "SELECT user_id FROM events WHERE event_type = 'signup' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'",
    "set_missing_steps": """WITH s AS (SELECT user_id, list(DISTINCT event_type) AS s FROM events GROUP BY 1), m AS (SELECT user_id, list_filter(['click', 'error', 'purchase'], lambda x: NOT list_contains(s, x)) AS m FROM s)
                            SELECT user_id, array_to_string(m, ',') AS missing, len(m) = 0 AS complete FROM m""",
    "set_first_per_group": f"SELECT * FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS place FROM orders) WHERE place <= {PER_GROUP}",
    "set_top_spread": f"SELECT l_suppkey, round(stddev_pop(l_discount), 9) AS sd FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {TOP}",
    "set_stride_sample": f"""WITH r AS (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS n FROM part)
                             SELECT p_partkey, p_name FROM r WHERE i IN (SELECT s * (SELECT count(*) FROM part) // {STRIDE} FROM range({STRIDE}) t(s))""",
    "set_neighbour": """SELECT c_custkey, coalesce(lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey), min(c_custkey) OVER (PARTITION BY c_nationkey)) AS neighbour FROM customer""",
    "set_tier_order": "SELECT o_orderpriority, count(*) AS n, CASE left(o_orderpriority, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 ELSE 2 END AS tier_rank FROM orders GROUP BY 1",
    "set_first_given": "SELECT doc_id, coalesce(nullif(source, ''), nullif(lang, ''), CAST(doc_id AS VARCHAR)) AS given FROM documents",
    "set_prefix_join": "SELECT n_nationkey, arg_min(r_name, r_regionkey) AS region FROM nation LEFT JOIN region ON left(n_name, 1) = left(r_name, 1) GROUP BY 1",
}
QUERIES = {k: globals()[k] for k in ORACLE_SQL}
