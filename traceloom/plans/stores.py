"""Queries through files: tables are written in the formats of result panels, seed runs and subsets, and read again by the library's readers."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from traceloom.sources import records
from traceloom.sources.shared import new_path, write_text
from traceloom.sources.tables import table

PANEL = "model long, condition string, rows array<struct<task_id:int,samples:array<struct<order:long,ok:boolean,quantity:double>>>>"


def source_panels(spark, sf_dir):
    """Samples of result panels: a JSON document for each supplier, with its line numbers as tasks and its lines as their samples; suppliers without lines have no rows
    in theirs, and are skipped. Counts by task and condition of what is read."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_linenumber").alias("task_id"), F.struct(F.col("l_orderkey").alias("order"), (F.col("l_returnflag") != "R").alias("ok"), F.col("l_quantity").alias("quantity")).alias("s"))
    tasks = lines.groupBy("l_suppkey", "task_id").agg(F.collect_list("s").alias("samples"))
    panels = tasks.groupBy("l_suppkey").agg(F.collect_list(F.struct("task_id", "samples")).alias("rows"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("model"), F.when(F.col("s_acctbal") > 0, "full").otherwise("short").alias("condition"))
    path = new_path(spark, "panels")
    suppliers.join(panels, F.col("model") == F.col("l_suppkey"), "left").select("model", "condition", "rows").write.option("maxRecordsPerFile", 1).json(path)
    read = records.panel_samples(spark, path, PANEL)
    return read.groupBy("task_id", "condition").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"), F.max("i").cast("long").alias("last_i"), F.round(F.sum("quantity"), 2).alias("quantity"), F.count_distinct("model").alias("models"))


def source_seed_runs(spark, sf_dir):
    """Runs of stages (return flags) under seeds (line numbers), a file for each, with files of other names beside them; read, counted by stage, and compared with the list of stages."""
    runs = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("won"))
    path = new_path(spark, "runs")
    for r in runs.toLocalIterator():  # a row for each flag and line number
        write_text(spark, f"{path}/stage{r.l_returnflag}_s{r.l_linenumber}.json", json.dumps({"n": r.n, "won": r.won}, indent=1))
    write_text(spark, f"{path}/notes.json", '{"n": 1}')
    read = records.seed_runs(spark, path, "n long, won long").groupBy("stage").agg(F.count("*").alias("runs"), F.sum("n").alias("n"), F.sum("won").alias("won"), F.min("seed").alias("first"), F.max("seed").alias("last"))
    return read.join(records.stages(spark, path), "stage")


def sink_subsets(spark, sf_dir):
    """Customers in a folder for each segment; a second write replaces one of these folders and leaves the others. Rows and balances of what is there in the end."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    path = new_path(spark, "subsets")
    records.write_subsets(rows, path, F.col("c_mktsegment"), "parquet")
    records.write_subsets(rows.filter("c_mktsegment = 'BUILDING' and c_acctbal > 0"), path, F.col("c_mktsegment"), "parquet")
    read = spark.read.schema("c_custkey long, c_acctbal double, subset string").parquet(path)
    return read.groupBy("subset").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"), F.min("c_custkey").alias("first"))


def sink_report(spark, sf_dir):
    """A report of lines (summary, tiers and rows) written as JSON folders and read again: the three parts agree with each other."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_shipdate").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") != "R").alias("c")).select("l_suppkey", F.year("l_shipdate").cast("string").alias("tier"), "n", "c")
    path = new_path(spark, "report")
    totals = lambda by: rows.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    records.write_report(totals([]), totals(["tier"]), rows, path)
    kind = "tier string, n long, c long"
    part = lambda name: records.json_lines(spark, f"{path}/{name}", kind).groupBy(F.lit(name).alias("part")).agg(F.count("*").alias("records"), F.sum("n").alias("n"), F.sum("c").alias("c"))
    return part("summary").unionByName(part("by_tier")).unionByName(part("rows"))


ORACLE_SQL = {
    "source_panels": """WITH l AS (SELECT l_linenumber AS task_id, CASE WHEN s_acctbal > 0 THEN 'full' ELSE 'short' END AS condition, l_suppkey, l_returnflag <> 'R' AS ok, l_quantity,
                  row_number() OVER (PARTITION BY l_suppkey, l_linenumber) - 1 AS i FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
        SELECT task_id, condition, count(*) AS n, count(*) FILTER (ok) AS n_ok, max(i) AS last_i, round(sum(l_quantity), 2) AS quantity, count(DISTINCT l_suppkey) AS models FROM l GROUP BY 1, 2""",
    "source_seed_runs": """SELECT 'stage' || l_returnflag AS stage, count(DISTINCT l_linenumber) AS runs, count(*) AS n, count(*) FILTER (l_discount > CAST(0.05 AS DOUBLE)) AS won, min(l_linenumber) AS first,
        max(l_linenumber) AS last, count(DISTINCT l_linenumber) AS seeds FROM lineitem GROUP BY 1""",
    "sink_subsets": """SELECT c_mktsegment AS subset, count(*) AS n, round(sum(c_acctbal), 2) AS balance, min(c_custkey) AS first FROM customer
        WHERE c_mktsegment <> 'BUILDING' OR c_acctbal > 0 GROUP BY 1""",
    "sink_report": """WITH r AS (SELECT l_suppkey, l_shipdate, year(l_shipdate) AS tier, count(*) AS n, count(*) FILTER (l_returnflag <> 'R') AS c FROM lineitem GROUP BY 1, 2, 3)
        SELECT 'summary' AS part, CAST(1 AS BIGINT) AS records, CAST(sum(n) AS BIGINT) AS n, CAST(sum(c) AS BIGINT) AS c FROM r
        UNION ALL SELECT 'by_tier', count(DISTINCT tier), CAST(sum(n) AS BIGINT), CAST(sum(c) AS BIGINT) FROM r UNION ALL SELECT 'rows', count(*), CAST(sum(n) AS BIGINT), CAST(sum(c) AS BIGINT) FROM r""",
}
QUERIES = {k: globals()[k] for k in ORACLE_SQL}
