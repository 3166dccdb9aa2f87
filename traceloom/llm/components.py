"""Connected components over an edge table, by alternating large and small stars.

Cases: edges from a node to itself are ignored, and so are repeated ones; a null end is no node; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from traceloom.llm.common import delete, new_path, spread_join, stored_at

def large_star(edges: DataFrame) -> DataFrame:
    """Edges (a > b). Each node's larger neighbours go to the least of the node and its neighbours.

    The node looked up is b, and only if it has a smaller neighbour; a hub that is its neighbourhood's least node has none.
    """
    moved = edges.select(F.col("a").alias("b"), F.col("b").alias("m")).groupBy("b").agg(F.min("m").alias("m"))
    return spread_join(edges, moved, "b", "a", "left").select("a", F.coalesce("m", "b").alias("b"))


def small_star(edges: DataFrame) -> DataFrame:
    """Edges (a > b). Each node and its smaller neighbours go to the least of them; only nodes with several are looked up."""
    several = edges.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("most")).filter("m < most")
    found = spread_join(edges, several.select("a", "m"), "a", "b", "left")
    pairs = F.array(F.struct("a", F.coalesce("m", "b").alias("b")), F.struct(F.col("b").alias("a"), F.coalesce("m", "b").alias("b")))
    return found.select(F.explode(pairs).alias("e")).select("e.*").filter("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for all nodes of edges (a, b), which may be listed in either direction; label is the component's least node.

    Each round's edges go to a table in the shared folder, which is deleted after the next one. It ends when a round changes nothing,
    which takes about log2 of the longest path; edges per round don't outgrow those at the start.
    """
    spark, mark, before = edges.sparkSession, None, None
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    while True:
        seen, path = Observation(), new_path(spark, "edges")
        if before:
            now = small_star(large_star(now))
        measured = now.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
        now = stored_at(measured, path)
        if before:
            delete(spark, before)
        before, new = path, (seen.get["n"], seen.get["h"])
        if new == mark or not new[0]:
            break
        mark = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select("b", "b").distinct().toDF("node", "label"))
