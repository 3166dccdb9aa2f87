"""Metrics of each step: of a stream's batches by a listener, of the groups in a batch by the batch's own rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from traceloom.sources.shared import write_text


def group_stats(rows: DataFrame, reward: str = "reward", group: str = "grp") -> DataFrame:
    """Per group its size, the population deviation of its rewards and how many differ from their mean (have an advantage that isn't zero).

    Groups of one row have no deviation. Means are compared as rounded to 12 digits, as sums of doubles have no fixed order.
    """
    size, mean = Window.partitionBy(group), F.avg(reward).over(Window.partitionBy(group))
    marked = rows.select(group, F.col(reward).cast("double").alias("r"), mean.alias("m"), F.count("*").over(size).alias("n"))
    return marked.groupBy(group).agg(
        F.count("*").alias("n"), F.sum("r").alias("total"), F.when(F.count("*") > 1, F.round(F.stddev_pop("r"), 12)).alias("sd"),
        F.count_if((F.round("r", 12) != F.round("m", 12)) & (F.col("n") > 1)).alias("n_nonzero"),
    )


def step_row(stats: DataFrame, *keys: str) -> DataFrame:
    """One row a step (or for each of keys) of group stats: rows, mean reward, mean deviation, groups without any, share of nonzero advantages."""
    groups, rows = F.greatest(F.count("sd"), F.lit(1)), F.sum("n")
    return stats.groupBy(*keys).agg(
        rows.alias("n"), F.round(F.sum("total") / rows, 4).alias("reward_mean"), F.round(F.coalesce(F.sum("sd"), F.lit(0.0)) / groups, 4).alias("group_reward_std_mean"),
        F.round(F.count_if(F.col("sd") == 0) / groups, 4).alias("zero_variance_group_frac"), F.round(F.sum("n_nonzero") / rows, 4).alias("nonzero_advantage_frac"),
    )


def to_step_sink(path: str, key: str = "grp", reward: str = "reward"):
    """For ``foreachBatch``: writes each batch's diagnostics as one row under its number, so that a batch that is run again replaces its row."""

    def write(batch: DataFrame, step: int) -> None:
        step_row(group_stats(batch, reward, key)).withColumn("step", F.lit(step).cast("long")).write.mode("overwrite").json(f"{path}/batch={step}")

    return write


class StepMetrics(StreamingQueryListener):
    """Writes a JSON file for each batch of the queries it hears of: rows in, late rows, rows and groups of state, and all named observations.

    observe: names of observations (``DataFrame.observe`` with a name) to keep; None keeps all. Files are named by query and batch and written whole,
    so a batch that is told of twice has one file.
    """

    def __init__(self, spark: SparkSession, path: str, observe: tuple[str, ...] | None = None):
        self.spark, self.path, self.observe, self.failed = spark, path, observe, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = {
            "query": p.name or str(p.id), "batch": p.batchId, "rows_in": p.numInputRows, "late_rows": sum(op.numRowsDroppedByWatermark for op in p.stateOperators),
            "state_rows": sum(op.numRowsTotal for op in p.stateOperators), "watermark": (p.eventTime or {}).get("watermark"),
        }
        for name, values in (p.observedMetrics or {}).items():
            if self.observe is None or name in self.observe:
                row |= {f"{name}_{k}": v for k, v in values.asDict().items()}
        try:
            write_text(self.spark, f"{self.path}/{row['query']}-{p.batchId:09d}.json", json.dumps(row, default=str) + "\n")
        except Exception as e:  # a listener must not stop a stream
            self.failed.append(e)


def observed(rows: DataFrame, name: str, **measures: Column) -> DataFrame:
    return rows.observe(name, *(c.alias(k) for k, c in measures.items()))
