"""A sink that can be resumed: work is dealt into rounds by key, and each round is published whole, by one rename.

A round's folder holds its rows (``data``) and the keys it was made for (``keys``), so that what readers see and what counts as done can't
differ. Rounds are written beside the published ones, where readers don't look, and what a broken run left there is deleted by the next run.
The file system's rename must be atomic (as on HDFS and local disks). One run at a time may write to a sink.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class ResumableSink:
    """Rows of groups in ``path``, a group for each value of ``key``; types as in ``schema`` (DDL of all rows, the key among them)."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str):
        self.spark, self.path, self.key, self.schema = spark, path, key, schema
        kinds = spark.createDataFrame([], schema).schema
        self.key_schema = f"`{key}` {kinds[key].dataType.simpleString()}"

    def folder(self, name: str = ""):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    @property
    def fs(self):
        return self.folder().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def parts(self, name: str, schema: str) -> DataFrame:
        found = self.fs.globStatus(self.folder(f"rounds/*/{name}"))
        if not found:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f.getPath().toString() for f in found))

    def rows(self) -> DataFrame:
        """What is published: whole rounds only."""
        return self.parts("data", self.schema)

    def done(self) -> DataFrame:
        """Keys of published rounds, also those that had no rows."""
        return self.parts("keys", self.key_schema)

    def publish(self, staged: str, name: str) -> None:
        self.fs.mkdirs(self.folder("rounds"))
        if not self.fs.rename(self.folder(staged), self.folder(f"rounds/{name}")):
            raise OSError(f"can't publish {staged} in {self.path}")

    def write(self, keys: DataFrame, make: Callable[[DataFrame], DataFrame], rounds: int = 8, bucket: Column | None = None, most: int | None = None) -> int:
        """Makes and publishes the rows of all keys that aren't done yet; returns the number of rounds published.

        make gives the rows for a table of keys; it is called once a round, so a round is what a break can cost. bucket deals the keys to rounds
        (by hash, if not given). most ends the run after so many rounds.
        """
        self.fs.delete(self.folder(".staged"), True)
        deal = F.pmod(F.xxhash64(self.key), F.lit(rounds)) if bucket is None else bucket
        todo = keys.select(self.key).distinct().join(self.done().withColumn("traceloom_done", F.lit(1)), self.key, "left_anti")
        open_rounds = sorted(r[0] for r in todo.select(deal.alias("r")).distinct().collect())  # at most one value a round
        for n, r in enumerate(open_rounds if most is None else open_rounds[:most]):
            name = f"{r}-{uuid.uuid4().hex}"
            staged = f"{self.path}/.staged/{name}"
            todo.filter(deal == r).write.parquet(f"{staged}/keys")
            own = self.spark.read.schema(self.key_schema).parquet(f"{staged}/keys")
            make(own).select(*self.spark.createDataFrame([], self.schema).columns).write.parquet(f"{staged}/data")
            self.publish(f".staged/{name}", name)
        return len(open_rounds if most is None else open_rounds[:most])
