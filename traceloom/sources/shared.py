"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder on a local master; an error on a cluster, whose nodes share none."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="traceloom-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: its lineage ends there."""
    return stored_at(df, new_path(df.sparkSession, name))


def stored_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, *paths: str) -> None:
    """Deletes folders wherever they are, with Hadoop's file systems; those that aren't there are passed over."""
    context = spark.sparkContext
    for path in paths:
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file in one piece, wherever the path is: written beside and renamed, so that readers see all of it or nothing."""
    context = spark.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    beside = hadoop.Path(at.getParent(), f".{at.getName()}.{uuid.uuid4().hex}")
    fs = at.getFileSystem(context._jsc.hadoopConfiguration())
    out = fs.create(beside, True)
    try:
        out.write(text.encode())
    finally:
        out.close()
    fs.delete(at, False)
    if not fs.rename(beside, at):
        raise OSError(f"can't rename to {path}")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end all intermediate tables made inside; what was made inside must have been written or collected by then."""
    _scopes.append([])
    try:
        yield
    finally:
        delete(spark, *_scopes.pop())
