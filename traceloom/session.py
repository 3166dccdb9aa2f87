"""Session factory for local runs; on a cluster the session comes from spark-submit."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A UTC session with adaptive execution on; ``conf`` overrides any setting (dots as ``__``)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("traceloom").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
