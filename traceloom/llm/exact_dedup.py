"""Exact deduplication as a stateful stream, by DataFrame functions alone.

Fingerprints of the arriving rows go through a streaming aggregation whose RocksDB state has one entry for each digest, never
expires and holds the row that stays (its identifier, and the file and row where its bytes are) and the number of rows. Each
digest that was hit is then checked on full bytes: the texts are fetched by locator and compared. Digests that hide more than
one text are grouped by the text itself, so equal digests alone never drop a row.

Cases: null text counts as empty, and all empty texts are copies of each other; a null id loses to any other id; repeated rows
are copies, of which exactly one stays (the last in file order); very long texts are hashed and compared as whole values in the JVM,
up to the 2 GB of one value; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.llm.common import FILE, LOCATOR, ROW, counted, fetch, located, new_path, without

#: ASCII white space, which does not count when texts are compared.
SPACE = r"[\x20\x09-\x0D]+"
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    # Else each of the many state partitions reserves megabytes for its manifest and logs.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def sha256(norm: Column) -> Column:
    return F.sha2(norm.cast("binary"), 256)


@dataclass
class DedupStream:
    """Keyed dedup state in ``home``; ``run`` takes in all arrivals there are and may be called again as more come."""

    spark: SparkSession
    home: str
    files_per_batch: int | None = None

    def batches(self, out: str) -> int:
        """Folders of batches, whose numbers don't change when a batch is run again."""
        context = self.spark.sparkContext
        done = context._jvm.org.apache.hadoop.fs.Path(f"{out}/batch=*")
        return len(done.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(done) or ())

    def run(self, arrivals: str, schema) -> DataFrame:
        """The state after the arrivals in the folder: digest, keep (struct), group_size."""
        spark, out = self.spark, f"{self.home}/state"
        before = {k: spark.conf.get(k, None) for k in ROCKSDB}
        for k, v in ROCKSDB.items():
            spark.conf.set(k, v)
        try:
            reader = spark.readStream.schema(schema)
            if self.files_per_batch:
                reader = reader.option("maxFilesPerTrigger", self.files_per_batch)
            state = reader.parquet(arrivals).groupBy("digest").agg(
                F.max(F.struct(*RANK)).alias("keep"), F.count("*").alias("group_size")
            )
            # Update mode hands over the changed keys of a batch; writing them under the batch's number makes a retry overwrite itself.
            query = (
                state.writeStream.outputMode("update")
                .option("checkpointLocation", f"{self.home}/checkpoint")
                .foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}"))
                .trigger(availableNow=True)
                .start()
            )
            query.awaitTermination()
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        batches = self.batches(out)
        if not batches:  # nothing has arrived
            return spark.createDataFrame([], f"digest string, keep {schema_of_keep(schema)}, group_size long")
        changes = spark.read.parquet(out)
        if batches == 1:
            return changes.drop("batch")
        return changes.groupBy("digest").agg(F.max_by(F.struct("keep", "group_size"), "batch").alias("s")).select("digest", "s.*")


#: The largest of these is the row that stays: most code points, then the smallest id, then one of equal rows.
RANK = ("n_points", "id_rank", FILE, ROW, "doc_id")


def schema_of_keep(schema) -> str:
    kind = schema["doc_id"].dataType.simpleString()
    return f"struct<n_points:int,id_rank:{kind},{FILE}:string,{ROW}:long,doc_id:{kind}>"


def fingerprints(docs: DataFrame, id_col: str, text_col: str, digest=sha256) -> DataFrame:
    """What the stream takes in: digest, length, id and locator of each row, without the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        digest(normalised(F.col(text_col))).alias("digest"),
        sha256(normalised(F.col(text_col))).alias("text_sha256"),
        F.char_length(text).alias("n_points"),
        F.bitwise_not(F.col(id_col)).alias("id_rank"),
        FILE,
        ROW,
    )


def marked_rows(docs: DataFrame, id_col: str, text_col: str, digest=sha256, files_per_batch: int | None = None) -> DataFrame:
    """Rows of located docs without their texts: what ``fingerprints`` gives, with keep (the row that stays) and group_size."""
    spark = docs.sparkSession
    home = new_path(spark, "dedup")
    arrivals = f"{home}/arrivals"
    prints = fingerprints(docs, id_col, text_col, digest)
    prints.write.parquet(arrivals)
    rows = spark.read.schema(prints.schema).parquet(arrivals)
    state = DedupStream(spark, home, files_per_batch).run(arrivals, prints.schema)
    marked, seen = counted(rows.join(state, "digest"), "dedup-marked", hits=F.count_if(F.col("group_size") > 1))
    if not seen["hits"]:
        return marked
    split, more = verify_bytes(docs, marked.filter("group_size > 1"), seen["hits"], text_col)
    return split_classes(docs, marked, split, text_col) if more else marked


def stays() -> Column:
    return (F.col(f"keep.{FILE}") == F.col(FILE)) & (F.col(f"keep.{ROW}") == F.col(ROW))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256, files_per_batch: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256. The id must be a whole number."""
    marked = marked_rows(located(docs), id_col, text_col, digest, files_per_batch)
    return marked.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", stays().alias("kept"), "text_sha256")


def verify_bytes(docs: DataFrame, hits: DataFrame, n: int, text_col: str) -> tuple[DataFrame, int]:
    """Digests of the n hits that stand for more than one text, and how many.

    Only texts of hits (and few others, see ``Bits``) are moved, by locator, which is unique, so a large group spreads over all
    tasks; min and max meet before the shuffle by digest.
    """
    texts = docs.select(*LOCATOR, normalised(F.col(text_col)).alias("norm"))
    found = fetch(texts, hits.select(*LOCATOR, "digest"), n)
    ends = found.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b"))
    split, seen = counted(ends.filter(F.col("a") != F.col("b")).select("digest"), "dedup-split", n=F.count(F.lit(1)))
    return split, seen["n"]


def split_classes(docs: DataFrame, marked: DataFrame, split: DataFrame, text_col: str) -> DataFrame:
    """marked, with the rows of the split digests grouped by their text."""
    own = marked.drop("keep", "group_size").join(split, "digest", "left_semi")
    texts = docs.select(*LOCATOR, normalised(F.col(text_col)).alias("norm")).join(own, list(LOCATOR))
    groups = texts.groupBy("norm").agg(F.max(F.struct(*RANK)).alias("keep"), F.count("*").alias("group_size"))
    regrouped = texts.join(groups, "norm").drop("norm")
    return marked.join(split, "digest", "left_anti").unionByName(regrouped.select(*marked.columns))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that are copies; same columns."""
    rows = located(docs)
    dropped, seen = counted(marked_rows(rows, id_col, text_col).filter(~stays()).select(*LOCATOR), "dedup-dropped", n=F.count(F.lit(1)))
    return without(rows, dropped, seen["n"]).drop(*LOCATOR)
