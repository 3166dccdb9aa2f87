"""Cleaning and packing of a corpus: five stages, each of which writes its rows for the next one.

Cases, for all stages but the last: rows that stay keep all their columns, whatever their names; texts count as a whole, however long; an
empty table stays empty. Null, empty and blank texts, and texts without letters, go with the first stage. Repeated rows are copies, of
which one stays (the last in the order of the files); a null id loses to any other. The last stage packs what is there, null texts too.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from traceloom.llm import decontamination, exact_dedup, jaccard_join, language_id, packing
from traceloom.sources.shared import delete, new_path, scratch

#: Calibrated probability below which a document's language counts as not recognised.
LEAST_LANGUAGE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose language is not recognised; without a labelled row nothing is."""
    return language_id.keep_identified(docs, LEAST_LANGUAGE)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for white space the longest stays, then that of the least id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by a similarity of 0.8 or more the one of the least id stays; those without words stay all."""
    return jaccard_join.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a test item; an empty benchmark drops none."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: Fitted models, MinHash and a tokenizer are beyond SQL; tests hold run() against its stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each one's rows go to the shared folder and are read again.

    What a stage leaves in the shared folder is deleted when its rows are written, and these when the next one's are.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
