"""Readers and writers of task records, result panels, seed runs and JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.functions.text import unknown_names

TASK = """id string, title string, difficulty string, domain string, nl_spec string,
    interface array<struct<name: string, type: string, direction: string, description: string, range: array<double>>>,
    safety_properties array<struct<id: string, kind: string, nl: string, ltl: string, ctl: string, severity: string>>,
    scenarios array<struct<id: string, description: string, steps: array<struct<inputs: map<string, int>, expect: map<string, int>>>>>,
    reference_st_file string, tags array<string>, notes string"""
LEVELS, KINDS, SEVERITIES = ("easy", "medium", "hard"), ("safety", "invariant", "liveness"), ("critical", "high", "medium")


def tasks(spark: SparkSession, root: str) -> DataFrame:
    """Every meta.json under root, with its folder and the text of the program it names (null if there is none)."""
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"^(.*)/[^/]*$", 1)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)$", 1)
    nested = lambda names: spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", names)
    meta = nested("meta.json").option("multiLine", True).schema(TASK).json(root).withColumn("folder", folder)
    meta = meta.withColumn("reference_st_file", F.coalesce("reference_st_file", F.lit("reference.st")))
    severe = F.transform("safety_properties", lambda p: p.withField("severity", F.coalesce(p["severity"], F.lit("high"))))
    text = nested("*.st").text(root, wholetext=True).select(folder.alias("folder"), name.alias("reference_st_file"), F.col("value").alias("reference"))
    return meta.withColumn("safety_properties", severe).join(text, ["folder", "reference_st_file"], "left").orderBy("folder")


def task_faults(rows: DataFrame) -> DataFrame:
    """One row per fault of a task record: id and fault."""
    faults = {
        "no id": F.col("id").isNull() | (F.col("id") == ""),
        "unknown difficulty": ~F.coalesce(F.col("difficulty").isin(*LEVELS), F.lit(False)),
        "no properties": F.coalesce(F.size("safety_properties"), F.lit(0)) < 1,
        "range without two bounds": F.coalesce(F.exists("interface", lambda v: F.coalesce(F.size(v["range"]) != 2, F.lit(False)) & v["range"].isNotNull()), F.lit(False)),
        "unknown severity": F.coalesce(F.exists("safety_properties", lambda p: ~F.coalesce(p["severity"], F.lit("high")).isin(*SEVERITIES)), F.lit(False)),
        "unknown kind": F.coalesce(F.exists("safety_properties", lambda p: ~p["kind"].isin(*KINDS)), F.lit(False)),
    }
    names = F.transform(F.coalesce("interface", F.array().cast(rows.schema["interface"].dataType)), lambda v: v["name"])
    formulas = F.transform("safety_properties", lambda p: F.concat_ws(" ", p["ltl"], p["ctl"]))
    faults["formula with an unknown name"] = F.coalesce(F.exists(formulas, lambda f: F.size(unknown_names(f, names)) > 0), F.lit(False))
    faults["property without a formula"] = F.coalesce(F.exists(formulas, lambda f: F.trim(f) == ""), F.lit(False))
    found = F.array_compact(F.array(*(F.when(c, k) for k, c in faults.items())))
    return rows.select("id", F.explode(found).alias("fault"))


def panel_samples(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Samples of result panels: JSON documents {model, condition, rows: [{..., samples: [...]}]}; documents without rows are skipped."""
    docs = spark.read.option("multiLine", True).schema(schema).json(path).filter(F.col("rows").isNotNull())
    rows = docs.select(*(c for c in docs.columns if c != "rows"), F.explode("rows").alias("r")).select("*", "r.*").drop("r")
    return rows.select(*(c for c in rows.columns if c != "samples"), F.posexplode("samples").alias("i", "s")).select("*", "s.*").drop("s")


def seed_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files named <stage>_s<seed>.json, with both as columns; other files are left out."""
    rows = spark.read.option("multiLine", True).schema(schema).json(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)\.json$", 1)
    rows = rows.select("*", F.regexp_extract(name, r"^(.*)_s(\d+)$", 1).alias("stage"), F.regexp_extract(name, r"^(.*)_s(\d+)$", 2).alias("seed"))
    return rows.filter("stage <> ''").withColumn("seed", F.col("seed").cast("int"))


def stages(spark: SparkSession, path: str) -> DataFrame:
    """The stages that a folder of <stage>_s<seed>.json files has, with their numbers of seeds."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select(F.regexp_extract("path", r"([^/]*)\.json$", 1).alias("name"))
    named = files.select(F.regexp_extract("name", r"^(.*)_s(\d+)$", 1).alias("stage"), "name").filter("stage <> ''")
    return named.groupBy("stage").agg(F.count_distinct("name").alias("seeds"))


def json_lines(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """Records of a file of JSON lines, empty lines left out; with a limit the first ones of the file."""
    rows = spark.read.schema(schema).json(path)
    return rows if limit is None else rows.limit(limit)


def write_report(summary: DataFrame, by_tier: DataFrame, rows: DataFrame, path: str) -> None:
    """A report as three folders of JSON: the summary, the tiers and the rows it was made from."""
    for name, part in (("summary", summary), ("by_tier", by_tier), ("rows", rows)):
        part.write.mode("overwrite").json(f"{path}/{name}")


def matrix_lines(rows: DataFrame, row: str, column: str, value: str, columns: list[str], width: int = 9) -> DataFrame:
    """A table of fixed width as lines: a row for each value of row, a column for each of columns, empty cells as -."""
    wide = rows.groupBy(row).pivot(column, columns).agg(F.first(value))
    cell = lambda c: F.lpad(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-")), width, " ")
    return wide.select(row, F.concat(F.rpad(F.col(row).cast("string"), width, " "), *map(cell, columns)).alias("line"))


def first_given(*names: str) -> Column:
    """The first of some text fields that isn't empty."""
    return F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names))


def write_subsets(rows: DataFrame, path: str, subset: Column, kind: str = "json") -> None:
    """A folder for each subset. One job commits all of them together; subsets that it doesn't have stay as they are."""
    rows.withColumn("subset", subset).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("subset").format(kind).save(path)


def not_done(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return todo.join(done.select(key), key, "left_anti")
