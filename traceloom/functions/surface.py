"""Functions that SQL text can call: SQL-defined ones, and a table function whose result has the columns of the table it is given."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import BooleanType, StructType

#: Name and body of SQL-defined functions. pass_at_k: chance that one of k of n trials is among the c that passed, k at most n.
DEFINED = {
    "pass_at_k(n INT, c INT, k INT) RETURNS DOUBLE": """CASE WHEN n <= 0 OR n IS NULL THEN NULL WHEN n - c < least(k, n) THEN 1.0D
        ELSE 1.0D - aggregate(sequence(0, least(k, n) - 1), 1.0D, (a, i) -> a * (n - c - i) / (n - i)) END""",
    "ticks(literal STRING) RETURNS BIGINT": r"""CASE WHEN literal RLIKE '(?i)^T(?:IME)?#' THEN CAST(bround(aggregate(
        regexp_extract_all(lower(replace(regexp_replace(literal, '^[^#]*#', ''), '_', '')), '([0-9]*[.]?[0-9]+[ ]*(?:ms|s|m|h|d))', 1), 0.0D,
        (a, p) -> a + CAST(regexp_extract(p, '[0-9.]+', 0) AS DOUBLE) * CASE regexp_extract(p, '[a-z]+', 0) WHEN 'ms' THEN 0.001D WHEN 's' THEN 1.0D WHEN 'm' THEN 60.0D WHEN 'h' THEN 3600.0D ELSE 86400.0D END)) AS BIGINT) END""",
    "block_fault(code STRING, name STRING) RETURNS STRING": r"""CASE WHEN regexp_count(upper(code), concat('\\b', name, '\\b')) <> regexp_count(upper(code), concat('\\bEND_', name, '\\b'))
        THEN concat('unbalanced ', name, '/END_', name, ': ', regexp_count(upper(code), concat('\\b', name, '\\b')), ' vs ', regexp_count(upper(code), concat('\\bEND_', name, '\\b'))) END""",
}


class Latch:
    """``latch(TABLE(t), set, reset, key, order)``: the table's columns and ``held``, on from a row with ``set`` (which wins) until one with ``reset``.

    Rows are grouped by the key and come in the order of the columns that ``order`` names (joined by commas); one flag is kept.
    """

    def __init__(self):
        self.held = False

    @staticmethod
    def analyze(table: AnalyzeArgument, on: AnalyzeArgument, off: AnalyzeArgument, key: AnalyzeArgument, order: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("the first argument of latch is a table")
        names = {f.name: f.dataType for f in table.dataType.fields}
        for part in (on, off):
            if names.get(part.value) != BooleanType():
                raise ValueError(f"latch needs a boolean column, which {part.value} is not")
        by = [c.strip() for c in order.value.split(",")]
        if missing := [c for c in (key.value, *by) if c not in names]:
            raise ValueError(f"latch doesn't find {', '.join(missing)}")
        schema = StructType(list(table.dataType.fields)).add("held", BooleanType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(key.value)], orderBy=[OrderingColumn(c) for c in by])

    def eval(self, row, on: str, off: str, key: str, order: str):
        if row[on]:
            self.held = True
        elif row[off]:
            self.held = False
        yield (*row, self.held)


def register(spark: SparkSession) -> None:
    """Makes all functions known to the session, as temporary ones."""
    for head, body in DEFINED.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("latch", udtf(Latch))
