"""What the corpus operators share: intermediate tables, id hashes, row locators and samples."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from traceloom.sources.shared import delete, new_path, scratch, shared_dir, stored, stored_at

__all__ = [
    "FILE", "LOCATOR", "ROW", "Bits", "bounded_sample", "counted", "ddl", "delete", "fetch", "id_bucket", "located", "new_path", "scratch", "shared_dir", "slices",
    "spread_join", "stored", "stored_at", "text_batches", "without",
]

#: Names that no table of a user has.
FILE, ROW = "traceloom_file_5d1b7c", "traceloom_row_5d1b7c"
MOST_BITS = 26


#: Rows of texts that go to a Python worker at a time.
BATCH_ROWS = 1000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_batches(docs: DataFrame) -> DataFrame:
    """docs; the session's Arrow batches have BATCH_ROWS rows at most from now on, since a row is a whole text.

    The setting has to hold when the result is computed, so it stays. Batches of the default 10,000 texts would be held by the
    executor and the worker of each task, some hundred megabytes in all.
    """
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get(ARROW_ROWS)) <= BATCH_ROWS:
        conf.set(ARROW_ROWS, str(BATCH_ROWS))
    return docs


def slices(batches, rows: int = BATCH_ROWS):
    """Arrow batches in parts of so many rows at most, however large they come."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def ddl(df: DataFrame, *left_out: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in left_out)


def counted(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
    """df, stored, and what the measures (aggregates) come to over it, taken while it is written."""
    seen = Observation()
    out = stored(df.observe(seen, *(c.alias(k) for k, c in measures.items())), name)
    return out, seen.get


def id_bucket(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n: what holds rows out."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


#: Nodes of a plan that give one row for each row of what is below them, or none, and the same ones whenever they run.
ROW_BY_ROW = ("Project", "Filter", "SubqueryAlias", "View", "Relation", "LogicalRelation", "LogicalRelationWithTable")


def straight(docs: DataFrame) -> bool:
    """Whether each row of docs is a row of its own of some file: files are read once, and nothing repeats, joins, unites or draws rows."""
    plan = docs._jdf.queryExecution().analyzed()
    while True:
        below = plan.children()
        if plan.nodeName().split(" ")[0] not in ROW_BY_ROW or not plan.deterministic() or below.size() > 1:
            return False
        if not below.size():
            if plan.relation().getClass().getSimpleName() != "HadoopFsRelation":  # a relation of another kind, such as a database's
                return False
            roots = list(docs.sparkSession._jvm.scala.jdk.javaapi.CollectionConverters.asJava(plan.relation().location().rootPaths()))
            return len({str(r) for r in roots}) == len(roots)
        plan = below.apply(0)


def located(docs: DataFrame) -> DataFrame:
    """docs with the file and the row in it as columns, a key of each row that also tells where its bytes are.

    Rows that don't come straight from files, each from one of its own, are written to the shared folder first. A column of docs
    that is named _metadata, too, is left alone.
    """
    def placed(rows: DataFrame) -> DataFrame:
        at = rows.metadataColumn("_metadata")
        return rows.select("*", at["file_path"].alias(FILE), at["row_index"].alias(ROW))

    try:
        return placed(docs if straight(docs) else stored(docs, "located"))
    except AnalysisException:  # files of a kind that has no row numbers
        return placed(stored(docs, "located"))


class Bits:
    """A bitmap of hashed keys: 16 bits a key, but 2^MOST_BITS (8 MB) at most, so it may be broadcast.

    A key that is in it has its bit set, of the others one in 16 while the bound isn't reached; past it, more. So it only says
    which rows a join needn't look at, and nothing depends on it but what is moved.
    """

    def __init__(self, keys: DataFrame, n: int, on: tuple[str, ...]):
        self.n, self.on = 1 << min(MOST_BITS, max(15, (16 * n).bit_length())), on
        part, bit = self.place()
        self.parts = F.broadcast(keys.groupBy(part.alias("traceloom_part")).agg(F.bitmap_construct_agg(bit).alias("traceloom_bits")))

    def place(self) -> tuple[Column, Column]:
        at = F.pmod(F.xxhash64(*self.on), F.lit(self.n))
        return F.call_function("shiftright", at, F.lit(15)), at.bitwiseAND(F.lit(32767))

    def test(self, rows: DataFrame, there: bool) -> DataFrame:
        """The rows whose bit is set (there) or isn't."""
        part, bit = self.place()
        byte = F.substring(F.col("traceloom_bits"), (F.call_function("shiftright", bit, F.lit(3)) + 1).cast("int"), F.lit(1))
        shifted = F.call_function("shiftright", F.conv(F.hex(byte), 16, 10).cast("int"), bit.bitwiseAND(F.lit(7)).cast("int"))
        return rows.join(self.parts, (part == F.col("traceloom_part")) & (shifted.bitwiseAND(F.lit(1)) == 1), "left_semi" if there else "left_anti")


LOCATOR = (FILE, ROW)


def fetch(rows: DataFrame, keys: DataFrame, n: int, on: tuple[str, ...] = LOCATOR) -> DataFrame:
    """rows joined with keys (n rows) on their common columns; hardly any other rows are moved."""
    return Bits(keys, n, on).test(rows, True).join(keys, list(on))


def without(docs: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """Located docs without the rows that keys (located, n rows) name; only those, and few others, are moved."""
    if not n:
        return docs
    bits = Bits(keys, n, LOCATOR)
    return bits.test(docs, False).unionByName(bits.test(docs, True).join(keys.select(*LOCATOR), list(LOCATOR), "left_anti"))


#: Parts into which the rows of one key are dealt in ``spread_join``.
PARTS = 4


def spread_join(rows: DataFrame, small: DataFrame, key: str, salt: str, how: str = "inner") -> DataFrame:
    """rows joined with small, which has one row a key; a key that many rows have is dealt out by the hash of another column.

    Rows of small are repeated for each part. As both sides are dealt out anew for this join, Spark can also split what is left of
    a hot key; where small comes from an aggregation by the key, it couldn't otherwise.
    """
    parts = small.withColumn("traceloom_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    dealt = rows.withColumn("traceloom_part", F.pmod(F.xxhash64(salt), F.lit(PARTS)).cast("int"))
    return dealt.join(parts, [key, "traceloom_part"], how).drop("traceloom_part")


def bounded_sample(rows: DataFrame, key: str, limit: int, total: int | None = None) -> DataFrame:
    """At most limit of the distinct rows, those with the smallest hashes of all columns, in the order of the hashes.

    The filter in front keeps the sort small. Rows that are repeated count once, and a key that many rows share doesn't matter.
    """
    total = rows.count() if total is None else total
    hash_of = F.pmod(F.xxhash64(F.col(key).cast("string"), *rows.columns, F.lit("sample")), F.lit(1 << 30))
    share = min(1.0, 1.3 * (limit + 100) / max(1, total))
    while True:
        few = rows.withColumn("sample_hash", hash_of).filter(F.col("sample_hash") < int(share * (1 << 30))).distinct()
        few = stored(few.orderBy("sample_hash", *rows.columns).limit(limit), "sample")
        if share >= 1 or few.count() >= min(limit, total):
            return few.orderBy("sample_hash", *rows.columns).drop("sample_hash")
        share = min(1.0, share * 8)
