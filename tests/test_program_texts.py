"""Program texts that are long, null or repeated, with numbers that no integer type holds."""

from pyspark.sql import functions as F

from traceloom.operators import mutation
from traceloom.plans import programs as P


def test_mutants_of_long_and_odd_texts(spark):
    long = "q := TRUE;\n" * 400
    rows = spark.createDataFrame([(1, long), (2, long), (3, None), (4, "a < 99999999999999999999999999999999999999999"), (5, "b > 007"), (6, "c > 1299")], "id int, code string")
    got = mutation.mutants(rows)
    per = {(r.id, r.rule): r.n for r in got.groupBy("id", "rule").agg(F.count_distinct("mutant").alias("n")).collect()}
    assert all(per[i, rule] == n for i in (1, 2) for rule, n in (("bool_flip", 400), ("drop_statement", 400))) and not any(i == 3 for i, _ in per)
    more = {r.id: r.mutant for r in got.filter("rule = 'constant'").collect()}
    assert more == {4: "a < 1" + "0" * 41, 5: "b > 8", 6: "c > 1300"}
    assert {(r.id, r.offset) for r in got.filter("id < 3 AND rule = 'bool_flip'").collect()} == {(i, 11 * k + 5) for i in (1, 2) for k in range(400)}


def test_queries_read_every_document(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert P.program_lint_documents(spark, sf_dir).count() == P.program_extract_documents(spark, sf_dir).count() == n
    assert P.program_mutants_documents(spark, sf_dir).count() > n


def test_conditions_in_not(spark):
    code = "IF a OR b THEN q := 1; ELSIF c\nTHEN x; END_IF; IF d"
    got = {r.offset: r.mutant for r in mutation.mutants(spark.createDataFrame([(1, code)], "id int, code string")).filter("rule = 'negate_condition'").collect()}
    assert got == {
        3: "IF NOT (a OR b ) THEN q := 1; ELSIF c\nTHEN x; END_IF; IF d",
        29: "IF a OR b THEN q := 1; ELSIF NOT (c\n) THEN x; END_IF; IF d",
        code.rindex("d"): code[:-1] + "NOT (d",
    }
