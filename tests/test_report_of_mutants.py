"""What report_mutants costs a row: programs are dealt to tasks, a mutant's blocks are counted in one pass, numbers grow by simple means."""

import re

from pyspark.sql import functions as F

from traceloom.functions import text as X
from traceloom.operators import mutation
from traceloom.plans import reports

WORDS = ["IF", "END_IF", "VAR", "VAR_INPUT", "VAR_IN_OUT", "VAR_INPUTS", "END_VAR", "END_VAR_INPUT", "case", "End_Case", "FOR", "END_FOR", "xIF", "IF_", "É", "éIF", "PROGRAM", "END_PROGRAM", "FUNCTION_BLOCK", "END_FUNCTION_BLOCK", "WHILE", "END_WHILE", "(* IF *)", "// FOR\n"]


def faults(code):
    plain = re.sub(r"//[^\n]*", " ", re.sub(r"(?s)\(\*.*?\*\)", " ", code)).upper()
    n = lambda pattern: len(re.findall(rf"\b{pattern}\b", plain))
    pairs = [(b, n(b + ("(?:_INPUT|_OUTPUT|_IN_OUT|_GLOBAL|_TEMP)?" if b == "VAR" else "")), n(f"END_{b}")) for b in X.BLOCKS]
    return "; ".join(f"unbalanced {b}/END_{b}: {o} vs {c}" for b, o, c in pairs if o != c)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_are_counted_in_one_pass(spark):
    codes = [None, "", *(a + sep + b + sep + c for sep in (" ", ";", "") for a in WORDS for b in WORDS[::3] for c in WORDS[::7])]
    got = spark.createDataFrame(list(enumerate(codes)), "i int, code string").select("i", X.block_faults(F.col("code")).alias("f"), X.balanced(F.col("code")).alias("b"))
    want = [(i, None if c is None else faults(c)) for i, c in enumerate(codes)]
    assert sorted((r.i, r.f, r.b) for r in got.collect()) == [(i, f, None if f is None else f == "") for i, f in want]
    one = spark.range(1).select(F.col("id").cast("string").alias("code")).select(X.block_faults(F.col("code")).alias("f"))
    assert plan_of(one).count("upper(") == 1


def test_numbers_one_more(spark):
    numbers = ["0", "9", "007", "0099", "1299", "9" * 18, "1" + "0" * 18, "9" * 19, "0" * 30 + "9", "0" * 17 + "99", "8" * 40, "9" * 40]
    tokens = [f(n) for n in numbers for f in ("<= {}".format, "T#{}s".format)]
    got = spark.createDataFrame(list(enumerate(tokens)), "i int, t string").select("i", mutation.one_more(F.col("t")).alias("m"))
    assert [r.m for r in sorted(got.collect())] == [re.sub(r"\d+", lambda m: str(int(m[0]) + 1), t) for t in tokens]


def test_programs_are_dealt_before_they_are_changed(spark, sf_dir):
    plan = plan_of(reports.report_mutants(spark, sf_dir))
    assert 0 < plan.index("Generate explode") < plan.index("RepartitionByExpression [p_partkey") < plan.index("Relation [")
