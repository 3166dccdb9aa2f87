"""Controllers, sources, sinks, text functions and live traces."""

import json

import pytest
from pyspark.sql import functions as F

from traceloom.functions import text as X
from traceloom.operators import mutation
from traceloom.operators.controller import Controller, check, reachable
from traceloom.plans.invariants import MODELS, counter, timer
from traceloom.plans.traces import KEY, scans
from traceloom.functions import trace as T
from traceloom.sources import records
from traceloom.streaming import live


def states(spark, controller, name):
    return {r.state[name] for r in reachable(spark, controller).collect()}


def test_reachable_states(spark):
    assert states(spark, counter(3), "c") == {0, 1, 2, 3}
    assert states(spark, timer(2), "et") == {0, 1, 2}


def test_more_rounds_than_are_kept_apart(spark):
    long = Controller({"up": None}, {"n": 0}, lambda e: {"n": F.when(e["up"], F.least(e["n"] + 1, F.lit(20))).otherwise(e["n"])})
    got = check(spark, long, {"n < 18": lambda e: e["n"] < 18}).first()
    assert got.status == "fail" and got.length == 18 and all(s.up for s in got.trace)


def test_shortest_counterexamples(spark):
    rows = {r.property: r for r in check(spark, *MODELS["latch_set"]).collect()}
    assert rows["reset -> !q"].length == 1 and rows["reset -> !q"].trace[0].asDict() == {"set": True, "reset": True}
    assert rows["q -> X(q | reset)"].status == "pass"
    assert {r.property: r.length for r in check(spark, *MODELS["counter_4"]).collect()} == {"c <= 3": 4, "c >= 0": None}


def test_value_out_of_range_is_an_error(spark):
    free = Controller({"up": None}, {"n": 0}, lambda e: {"n": e["n"] + e["up"].cast("int")}, {"n": (0, 3)})
    assert {r.status for r in check(spark, free, {"n >= 0": lambda e: e["n"] >= 0}).collect()} == {"error"}


def test_integer_inputs_take_their_whole_range(spark):
    level = Controller({"level": (0, 5)}, {"top": 0}, lambda e: {"top": F.greatest(e["top"], e["level"])})
    assert states(spark, level, "top") == set(range(6))


TASK = {"id": "E1", "title": "t", "difficulty": "easy", "domain": "d", "nl_spec": "s", "interface": [{"name": "a", "type": "INT", "direction": "input", "range": [0, 5]}],
        "safety_properties": [{"id": "P1", "kind": "safety", "nl": "n", "ltl": "G(a)"}], "scenarios": []}


def test_tasks(spark, tmp_path):
    for name, task in {"b": TASK, "a": TASK | {"id": "E2", "safety_properties": [], "interface": [TASK["interface"][0] | {"range": [1]}], "difficulty": "odd"}}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "meta.json").write_text(json.dumps(task, indent=1))
    (tmp_path / "b" / "reference.st").write_text("PROGRAM\nEND_PROGRAM")
    rows = records.tasks(spark, str(tmp_path))
    got = rows.collect()
    assert [(r.id, r.reference) for r in got] == [("E2", None), ("E1", "PROGRAM\nEND_PROGRAM")] and got[1].safety_properties[0].severity == "high"
    assert {(r.id, r.fault) for r in records.task_faults(rows).collect()} == {("E2", "no properties"), ("E2", "range without two bounds"), ("E2", "unknown difficulty")}
    odd = rows.withColumn("safety_properties", F.transform("safety_properties", lambda p: p.withField("ltl", F.lit("G(a -> !zz)"))))
    assert ("E1", "formula with an unknown name") in {tuple(r) for r in records.task_faults(odd).collect()}


def test_panels_and_seed_runs(spark, tmp_path):
    (tmp_path / "sft_x_s2.json").write_text(json.dumps({"model": "m", "rows": [{"task_id": "E1", "samples": [{"code": "a"}, {"code": ""}]}]}))
    (tmp_path / "notes.json").write_text(json.dumps({"model": "m"}))
    schema = "model string, rows array<struct<task_id: string, samples: array<struct<code: string>>>>"
    assert [tuple(r) for r in records.panel_samples(spark, str(tmp_path), schema).orderBy("i").collect()] == [("m", "E1", 0, "a"), ("m", "E1", 1, "")]
    assert [(r.stage, r.seed) for r in records.seed_runs(spark, str(tmp_path), schema).collect()] == [("sft_x", 2)]
    assert [tuple(r) for r in records.stages(spark, str(tmp_path)).collect()] == [("sft_x", 1)]
    out = str(tmp_path / "report")
    records.write_report(spark.range(1), spark.range(2), spark.range(3), out)
    assert [spark.read.json(f"{out}/{k}").count() for k in ("summary", "by_tier", "rows")] == [1, 2, 3]


def test_json_lines_and_subsets(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"completion": "", "output": "b"}\n\n{"completion": "a"}\n')
    rows = records.json_lines(spark, str(tmp_path / "in.jsonl"), "completion string, output string").filter("completion is not null")
    given = rows.select(records.first_given("completion", "output").alias("v"))
    assert sorted(r.v for r in given.collect()) == ["a", "b"]
    out = str(tmp_path / "out")
    for _ in range(2):
        records.write_subsets(given, out, F.when(F.col("v") == "a", "x").otherwise("y"))
    assert sorted((r.v, r.subset) for r in spark.read.json(out).collect()) == [("a", "x"), ("b", "y")]
    assert records.not_done(given, given.filter("v = 'a'"), "v").count() == 1


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("output, status", [("-- specification x is true", "pass"), ("-- specification x is false\n-- specification y is true", "fail"), ("", "error")])
def test_checker_output(spark, output, status):
    assert one(spark, X.checker_status(F.lit(output))) == status


def test_text(spark):
    report = "a\n-- specification p is false\nc\nd"
    assert one(spark, X.counterexample(F.lit(report), 2)) == "-- specification p is false\nc" and one(spark, X.counterexample(F.lit("b is false"))) == ""
    assert one(spark, X.checker_status(F.lit(report), F.lit(True))) == "unknown"
    true = "-- specification p is true\n"
    assert [one(spark, X.joint_status(F.lit(t), F.lit(2))) for t in (true * 2, true, true + report)] == ["pass", "error", "fail"]
    assert one(spark, X.shown_trace(F.lit(" " + "t" * 1600))) == "t" * 1500 + "\n... (trace truncated)"
    parts = [F.lit(x) for x in ("ask", "code", "P1", "never", "trace", "other")]
    prompts = {k: one(spark, X.repair_prompt(k, *parts)) for k in X.FEEDBACK}
    assert "trace" in prompts["full"] and "other" in prompts["shuffle"] and "P1: never" in prompts["proponly"] and "P1" not in prompts["erroronly"]
    head = prompts["nocex"].index("[task]")
    assert all(p[:head] == prompts["nocex"][:head] for p in prompts.values())
    statuses = lambda *s: F.array(*map(F.lit, s))
    yes, no, none = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    cases = [(no, no, yes, ("pass",), "parse_error"), (yes, no, yes, ("pass",), "compile_error"), (yes, none, no, ("pass",), "verify_unavailable"), (yes, none, yes, ("pass", "error"), "translate_error"),
             (yes, yes, yes, ("pass", "pass"), "verified"), (yes, yes, yes, ("pass", "fail"), "unsafe"), (yes, yes, yes, ("unknown",), "unknown")]
    for parsed, compiled, available, own, want in cases:
        assert one(spark, X.outcome(parsed, compiled, available, statuses(*own))) == want
    assert one(spark, X.without_comments(F.lit(None).cast("string"))) is None and one(spark, X.ticks(F.lit(""))) is None


def test_programs_of_replies(spark):
    cases = {"```st\nPROGRAM a\nEND_PROGRAM\n``` x": "PROGRAM a\nEND_PROGRAM", "```\n``` PROGRAM a END_PROGRAM": "", "no. program a end_program yes": "program a end_program", "  none ": "none",
             "```st\nq := 1;\n```\nPROGRAM b END_PROGRAM": "q := 1;"}
    for reply, want in cases.items():
        assert one(spark, X.program_of(F.lit(reply))) == want, reply


def test_durations(spark):
    cases = {"T#3s": 3, "t#1m30s": 90, "T#500ms": 0, "T#1500ms": 2, "T#2500ms": 2, "T#1d": 86400, "T#1.5s": 2, "T#2_000ms": 2, "T#1h 2m": 3720, "TIME#1h": 3600, "3s": None}
    for literal, want in cases.items():
        assert one(spark, X.ticks(F.lit(literal))) == want, literal


def test_faults_of_blocks(spark):
    code = "PROGRAM a VAR_INPUT x END_VAR FUNCTION_BLOCK b IF c THEN (* IF *) REPEAT END_PROGRAM // END_IF"
    assert one(spark, X.block_faults(F.lit(code))) == "unbalanced FUNCTION_BLOCK/END_FUNCTION_BLOCK: 1 vs 0; unbalanced IF/END_IF: 1 vs 0"
    assert one(spark, X.balanced(F.lit("VAR_EXTERNAL x"))) and not one(spark, X.balanced(F.lit("VAR_TEMP x")))


def test_one_second(spark):
    cases = {"PT := T#1s": (True, True), "t#1s500ms": (True, False), "T#10s": (False, False), "T#001 s;": (False, True), "T#1s30": (True, False)}
    for code, want in cases.items():
        assert (one(spark, X.mentions_one_second(F.lit(code))), one(spark, X.has_one_second(F.lit(code)))) == want, code
    less, n = X.presets_less_one(F.lit("t(PT := T#3s); u(pt:=T#0s, PT := T#x)"))
    assert one(spark, less) == "t(PT := T#2s); u(pt:=T#0s, PT := T#x)" and one(spark, n) == 2


def test_prompt_of_a_task(spark):
    row = spark.createDataFrame([("spec", [("a", "BOOL", "input", None, "on"), ("n", "INT", "output", [0, 5], "count")])], "spec string, vars array<struct<name:string,type:string,direction:string,range:array<int>,description:string>>")
    text = row.select(X.task_prompt(F.col("spec"), F.col("vars"), F.array(F.lit("be brief")))).first()[0]
    assert "  - a : BOOL [input] - on\n  - n : INT [output, range [0, 5]] - count\n" in text and text.endswith("RULES:\n- be brief")


def test_grids(spark):
    from traceloom.operators import grids

    rows = {r.id: r for r in grids.grid(spark, grids.DEFAULT).unionByName(grids.grid(spark, grids.HARD)).collect()}
    assert len(rows) == 208 and sum(r.family in grids.DEFAULT for r in rows.values()) == 158
    assert rows["GEN_mguard_2_Fan"].formulas == ["G(!G1 -> !Fan)", "G(!G2 -> !Fan)", "G(StopPB -> !Fan)"] and rows["GEN_mguard_3_Fan"].difficulty == "medium"
    assert rows["GEN_chain_3e2g_Hoist"].formulas[3] == "G(!G1 -> !Hoist)" and rows["GEN_excl_Heat_Cool"].formulas[0] == "G(!(Heat & Cool))"


def test_mutants_of_nothing(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "x := TRUE;")], "id int, code string")
    got = sorted((r.id, r.rule, r.offset, r.mutant) for r in mutation.mutants(rows).collect())
    assert got == [(3, "bool_flip", 5, "x := FALSE;"), (3, "drop_statement", 0, "(* mut *)")]
    scored = spark.createDataFrame([("t", True, True, False), ("t", True, False, True), ("t", False, False, False), ("u", True, False, False)], "task string, compiles boolean, kills_a boolean, kills_b boolean")
    assert {r[0]: tuple(r)[1:] for r in mutation.verdicts(scored, "task").collect()} == {"t": (2, 1, 1, 1, 0), "u": (1, 0, 0, 0, 1), None: (3, 1, 1, 1, 1)}


def test_live_alarms_equal_the_window(spark, sf_dir, tmp_path):
    rows = scans(spark, sf_dir).select("user_id", "ts", "event_id", "trip", "reset")
    source = str(tmp_path / "in")
    for k, day in enumerate(("2024-01-10", "2024-01-20", "2025-01-01")):  # files in the order of time
        before = ("2000-01-01", "2024-01-10", "2024-01-20")[k]
        rows.filter((F.col("ts") >= before) & (F.col("ts") < day)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = live.live_alarms(stream).writeStream.format("memory").queryName("live_alarms").option("checkpointLocation", str(tmp_path / "at")).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    want = rows.select("event_id", T.latch(F.col("trip"), F.col("reset"), KEY).alias("alarm"))
    assert sorted(map(tuple, spark.table("live_alarms").select("event_id", "alarm").collect())) == sorted(map(tuple, want.collect()))


def test_event_time_windows(spark, sf_dir):
    rows = scans(spark, sf_dir)
    assert live.trips_by_window(rows, "1 day").agg(F.sum("n_scans")).first()[0] == rows.count()
    assert live.sessions(rows).agg(F.sum("n_scans")).first()[0] == rows.count()
    assert live.trips_by_window(rows.limit(0)).count() == 0
