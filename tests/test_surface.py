"""Functions for SQL text, spelling of names and scenario candidates, on awkward cases."""

import pytest
from pyspark.sql import functions as F

from traceloom.functions import surface
from traceloom.functions.metrics import pass_at_k
from traceloom.functions.text import ticks
from traceloom.operators import grids, naming


def test_sql_functions_are_the_librarys(spark):
    surface.register(spark)
    rows = spark.createDataFrame([(n, c, k) for n in (0, 1, 2, 7, 20) for c in (0, 1, 2, 7) for k in (1, 2, 5) if c <= n], "n int, c int, k int")
    for r in rows.select("k", F.expr("pass_at_k(n, c, k)").alias("sql"), *(pass_at_k(F.col("n"), F.col("c"), k).alias(f"k{k}") for k in (1, 2, 5))).collect():
        assert (r.sql is None and r[f"k{r.k}"] is None) or abs(r.sql - r[f"k{r.k}"]) < 1e-12
    texts = spark.createDataFrame([(t,) for t in ("T#1m30s", "t#250ms", "TIME#1.5s", "T#1_000ms", "T#2.5s", "5s", "", None)], "t string")
    assert all(r.a == r.b for r in texts.select(F.expr("ticks(t)").alias("a"), ticks(F.col("t")).alias("b")).collect())


def test_table_function_takes_any_table(spark):
    surface.register(spark)
    rows = [(1, 3, True, False, "x"), (1, 1, False, True, None), (1, 2, None, None, "y"), (2, 1, True, True, "z"), (2, 2, False, False, ""), (2, 3, False, True, "w"), (None, 1, True, None, "n")]
    spark.createDataFrame(rows, "k int, t int, on boolean, off boolean, note string").createOrReplaceTempView("signals")
    got = spark.sql("SELECT * FROM latch(TABLE(SELECT note, k, t, `on`, off FROM signals), 'on', 'off', 'k', 't')")
    assert got.columns == ["note", "k", "t", "on", "off", "held"]
    assert {(r.k, r.t): r.held for r in got.collect()} == {(1, 1): False, (1, 2): False, (1, 3): True, (2, 1): True, (2, 2): True, (2, 3): False, (None, 1): True}
    assert spark.sql("SELECT * FROM latch(TABLE(SELECT * FROM signals WHERE k > 5), 'on', 'off', 'k', 't')").count() == 0
    for bad in ("'note', 'off', 'k', 't'", "'on', 'off', 'nokey', 't'", "'on', 'off', 'k', 't,noorder'"):
        with pytest.raises(Exception, match="latch"):
            spark.sql(f"SELECT * FROM latch(TABLE(SELECT * FROM signals), {bad})").collect()


def test_names_are_spelt_as_declared(spark):
    programs = {
        1: "PROGRAM P\n a := Tmr.q AND NOT A; (* A tmr *) // A\n x := 'A' + T#1A; a1 := aa;", 2: "a := b;", 3: "Q := q;", 4: "P := 1;", 5: "tmr.speed := A;", 6: None, 7: "", 8: "a (* A never closed A",
        9: "program p\nP := a;", 10: "A" + " a A" * 20_000,
    }
    names = [(1, n) for n in ("A", "tMR", "x", "a1", "aA")] + [(2, "a"), (3, "q"), (3, "Q"), (4, "p"), (5, "tmr"), (5, "a"), (8, "A"), (9, "P"), (9, "a"), (10, "a"), (10, None), (99, "z")]
    frame, interface = spark.createDataFrame(list(programs.items()), "id int, code string"), spark.createDataFrame(names, "id int, name string")
    got = {r.id: r for r in naming.case_normalised(frame, interface).collect()}
    assert got[1].status == "ok" and got[1].fixes == 3
    assert got[1].code == "PROGRAM P\n A := tMR.Q AND NOT A; (* A tmr *) // A\n x := 'A' + T#1A; a1 := aA;"
    assert {i: got[i].status for i in (2, 3, 4, 5, 6, 7, 8, 9)} == {2: "undeclared", 3: "collision", 4: "ok", 5: "member", 6: "ok", 7: "ok", 8: "ok", 9: "collision"}
    assert got[4].code == "p := 1;" and got[2].code == programs[2] and got[6].code == "" and got[8].code == "A (* A never closed A" and got[9].code == programs[9]
    assert got[10].fixes == 20_001 and got[10].code == "a" + " a a" * 20_000
    assert naming.case_normalised(frame.limit(0), interface).count() == 0
    assert {r.status for r in naming.case_normalised(frame, interface.limit(0), strict=False).collect()} == {"ok"}


def test_scenarios_of_each_family(spark):
    row = spark.createDataFrame([(2, 2, 1, "Motor", "Fault", 80, 10, "X", "Y")], "n int, a int, b int, out string, trip string, high int, low int, pa string, pb string")
    steps = lambda family, rows=row: [(r.scenario, r.step, r.inputs, r.expect) for r in grids.candidate_steps(rows, family).collect()]
    assert steps("estop_bus")[-1] == ("S_estop", 1, "Start=1,Stop=0,E1=0,E2=1", "Motor=0")
    assert steps("safety_chain")[-1] == ("S_guard", 1, "Start=1,Stop=0,E1=1,E2=1,G1=0", "Motor=0")
    assert [s[3] for s in steps("ondelay") if s[0] == "S_delay_on"] == ["", "", "", "Motor=1"]
    assert [s[2:] for s in steps("bounded_updown")][-2:] == [("Inc=1,Dec=0,Reset=0", ""), ("Inc=0,Dec=0,Reset=0", "Motor=1")] and len(steps("bounded_updown")) == 5
    pair = row.drop("a", "b").withColumnsRenamed({"pa": "a", "pb": "b"})
    assert steps("exclusive_two", pair) == [("S_a", 0, "ReqA=1,ReqB=0", "X=1,Y=0"), ("S_b", 0, "ReqA=0,ReqB=1", "X=0,Y=1")]
    assert steps("ordered_pair", pair)[-1] == ("S_estop", 1, "Stop=0,EStop=0,StartA=1,StartB=1", "X=0,Y=0")
    assert steps("hysteresis")[-1] == ("S_high", 1, "Level=80", "Actuator=0") and steps("two_speed")[0][3] == "MotorSlow=1,MotorFast=0" and steps("override_cutout")[2][2] == "Demand=1,Enable=1,Fault=1"
