"""Template families of tasks as tables: a row for each combination of parameters, with id, level and formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The parameters of the families. Eight names, then for each family its grid.
NAMES = ("Motor", "Drive", "Pump", "Fan", "Mixer", "Blower", "Spindle", "Auger")
DEFAULT = {
    "multi_guard": {"n": (1, 2, 3, 4), "out": NAMES},
    "estop_bus": {"n": (1, 2, 3, 4), "out": NAMES},
    "ondelay": {"n": (1, 2, 3, 4), "out": NAMES},
    "override_cutout": {"out": NAMES, "trip": ("OverTemp", "Fault")},
    "bounded_counter": {"n": (2, 3, 4, 5), "out": NAMES},
    "hysteresis": {"high": (70, 80, 90), "low": (5, 10, 20)},
    "exclusive_two": {"pair": (("DoorA", "DoorB"), ("ValveX", "ValveY"), ("Heat", "Cool"), ("FwdK", "RevK"), ("StarK", "DeltaK"))},
}
HARD = {
    "safety_chain": {"shape": ((1, 2), (2, 1), (2, 2), (3, 2)), "out": ("Motor", "Drive", "Pump", "Conveyor", "Mixer", "Hoist")},
    "bounded_updown": {"n": (2, 3, 4, 5, 6), "out": ("Bay", "Slot", "Buffer")},
    "ordered_pair": {"pair": (("Feed", "Mix"), ("Pump", "Heat"), ("Conv1", "Conv2"), ("Lube", "Spindle"), ("Charge", "Run"))},
    "two_speed": {"out": ("Motor", "Drive", "Pump", "Conveyor", "Mixer", "Hoist")},
}


def said(template: str, **values: Column) -> Column:
    """The template with its {names} filled in."""
    out, rest = [], template
    while rest:
        text, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [F.lit(text)] + ([values[name].cast("string")] if name else [])
    return F.concat(*out)


def each(n: Column, template: str, out: Column) -> Column:
    """The template for i from 1 to n."""
    return F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: said(template, i=i, out=out))


def formulas(family: str, c: dict[str, Column]) -> Column:
    """The invariants of a family (fixed values), from its parameters."""
    one = lambda *templates: F.array(*(said(t, **c) for t in templates))
    if family == "multi_guard":
        return F.concat(each(c["n"], "G(!G{i} -> !{out})", c["out"]), one("G(StopPB -> !{out})"))
    if family == "estop_bus":
        return F.concat(each(c["n"], "G(!E{i} -> !{out})", c["out"]), one("G(Stop -> !{out})"))
    if family == "safety_chain":
        return F.concat(each(c["a"], "G(!E{i} -> !{out})", c["out"]), each(c["b"], "G(!G{i} -> !{out})", c["out"]), one("G(Stop -> !{out})"))
    return one(*{
        "ondelay": ("G(!EStop -> !{out})", "G({out} -> StartCmd)"),
        "override_cutout": ("G({trip} -> !{out})", "G({out} -> Enable)", "G({out} -> Demand)"),
        "bounded_counter": ("G(Count <= {n})", "G({out} -> Count >= {n})"),
        "hysteresis": ("G(Level >= {high} -> !Actuator)",),
        "exclusive_two": ("G(!({a} & {b}))", "G({a} -> ReqA)", "G({b} -> ReqB)"),
        "bounded_updown": ("G(Count <= {n})", "G(Count >= 0)", "G({out} -> Count >= {n})"),
        "ordered_pair": ("G({b} -> {a})", "G(!EStop -> (!{a} & !{b}))", "G(Stop -> (!{a} & !{b}))"),
        "two_speed": ("G(!({out}Slow & {out}Fast))", "G(!EStop -> (!{out}Slow & !{out}Fast))", "G({out}Fast -> FastEnable)"),
    }[family])


# How ids are made, and which families are easy (the first two kinds with up to two channels only).
IDS = {
    "multi_guard": "GEN_mguard_{n}_{out}", "estop_bus": "GEN_estop_{n}_{out}", "ondelay": "GEN_ondelay_{n}_{out}", "override_cutout": "GEN_override_{out}_{trip}",
    "bounded_counter": "GEN_counter_{n}_{out}", "hysteresis": "GEN_hyst_{low}_{high}", "exclusive_two": "GEN_excl_{a}_{b}", "safety_chain": "GEN_chain_{a}e{b}g_{out}",
    "bounded_updown": "GEN_updown_{n}_{out}", "ordered_pair": "GEN_ordered_{a}_{b}", "two_speed": "GEN_twospeed_{out}",
}
EASY, EASY_UP_TO_TWO = ("override_cutout", "hysteresis", "exclusive_two"), ("multi_guard", "estop_bus")


def described(rows: DataFrame, family: str, *keys: str) -> DataFrame:
    """keys, family, id, difficulty and formulas of rows with a family's parameters as columns."""
    c = {k: F.col(k) for k in rows.columns}
    level = F.lit("easy") if family in EASY else F.when(c["n"] <= 2, "easy").otherwise("medium") if family in EASY_UP_TO_TWO else F.lit("medium")
    return rows.select(*keys, F.lit(family).alias("family"), said(IDS[family], **c).alias("id"), level.alias("difficulty"), formulas(family, c).alias("formulas"))


def family_rows(spark: SparkSession, family: str, grid: dict[str, tuple]) -> DataFrame:
    rows = spark.range(1).select(F.lit(family).alias("family"))
    for name, values in grid.items():
        if isinstance(values[0], tuple):
            picked = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in values))).alias("__pair")
            rows = rows.select("*", picked).select("*", "__pair.*").drop("__pair")
        else:
            rows = rows.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    if family == "hysteresis":
        rows = rows.filter("low < high - 10")
    return described(rows, family)


def scenarios(family: str, c: dict[str, Column]) -> Column:
    """Candidates of scenarios of a family, as an array of (scenario, steps): inputs and what is expected at each step, as ``name=value`` joined by commas."""
    step = lambda inputs, expect="": F.struct(inputs.alias("inputs") if isinstance(inputs, Column) else said(inputs, **c).alias("inputs"), said(expect, **c).alias("expect"))
    steps = lambda name, *own: F.struct(F.lit(name).alias("scenario"), F.array(*own).alias("steps"))
    longer = lambda name, own: F.struct(F.lit(name).alias("scenario"), own.alias("steps"))

    def inputs(head: str, *channels: tuple[str, str], off: str = "") -> Column:
        """The head, then a value for each channel: 1, but 0 for the first one of the kind that is off."""
        def flags(kind: str, n: str) -> Column:
            one = lambda i: F.concat(F.lit(f",{kind}"), i, F.when((i == 1) & F.lit(kind == off), "=0").otherwise("=1"))
            return F.array_join(F.transform(F.sequence(F.lit(1), c[n].cast("int")), one), "")

        return F.concat(F.lit(head), *(flags(*ch) for ch in channels))

    def guarded(start: str, stop: str, *channels: tuple[str, str], names: dict[str, str], with_stop: bool) -> Column:
        on = step(inputs(f"{start}=1,{stop}=0", *channels), "{out}=1")
        out = [steps("S_on", on)]
        if with_stop:
            out.append(steps("S_stop", on, step(inputs(f"{start}=1,{stop}=1", *channels), "{out}=0")))
        return F.array(*out, *(steps(names[k], on, step(inputs(f"{start}=1,{stop}=0", *channels, off=k), "{out}=0")) for k, _ in channels))

    def pulses(name: str, clear: str, up: str, down: str) -> Column:
        n = 2 * c["n"].cast("int")
        each = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.when(i % 2 == 1, up).otherwise(down).alias("inputs"), F.when(i == n, said("{out}=1", **c)).otherwise("").alias("expect")))
        return F.array(longer(name, F.concat(F.array(step(clear, "{out}=0")), each)))

    if family == "multi_guard":
        return guarded("StartPB", "StopPB", ("G", "n"), names={"G": "S_guard"}, with_stop=True)
    if family == "estop_bus":
        return guarded("Start", "Stop", ("E", "n"), names={"E": "S_estop"}, with_stop=True)
    if family == "safety_chain":
        return guarded("Start", "Stop", ("E", "a"), ("G", "b"), names={"E": "S_estop", "G": "S_guard"}, with_stop=False)
    if family == "ondelay":
        last = c["n"].cast("int") + 2
        held = F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(F.lit("StartCmd=1,EStop=1").alias("inputs"), F.when(i == last, said("{out}=1", **c)).otherwise("").alias("expect")))
        return F.array(longer("S_delay_on", held), steps("S_estop", step("StartCmd=1,EStop=0", "{out}=0")))
    if family == "override_cutout":
        on = step("Demand=1,Enable=1,{trip}=0", "{out}=1")
        return F.array(steps("S_on", on), steps("S_trip", on, step("Demand=1,Enable=1,{trip}=1", "{out}=0")))
    if family == "bounded_counter":
        return pulses("S_count", "Pulse=0,Reset=1", "Pulse=1,Reset=0", "Pulse=0,Reset=0")
    if family == "bounded_updown":
        return pulses("S_up", "Inc=0,Dec=0,Reset=1", "Inc=1,Dec=0,Reset=0", "Inc=0,Dec=0,Reset=0")
    if family == "exclusive_two":
        return F.array(steps("S_a", step("ReqA=1,ReqB=0", "{a}=1,{b}=0")), steps("S_b", step("ReqA=0,ReqB=1", "{a}=0,{b}=1")))
    if family == "hysteresis":
        low = step("Level={low}", "Actuator=1")
        return F.array(steps("S_low", low), steps("S_high", low, step("Level={high}", "Actuator=0")))
    if family == "ordered_pair":
        both = "Stop=0,EStop={e},StartA=1,StartB=1"
        return F.array(
            steps("S_seq", step("Stop=0,EStop=1,StartA=1,StartB=0", "{a}=1"), step(both.replace("{e}", "1"), "{a}=1,{b}=1")),
            steps("S_estop", step(both.replace("{e}", "1")), step(both.replace("{e}", "0"), "{a}=0,{b}=0")),
        )
    return F.array(
        steps("S_slow", step("EStop=1,ReqSlow=1,ReqFast=0,FastEnable=0", "{out}Slow=1,{out}Fast=0")), steps("S_fast", step("EStop=1,ReqSlow=0,ReqFast=1,FastEnable=1", "{out}Slow=0,{out}Fast=1"))
    )


def candidate_steps(rows: DataFrame, family: str, *keys: str) -> DataFrame:
    """keys, id, scenario, step, inputs, expect: a row for each step of each candidate, by lateral joins with the family's generator."""
    c = {k: F.col(k) for k in rows.columns}
    made = rows.select(*keys, said(IDS[family], **c).alias("id"), scenarios(family, c).alias("made"))
    tvf = rows.sparkSession.tvf
    each = made.lateralJoin(tvf.inline(F.col("made").outer())).lateralJoin(tvf.posexplode(F.col("steps").outer()))
    return each.select(*keys, "id", "scenario", F.col("pos").alias("step"), "col.inputs", "col.expect")


def grid(spark: SparkSession, families: dict[str, dict[str, tuple]]) -> DataFrame:
    """family, id, difficulty and formulas of every combination of parameters of the families."""
    out = None
    for family, own in families.items():
        rows = family_rows(spark, family, own)
        out = rows if out is None else out.unionByName(rows)
    return out
