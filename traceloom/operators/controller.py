"""Controllers as columns: one step function serves folds over traces and the search of all reachable states."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.functions.trace import Order, scans_of, stepped
from traceloom.sources.shared import stored

Env = dict[str, Column]


@dataclass(frozen=True)
class Controller:
    """inputs: name to (low, high), or None for a boolean. state: name to its initial value. step: inputs and state of before to the state
    of after, a column for each name. ranges: bounds of integers in the state; a value outside makes every verdict ``error``."""

    inputs: dict[str, tuple[int, int] | None]
    state: dict[str, bool | int]
    step: Callable[[Env], Env]
    ranges: dict[str, tuple[int, int]] = field(default_factory=dict)

    def kind(self, name: str) -> str:
        return "boolean" if isinstance(self.state.get(name), bool) or (name in self.inputs and self.inputs[name] is None) else "int"

    def initial(self) -> Column:
        return F.struct(*(F.lit(v).cast(self.kind(k)).alias(k) for k, v in self.state.items()))

    def after(self, env: Env) -> Column:
        new = self.step(env)
        return F.struct(*(new[k].cast(self.kind(k)).alias(k) for k in self.state))

    def fits(self, state: Column) -> Column:
        out = F.lit(True)
        for name, (low, high) in self.ranges.items():
            out = out & state[name].between(low, high)
        return out


def env(struct: Column, names) -> Env:
    return {k: struct[k] for k in names}


def run_traces(df: DataFrame, controller: Controller, order: Order) -> DataFrame:
    """One row per trace: its scans, and ``states``, the state after each. A fold in the JVM, for traces that fit a row."""
    packed = scans_of(df, order, *controller.inputs)
    kind = f"struct<{','.join(f'{k}:{controller.kind(k)}' for k in controller.state)}>"
    step = lambda scan, now: controller.after(env(scan, controller.inputs) | env(now, controller.state))
    return packed.withColumn("states", stepped(F.col("scans"), controller.initial(), step, kind))


def with_inputs(df: DataFrame, controller: Controller, name: str) -> DataFrame:
    """df with each combination of free inputs as a struct: nested explodes of the domains, so no join is needed."""
    picks = []
    for k, bounds in controller.inputs.items():
        domain = F.array(F.lit(False), F.lit(True)) if bounds is None else F.sequence(F.lit(bounds[0]), F.lit(bounds[1]))
        df = df.withColumn(f"__{k}", F.explode(domain))
        picks.append(f"__{k}")
    return df.withColumn(name, F.struct(*(F.col(p).alias(p[2:]) for p in picks))).drop(*picks)


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: a checkpoint would keep the constraints of its plan, which double each round."""
    return stored(df, "states")


def edges(states: DataFrame, controller: Controller) -> DataFrame:
    """states with every input (``input``) and the state it leads to (``next``)."""
    free = with_inputs(states, controller, "input")
    return free.withColumn("next", controller.after(env(F.col("input"), controller.inputs) | env(F.col("state"), controller.state)))


def reachable(spark: SparkSession, controller: Controller, max_rounds: int = 10_000) -> DataFrame:
    """All reachable states, with the round in which each is first met, its parent and the input that leads there.

    A breadth-first fixpoint: each round expands only the states that are new. States outside the ranges aren't expanded.
    """
    new = cut(spark.range(1).select(F.lit(0).alias("round"), controller.initial().alias("state"), F.lit(None).cast("int").alias("__none")))
    first = edges(new, controller)
    kinds = dict(first.dtypes)
    new = new.select("round", "state", F.lit(None).cast(kinds["state"]).alias("parent"), F.lit(None).cast(kinds["input"]).alias("input"))
    seen, parts = new, 1
    for n in range(1, max_rounds + 1):
        found = edges(new.filter(controller.fits(F.col("state"))).select("state"), controller)
        found = found.groupBy("next").agg(F.min(F.struct("state", "input")).alias("by"))
        found = found.join(seen.select(F.col("state").alias("next")), "next", "left_anti")
        new = cut(found.select(F.lit(n).alias("round"), F.col("next").alias("state"), F.col("by.state").alias("parent"), F.col("by.input").alias("input")))
        if new.isEmpty():
            return seen
        seen, parts = seen.unionByName(new), parts + 1
        if parts == 8:
            seen, parts = cut(seen.coalesce(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))), 1
    raise RuntimeError(f"states are still new after {max_rounds} rounds")


def check(spark: SparkSession, controller: Controller, always: dict[str, Callable[[Env], Column]], then: dict[str, Callable[[Env, Env], Column]] | None = None) -> DataFrame:
    """Verdicts of invariants: property, status (pass, fail, error), length (scans of a shortest counterexample), trace (its inputs).

    ``always``: G(p), on the inputs and the state after each scan. ``then``: G(p) where p looks at a scan and the next one.
    """
    states = cut(reachable(spark, controller))
    broken = not states.filter(~controller.fits(F.col("state"))).isEmpty()
    good = states.filter(controller.fits(F.col("state"))).select("round", "state")
    one = edges(good, controller)
    now = env(F.col("input"), controller.inputs) | env(F.col("next"), controller.state)
    hits = [one.filter(~p(now)).select(F.lit(k).alias("property"), "round", F.col("state").alias("at"), F.array("input").alias("tail")) for k, p in always.items()]
    if then:
        two = with_inputs(one, controller, "input2")
        after = controller.after(env(F.col("input2"), controller.inputs) | env(F.col("next"), controller.state))
        later = env(F.col("input2"), controller.inputs) | env(F.col("__after"), controller.state)
        two = two.withColumn("__after", after)
        hits += [two.filter(~p(now, later)).select(F.lit(k).alias("property"), "round", F.col("state").alias("at"), F.array("input", "input2").alias("tail")) for k, p in then.items()]
    found = hits[0]
    for h in hits[1:]:
        found = found.unionByName(h)
    found = cut(found.groupBy("property").agg(F.min(F.struct("round", "at", "tail")).alias("m")).select("property", "m.*"))
    # Back along the parents, one round at a time; there is one row per property.
    for n in range(found.agg(F.max("round")).first()[0] or 0, 0, -1):
        back = states.filter(F.col("round") == n).select(F.col("state").alias("at"), "parent", "input")
        walked = found.filter(F.col("round") == n).join(back, "at").select("property", F.lit(n - 1).alias("round"), F.col("parent").alias("at"), F.concat(F.array("input"), "tail").alias("tail"))
        found = cut(found.filter(F.col("round") < n).unionByName(walked))
    names = spark.createDataFrame([(k,) for k in [*always, *(then or {})]], "property string")
    status = F.when(F.lit(broken), "error").when(F.col("tail").isNotNull(), "fail").otherwise("pass")
    return names.join(found, "property", "left").select("property", status.alias("status"), F.size("tail").alias("length"), F.col("tail").alias("trace")).withColumn("length", F.when(F.col("status") == "fail", F.col("length")))


def vacuous(spark: SparkSession, controller: Controller, always: dict[str, Callable[[Env], Column]]) -> DataFrame:
    """Whether each property also holds for a controller whose state never leaves its initial value (all off), over all inputs."""
    free = with_inputs(spark.range(1).select(controller.initial().alias("state")), controller, "input")
    now = env(F.col("input"), controller.inputs) | env(F.col("state"), controller.state)
    wide = free.select(*(F.coalesce(p(now), F.lit(False)).alias(k) for k, p in always.items()))
    held = wide.agg(*(F.bool_and(F.col(f"`{k}`")).alias(k) for k in always))
    return held.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, always)), F.array(*(F.col(f"`{k}`") for k in always)))).alias("property", "vacuous"))
