"""Queries that were parts of others: pooled and overall rows, claims between two panels, scenario checks step by step, prompts, faults of records, names of files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from traceloom.functions import text as X
from traceloom.functions.metrics import pass_at_k
from traceloom.operators import mutation
from traceloom.plans import families, programs, verdicts
from traceloom.plans.verdicts import L, sql_pass
from traceloom.sources import records
from traceloom.sources.tables import table

K = 10


def verdict_inflation_pooled(spark, sf_dir):
    """Rates under a laxer and a stricter metric, their difference and ratio (null without a stricter success), by tier and pooled."""
    rows = verdicts.line_trials(spark, sf_dir).rollup("tier").agg(F.count("*").alias("n"), F.avg(F.col("invariant").cast("int")).alias("lax"), F.avg(F.col("valid").cast("int")).alias("strict"))
    return rows.select(F.coalesce("tier", F.lit("pooled")).alias("tier"), "n", F.round(F.col("lax") - F.col("strict"), 9).alias("difference"), F.round(F.try_divide("lax", "strict"), 9).alias("ratio"))


def verdict_seed_table(spark, sf_dir):
    """Mean and population deviation over seeds of macro pass@k, for each stage (metric), by tier and over all."""
    per = verdicts.line_trials(spark, sf_dir).groupBy("seed", "tier", "task").agg(F.count("*").alias("n"), F.count_if("invariant").alias("invariant"), F.count_if("valid").alias("valid"))
    staged = per.unpivot(["seed", "tier", "task", "n"], ["invariant", "valid"], "stage", "c").withColumns({f"k{k}": pass_at_k(F.col("n"), F.col("c"), k) for k in (1, 5)})
    runs = staged.groupingSets([[F.col("stage"), F.col("seed"), F.col("tier")], [F.col("stage"), F.col("seed")]], "stage", "seed", "tier").agg(F.avg("k1").alias("k1"), F.avg("k5").alias("k5"))
    both = [a for k in ("k1", "k5") for a in (F.round(F.avg(k), 4).alias(f"{k}_mean"), F.round(F.stddev_pop(k), 4).alias(f"{k}_std"))]
    return runs.groupBy("stage", F.coalesce("tier", F.lit("overall")).alias("tier")).agg(F.count("*").alias("n"), *both)


def panels(spark, sf_dir):
    """Macro pass@1 and pass@K of each model (nation) by tier (order priority) and over all, of an earlier and a later panel (orders before 1995 and from then on)."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.substring("o_orderpriority", 1, 1).alias("tier"), F.when(F.year("o_orderdate") < 1995, "early").otherwise("late").alias("panel"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", ((F.col("l_returnflag") != "R") & (F.col("l_linestatus") == "F") | (F.col("l_discount") < 0.02)).alias("ok"))
    people = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("model"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(people, F.col("o_custkey") == F.col("c_custkey"))
    per = rows.groupBy("panel", "model", "tier", (F.col("l_partkey") % 40).alias("task")).agg(F.count("*").alias("n"), F.count_if("ok").alias("c"))
    p1, pk = F.avg(pass_at_k(F.col("n"), F.col("c"), 1)), F.avg(pass_at_k(F.col("n"), F.col("c"), K))
    out = per.groupingSets([[F.col("panel"), F.col("model"), F.col("tier")], [F.col("panel"), F.col("model")]], "panel", "model", "tier").agg(F.round(p1, 9).alias("p1"), F.round(pk, 9).alias("pk"))
    return out.withColumn("tier", F.coalesce("tier", F.lit("all")))


def verdict_panel_claims(spark, sf_dir):
    """Claims of an earlier panel held against a later one, for each model: its rank and whether it is kept, tiers that were a wall (no success at any k) and
    whether they still are, whether it climbs with k at least half as much, and whether the first tier is at least as good as the second."""
    rows = panels(spark, sf_dir)
    wide = rows.groupBy("model").pivot("panel", ["early", "late"])
    by = {name: F.first(F.when(F.col("tier") == t, F.col(c)), ignorenulls=True).alias(name) for name, t, c in (("p1", "all", "p1"), ("pk", "all", "pk"), ("t1", "1", "p1"), ("t2", "2", "p1"))}
    walls = F.array_sort(F.collect_set(F.when((F.col("tier") != "all") & (F.col("p1") == 0) & (F.col("pk") == 0), F.col("tier")))).alias("walls")
    one = wide.agg(*by.values(), walls)
    rank = lambda p: F.row_number().over(Window.orderBy(F.desc(f"{p}_p1"), "model"))  # noqa: E731  a row a model
    gain = lambda p: F.col(f"{p}_pk") - F.col(f"{p}_p1")
    return one.select(
        "model", rank("early").alias("rank_early"), rank("late").alias("rank_late"), (rank("early") == rank("late")).alias("rank_kept"), F.array_join("early_walls", ",").alias("walls_early"),
        (F.size(F.array_except("early_walls", "late_walls")) == 0).alias("walls_hold"), F.round(gain("early"), 6).alias("gain_early"), F.round(gain("late"), 6).alias("gain_late"),
        (gain("late") * 2 >= gain("early")).alias("climbs_on"), (F.col("late_t1") >= F.col("late_t2")).alias("first_tier_leads"),
    )


def program_bugs_distinct(spark, sf_dir):
    """Distinct bugs of each program that are not the program itself, each with the first rule that makes it."""
    rows = mutation.first_bugs(programs.parts(spark, sf_dir))
    names = ("weaken_or", "flip_compare", "force_true")
    each = rows.select("id", "code", F.posexplode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("bug")) for n in names))).alias("pos", "b")).select("id", "code", "pos", "b.*")
    kept = each.filter("bug is not null and bug <> code").groupBy("id", F.sha1(F.col("bug").cast("binary")).alias("digest")).agg(F.min_by("rule", "pos").alias("rule"), F.count("*").alias("n_rules"))
    return kept.select("id", "rule", "n_rules", "digest")


def report_flipped_tasks(spark, sf_dir):
    """All seeds of the tasks for which any seed flips, that is, has a verdict other than the task's first seed (a semi join)."""
    per = verdicts.line_trials(spark, sf_dir).groupBy("task", "seed").agg((F.avg(F.col("valid").cast("int")) >= 0.25).alias("ok"), F.count("*").alias("n"))
    first = per.groupBy("task").agg(F.min_by("ok", "seed").alias("first"))
    flips = per.join(first, "task").filter(F.col("ok") != F.col("first")).select("task")
    return per.join(flips, "task", "left_semi")


def data_property_texts(spark, sf_dir):
    """Results of properties with the texts of the properties (an inner join; results of unknown properties are left out)."""
    results = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("property_id"), (F.col("l_returnflag") != "R").alias("ok"))
    texts = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("property_id"), F.concat(F.lit("must hold: "), F.lower("s_name")).alias("text"))
    return results.join(texts, "property_id").groupBy("property_id", "text").agg(F.count("*").alias("n"), F.count_if("ok").alias("held"))


def played(spark, sf_dir):
    """Steps of the scenarios of guarded starts, with the output that a controller shows after each; that of every third part forgets its first guard.

    Inputs and expectations come as rows and are taken apart by name; the output holds from a start until a stop or an open guard.
    """
    steps = families.of_families(spark, sf_dir, ("multi_guard", "estop_bus", "safety_chain"), lambda rows, f: families.grids.candidate_steps(rows, f, "p_partkey"))
    pairs = F.str_to_map("inputs", F.lit(","), F.lit("="))
    start, stop = F.coalesce(F.try_element_at(pairs, F.lit("StartPB")), F.try_element_at(pairs, F.lit("Start"))), F.coalesce(F.try_element_at(pairs, F.lit("StopPB")), F.try_element_at(pairs, F.lit("Stop")))
    guards = F.map_filter(pairs, lambda k, v: ~k.startswith("St"))
    seen = F.when(F.col("p_partkey") % 3 == 0, F.map_filter(guards, lambda k, v: ~k.isin("G1", "E1"))).otherwise(guards)
    open_ = F.exists(F.map_values(seen), lambda v: v == "0")
    signals = steps.withColumns({"on": start == "1", "off": (stop == "1") | open_})
    w = Window.partitionBy("p_partkey", "scenario").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.coalesce(F.last(F.when(F.col("off"), False).when(F.col("on"), True), ignorenulls=True).over(w), F.lit(False))
    return signals.withColumn("actual", held.cast("int")).withColumn("wanted", F.split_part("expect", F.lit("="), F.lit(2)).cast("int"))


def scenario_check(spark, sf_dir):
    """Each scenario played and compared step by step with what it expects: whether it passes, its first step that doesn't, and what was expected and shown there."""
    rows = played(spark, sf_dir)
    wrong = F.col("wanted").isNotNull() & (F.col("wanted") != F.col("actual"))
    per = rows.groupBy("p_partkey", "id", "scenario").agg(F.count("*").alias("steps"), F.min(F.when(wrong, F.struct("step", "wanted", "actual"))).alias("first"))
    return per.select("p_partkey", "id", "scenario", "steps", F.col("first").isNull().alias("passes"), F.col("first.step").alias("step"), F.col("first.wanted").alias("wanted"), F.col("first.actual").alias("actual"))


def scenario_inputs(spark, sf_dir):
    """Input sequences of the parts' tasks in order; a task whose scenarios are withheld (every fifth size) has one step with all inputs low."""
    steps = families.grid_scenarios(spark, sf_dir)
    names = F.array_join(F.transform(F.split("inputs", ","), lambda p: F.concat(F.split_part(p, F.lit("="), F.lit(1)), F.lit("=0"))), ",")
    low = steps.groupBy("p_partkey", "id").agg(F.min(F.struct("scenario", "step", names.alias("inputs"))).alias("m")).select("p_partkey", "id", F.col("m.inputs").alias("inputs"))
    held = table(spark, sf_dir, "part").filter("p_size % 5 = 0").select("p_partkey")
    given = steps.join(held, "p_partkey", "left_anti").select("p_partkey", "id", "scenario", "step", "inputs")
    return given.unionByName(low.join(held, "p_partkey", "left_semi").select("p_partkey", "id", F.lit("low").alias("scenario"), F.lit(0).alias("step"), "inputs"))


INTERFACE = "array<struct<name:string,type:string,direction:string,description:string,range:array<double>>>"
PROPERTIES = "array<struct<id:string,kind:string,nl:string,ltl:string,ctl:string,severity:string>>"
SUFFIX = "\nKeep to these blocks only: TON."


def part_records(spark, sf_dir):
    """A task record for each part; some with faults: no id, a level nobody knows, no properties, a range with one bound, an unknown severity, kind or name."""
    k, none = F.col("p_partkey"), F.lit(None)
    out = F.struct(F.lit("q").alias("name"), F.lit("BOOL").alias("type"), F.lit("output").alias("direction"), F.col("p_name").alias("description"), none.cast("array<double>").alias("range"))
    bounds = F.when(k % 17 == 3, F.array(F.lit(1.0))).otherwise(F.array(F.lit(0.0), F.col("p_size").cast("double")))
    level = F.struct(F.lit("n").alias("name"), F.lit("INT").alias("type"), F.lit("input").alias("direction"), F.col("p_brand").alias("description"), bounds.alias("range"))
    rule = F.struct(
        F.lit("P1").alias("id"), F.when(k % 13 == 5, "wish").otherwise("safety").alias("kind"), F.lit("stays low").alias("nl"), F.when(k % 19 == 7, "G(n > 3 -> !other)").when(k % 19 == 8, " ").otherwise("G(n > 3 -> !q)").alias("ltl"),
        none.cast("string").alias("ctl"), F.when(k % 11 == 2, "odd").when(k % 11 == 4, none.cast("string")).otherwise("high").alias("severity"),
    )
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.when(k % 23 != 1, F.concat(F.lit("T"), k)).alias("id"), F.when(k % 7 == 6, "odd").otherwise("easy").alias("difficulty"),
        F.array(out, level).cast(INTERFACE).alias("interface"), F.when(k % 29 == 4, F.array().cast(PROPERTIES)).otherwise(F.array(rule)).alias("safety_properties"),
    )


def record_faults(spark, sf_dir):
    """Faults of the parts' task records, and how many parts have each."""
    return records.task_faults(part_records(spark, sf_dir)).groupBy("fault").agg(F.count("*").alias("n"), F.count("id").alias("with_id"))


def program_prompts(spark, sf_dir):
    """What is asked for each part: spec, interface with ranges and rules, alone and with a block of constraints, as digests, with the lengths."""
    rules = F.array(F.lit("One program."), F.concat(F.lit("Brand "), F.col("p_brand")))
    rows = part_records(spark, sf_dir).join(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand"), "p_partkey").withColumn("prompt", X.task_prompt(F.col("p_type"), F.col("interface"), rules))
    digest = lambda c: F.sha1(c.cast("binary"))
    return rows.select("p_partkey", F.length("prompt").alias("n"), digest(F.col("prompt")).alias("plain"), digest(X.constrained(F.col("prompt"), SUFFIX)).alias("constrained"))


def report_file_names(spark, sf_dir):
    """Specs of models (segment and nation of customers) as names of files and of reports."""
    spec = F.concat(F.lower("c_mktsegment"), F.lit(":"), F.lit("org/"), F.col("c_nationkey"))
    rows = table(spark, sf_dir, "customer").select(spec.alias("spec")).groupBy("spec").agg(F.count("*").alias("n"))
    return rows.select("spec", "n", X.file_name(F.col("spec")).alias("file"), X.display_name(F.col("spec")).alias("shown"))


PANELS = f"""o AS (SELECT o_orderkey, c_nationkey AS model, o_orderpriority[1] AS tier, CASE WHEN year(o_orderdate) < 1995 THEN 'early' ELSE 'late' END AS panel FROM orders JOIN customer ON o_custkey = c_custkey),
    t AS (SELECT panel, model, tier, l_partkey % 40 AS task, count(*) AS n, count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'F' OR l_discount < CAST(0.02 AS DOUBLE)) AS c
          FROM lineitem JOIN o ON l_orderkey = o_orderkey GROUP BY ALL),
    p AS (SELECT panel, model, coalesce(tier, 'all') AS tier, round(avg({sql_pass('n', 'c', 1)}), 9) AS p1, round(avg({sql_pass('n', 'c', K)}), 9) AS pk FROM t GROUP BY GROUPING SETS ((panel, model, tier), (panel, model)))"""
SIDE = """SELECT model, max(p1) FILTER (tier = 'all') AS p1, max(pk) FILTER (tier = 'all') AS pk, max(p1) FILTER (tier = '1') AS t1, max(p1) FILTER (tier = '2') AS t2,
    coalesce(list(tier ORDER BY tier) FILTER (tier <> 'all' AND p1 = 0 AND pk = 0), []) AS walls FROM p WHERE panel = '{panel}' GROUP BY 1"""
PLAYED = f"""st AS (SELECT p_partkey, id, s.scenario AS scenario, unnest(s.steps) AS t, unnest(range(len(s.steps))) AS step FROM ({families.SCENARIOS}) WHERE p_partkey % {len(families.ALL)} IN ({', '.join(str(i) for i, f in enumerate(families.ALL) if f in ('multi_guard', 'estop_bus', 'safety_chain'))})),
    sg AS (SELECT p_partkey, id, scenario, step, t.expect AS expect, regexp_matches(t.inputs, 'Start(PB)?=1') AS on_,
        regexp_matches(t.inputs, 'Stop(PB)?=1') OR regexp_matches(t.inputs, CASE WHEN p_partkey % 3 = 0 THEN ',[EG]([2-9]|1[0-9]+)=0' ELSE ',[EG][0-9]+=0' END) AS off_ FROM st),
    pl AS (SELECT *, CAST(coalesce(last_value(CASE WHEN off_ THEN 0 WHEN on_ THEN 1 END IGNORE NULLS) OVER (PARTITION BY p_partkey, scenario ORDER BY step), 0) AS INTEGER) AS actual,
        TRY_CAST(split_part(expect, '=', 2) AS INTEGER) AS wanted FROM sg)"""
FAULTY = """r AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 23 <> 1 THEN 'T' || p_partkey END AS id FROM part),
    f AS (SELECT k, id, unnest(list_filter([CASE WHEN id IS NULL THEN 'no id' END, CASE WHEN k % 7 = 6 THEN 'unknown difficulty' END, CASE WHEN k % 29 = 4 THEN 'no properties' END, CASE WHEN k % 17 = 3 THEN 'range without two bounds' END,
        CASE WHEN k % 29 <> 4 AND k % 11 = 2 THEN 'unknown severity' END, CASE WHEN k % 29 <> 4 AND k % 13 = 5 THEN 'unknown kind' END, CASE WHEN k % 29 <> 4 AND k % 19 = 7 THEN 'formula with an unknown name' END,
        CASE WHEN k % 29 <> 4 AND k % 19 = 8 THEN 'property without a formula' END], lambda x: x IS NOT NULL)) AS fault FROM r)"""
BOUND = "CASE WHEN p_partkey % 17 = 3 THEN '1.0' ELSE '0.0, ' || CAST(p_size AS VARCHAR) || '.0' END"
PROMPT = f"""'REQUIREMENT:' || chr(10) || p_type || chr(10) || chr(10) || 'INTERFACE (use exactly these names and directions):' || chr(10) || '  - q : BOOL [output] - ' || p_name || chr(10)
    || '  - n : INT [input, range [' || {BOUND} || ']] - ' || p_brand || chr(10) || chr(10) || 'RULES:' || chr(10) || '- One program.' || chr(10) || '- Brand ' || p_brand"""

ORACLE_SQL = {
    "verdict_inflation_pooled": f"""WITH {L}, r AS (SELECT coalesce(tier, 'pooled') AS tier, count(*) AS n, avg(CAST(invariant AS INTEGER)) AS lax, avg(CAST(valid AS INTEGER)) AS strict FROM t GROUP BY ROLLUP (tier))
        SELECT tier, n, round(lax - strict, 9) AS difference, round(CASE WHEN strict > 0 THEN lax / strict END, 9) AS ratio FROM r""",
    "verdict_seed_table": f"""WITH {L}, g AS (SELECT seed, tier, task, count(*) AS n, count(*) FILTER (invariant) AS a, count(*) FILTER (valid) AS b FROM t GROUP BY ALL),
        u AS (SELECT seed, tier, n, unnest(['invariant', 'valid']) AS stage, unnest([a, b]) AS c FROM g),
        k AS (SELECT stage, seed, tier, avg({sql_pass('n', 'c', 1)}) AS k1, avg({sql_pass('n', 'c', 5)}) AS k5 FROM u GROUP BY GROUPING SETS ((stage, seed, tier), (stage, seed)))
        SELECT stage, coalesce(tier, 'overall') AS tier, count(*) AS n, round(avg(k1), 4) AS k1_mean, round(stddev_pop(k1), 4) AS k1_std, round(avg(k5), 4) AS k5_mean, round(stddev_pop(k5), 4) AS k5_std FROM k GROUP BY 1, 2""",
    "verdict_panel_claims": f"""WITH {PANELS}, e AS ({SIDE.format(panel='early')}), l AS ({SIDE.format(panel='late')}),
        j AS (SELECT coalesce(e.model, l.model) AS model, e.p1 AS a1, e.pk AS ak, coalesce(e.walls, []) AS aw, l.p1 AS b1, l.pk AS bk, l.t1, l.t2, coalesce(l.walls, []) AS bw FROM e FULL JOIN l ON e.model = l.model),
        q AS (SELECT *, CAST(row_number() OVER (ORDER BY a1 DESC NULLS LAST, model) AS INTEGER) AS ra, CAST(row_number() OVER (ORDER BY b1 DESC NULLS LAST, model) AS INTEGER) AS rb FROM j)
        SELECT model, ra AS rank_early, rb AS rank_late, ra = rb AS rank_kept, array_to_string(aw, ',') AS walls_early, len(list_filter(aw, lambda x: NOT list_contains(bw, x))) = 0 AS walls_hold,
               round(ak - a1, 6) AS gain_early, round(bk - b1, 6) AS gain_late, (bk - b1) * 2 >= ak - a1 AS climbs_on, t1 >= t2 AS first_tier_leads FROM q""",
    "program_bugs_distinct": f"""WITH {programs.P}, {programs.BUGS}, b AS (SELECT id, unnest([weaken_or, flip_compare, force_true]) AS bug, unnest(['weaken_or', 'flip_compare', 'force_true']) AS rule, unnest([1, 2, 3]) AS pos FROM e),
        k AS (SELECT b.* FROM b JOIN p USING (id) WHERE bug IS NOT NULL AND bug <> code)
        SELECT id, min_by(rule, pos) AS rule, count(*) AS n_rules, sha1(bug) AS digest FROM k GROUP BY id, bug""",
    "report_flipped_tasks": f"""WITH {L}, p AS (SELECT task, seed, avg(CAST(valid AS INTEGER)) >= 0.25 AS ok, count(*) AS n FROM t GROUP BY 1, 2),
        f AS (SELECT *, first_value(ok) OVER (PARTITION BY task ORDER BY seed) AS first FROM p)
        SELECT task, seed, ok, n FROM p WHERE task IN (SELECT task FROM f WHERE ok <> first)""",
    "data_property_texts": """SELECT l_suppkey AS property_id, 'must hold: ' || lower(s_name) AS text, count(*) AS n, count(*) FILTER (l_returnflag <> 'R') AS held
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 0 GROUP BY 1, 2""",
    "scenario_check": f"""WITH {PLAYED}, m AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, scenario, wanted IS NOT NULL AND wanted <> actual ORDER BY step) AS i FROM pl)
        SELECT p_partkey, id, scenario, count(*) AS steps, count(*) FILTER (wanted <> actual) = 0 AS passes, CAST(min(step) FILTER (wanted <> actual) AS INTEGER) AS step,
               max(wanted) FILTER (wanted <> actual AND i = 1) AS wanted, max(actual) FILTER (wanted <> actual AND i = 1) AS actual FROM m GROUP BY 1, 2, 3""",
    "scenario_inputs": f"""WITH e AS (SELECT p_partkey, id, s.scenario AS scenario, unnest(s.steps) AS t, unnest(range(len(s.steps))) AS step FROM ({families.SCENARIOS})),
        w AS (SELECT p_partkey FROM part WHERE p_size % 5 = 0)
        SELECT p_partkey, id, scenario, CAST(step AS INTEGER) AS step, t.inputs AS inputs FROM e WHERE p_partkey NOT IN (FROM w)
        UNION ALL SELECT p_partkey, id, 'low', 0, regexp_replace(t.inputs, '=[0-9]+', '=0', 'g') FROM e WHERE p_partkey IN (FROM w) QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY scenario, step) = 1""",
    "record_faults": f"WITH {FAULTY} SELECT fault, count(*) AS n, count(id) AS with_id FROM f GROUP BY 1",
    "program_prompts": f"""WITH p AS (SELECT p_partkey, {PROMPT} AS prompt FROM part)
        SELECT p_partkey, CAST(length(prompt) AS INTEGER) AS n, sha1(prompt) AS plain, sha1(prompt || chr(10) || '{SUFFIX[1:]}') AS constrained FROM p""",
    "report_file_names": """WITH s AS (SELECT lower(c_mktsegment) || ':org/' || c_nationkey AS spec, count(*) AS n FROM customer GROUP BY 1)
        SELECT spec, n, replace(replace(spec, ':', '_'), '/', '_') || '.json' AS file, string_split(string_split(spec, ':')[-1], '/')[-1] || ' (' || string_split(spec, ':')[1] || ')' AS shown FROM s""",
}
QUERIES = {k: globals()[k] for k in ORACLE_SQL}
