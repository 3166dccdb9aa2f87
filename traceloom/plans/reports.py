"""Reports and audits over stored verdicts: evaluation summaries, pools, matched seeds, boundary flips, cells, activity, scenarios and template grids."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from traceloom.functions import text as X
from traceloom.functions.metrics import pass_at_k, reward
from traceloom.operators import mutation
from traceloom.plans import programs, traces, verdicts
from traceloom.sources.records import matrix_lines
from traceloom.sources.tables import table


def panel(spark, sf_dir):
    """Labelled documents as samples of a panel, with faults of every kind: each field stands for what a tool stored."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    i = F.col("doc_id")
    first, second = F.when(F.col("toxic") == 0, "pass").otherwise("fail"), F.when(i % 29 == 0, "error").when(F.col("quality") == 1, "pass").otherwise("unknown")
    return rows.select(
        "doc_id", F.col("source").alias("task_id"), F.col("lang").alias("tier"), F.col("text").alias("code"), F.when(i % 37 == 0, "timed out").alias("error"),
        (F.col("n_chars") >= 50).alias("parsed"), F.when(i % 41 != 0, F.col("n_chars") >= 200).alias("compiles"), (i % 31 != 0).alias("available"), F.array(first, second).alias("statuses"),
        (i % 4).alias("scenarios_total"), F.when(F.col("quality") == 1, i % 4).otherwise(F.floor((i % 4) / 2)).alias("scenarios_pass"),
    )


def categorised(rows):
    name = X.outcome(F.col("parsed"), F.col("compiles"), F.col("available"), F.col("statuses"))
    return rows.withColumn("category", F.when(F.col("error").isNotNull(), "api_error").otherwise(name))


def report_evaluation(spark, sf_dir):
    """The summary of an evaluation, by task: outcomes as shares of all samples, properties and scenarios of those without an error, and the verified
    share of these alone."""
    rows = categorised(panel(spark, sf_dir))
    fine = F.col("error").isNull()
    share = lambda c: F.round(F.count_if(F.col("category") == c) / F.count("*"), 9).alias(f"{c}_rate")
    held, total = F.size(F.filter("statuses", lambda s: s == "pass")), F.size("statuses")
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(F.sum(F.when(fine, a)), F.sum(F.when(fine, b))), F.lit(0.0)), 9)
    return rows.groupBy("task_id").agg(
        F.count("*").alias("tasks"), F.count_if(~fine).alias("api_errors"), *map(share, ("verified", "unsafe", "parse_error", "compile_error", "translate_error")),
        ratio(held, total).alias("property_pass_rate"), ratio(F.col("scenarios_pass"), F.col("scenarios_total")).alias("scenario_pass_rate"),
        F.round(F.coalesce(F.try_divide(F.count_if(F.col("category") == "verified").cast("double"), F.count_if(fine)), F.lit(0.0)), 9).alias("verified_of_fine"),
    )


def report_outcomes(spark, sf_dir):
    """Samples by tier and outcome, all seven and errors of the interface apart."""
    return categorised(panel(spark, sf_dir)).groupBy("tier", "category").agg(F.count("*").alias("n"))


def report_statuses(spark, sf_dir):
    """What each tool said, one by one, and the four verdicts of a sample; one without code has none."""
    rows = panel(spark, sf_dir)
    empty, held = F.coalesce(F.trim("code"), F.lit("")) == "", F.forall("statuses", lambda s: s == "pass")
    good = F.coalesce(F.col("compiles"), F.lit(False)) & ~empty
    scenario = (F.col("scenarios_total") > 0) & (F.col("scenarios_pass") == F.col("scenarios_total")) & ~empty
    return rows.select(
        "doc_id", F.when(empty, "not_found").otherwise("found").alias("extraction"), F.when(F.col("compiles").isNull(), "n/a").when(F.col("compiles"), "accepted").otherwise("rejected").alias("compiler"),
        F.when(~F.col("available"), "n/a").otherwise("supported").alias("translator"), F.when(~F.col("available"), "not_run").when(held, "all_hold").otherwise("some_fail").alias("checker"),
        empty.alias("empty"), good.alias("compile"), (good & held).alias("invariant"), scenario.alias("scenario"), (good & held & scenario).alias("valid"),
    )


def report_corpus(spark, sf_dir):
    """Tasks (suppliers) by tier (region) with their properties (lines) and multi-scenario tasks, and over all."""
    places = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"), F.count_distinct("l_linenumber").alias("scenarios"))
    rows = places.join(n, "s_suppkey", "left")
    out = rows.rollup("r_name").agg(F.count("*").alias("tasks"), F.coalesce(F.sum("n"), F.lit(0)).alias("properties"), F.count_if(F.col("scenarios") >= 2).alias("multi"), F.count_distinct("n_name").alias("domains"))
    return out.select(F.coalesce("r_name", F.lit("all")).alias("tier"), "tasks", "properties", "multi", "domains")


def pool(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select("doc_id", "lang", (F.col("n_chars") >= 200).alias("compile"), (F.col("toxic") == 0).alias("invariant"), (F.col("quality") == 1).alias("scenario"))


def report_pool(spark, sf_dir):
    """Composition of a pool and of what it rejects, by language and over all."""
    c, i, s = (F.col(x) for x in ("compile", "invariant", "scenario"))
    rows = pool(spark, sf_dir).rollup("lang").agg(
        F.count("*").alias("total"), F.count_if(c).alias("compile_pass"), F.count_if(i).alias("invariant_pass"), F.count_if(s).alias("scenario_pass"), F.count_if(c & i).alias("dual_pass"),
        F.count_if(c & i & s).alias("taskvalid_pass"), F.count_if(~(c & i)).alias("reject_total"), F.count_if(~c & i).alias("reject_compile_only"), F.count_if(c & ~i).alias("reject_invariant_only"),
        F.count_if(~c & ~i).alias("reject_both"), F.round(F.count_if(~(c & i)) / F.count("*"), 9).alias("reject_rate"), F.grouping("lang").alias("g"),
    )
    return rows.withColumn("lang", F.when(F.col("g") == 1, "all").otherwise(F.col("lang"))).drop("g")


def placed(rows, key: str, seed: str):
    """rows with ``place`` from 1 in a shuffle that the seed fixes. Places come from counts of hash ranges, not from one sorted task."""
    hashed = rows.withColumn("__h", F.md5(F.concat_ws(":", F.lit(seed), F.col(key)).cast("binary"))).withColumn("__b", F.substring("__h", 1, 3))
    w = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = hashed.groupBy("__b").agg(F.count("*").alias("n")).select("__b", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))  # 4,096 rows at most
    own = F.row_number().over(Window.partitionBy("__b").orderBy("__h", key))
    return hashed.withColumn("own", own).join(F.broadcast(before), "__b").withColumn("place", (F.col("before") + F.col("own")).cast("long")).drop("__b", "__h", "own", "before")


def data_subsets(spark, sf_dir):
    """Members of the four filtered subsets of a pool and of a random one as large as the strictest."""
    rows = pool(spark, sf_dir)
    size = rows.agg(F.count_if(F.col("compile") & F.col("invariant")).alias("size"))
    c, i = F.col("compile"), F.col("invariant")
    names = F.array(F.lit("all"), F.when(c, "matiec_only"), F.when(i, "property_only"), F.when(c & i, "dual"))
    random = placed(rows.select("doc_id"), "doc_id", "0").crossJoin(F.broadcast(size)).filter("place <= size").select(F.lit("random_sizematched").alias("subset"), "doc_id")
    return rows.select(F.explode(F.array_compact(names)).alias("subset"), "doc_id").unionByName(random)


def set_shuffled(spark, sf_dir):
    """The first 40 customers with money in a seeded shuffle: filtered, shuffled, then cut."""
    rows = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey", "c_name")
    return placed(rows, "c_custkey", "7").filter("place <= 40")


def set_either_way_prefix(spark, sf_dir):
    """Sample ids to task ids where one begins as the other, first in load order: an equi join over the beginnings of both, for what has no exact match."""
    ids = F.concat(F.lit("Supplier#"), F.lpad((F.col("p_partkey") % 120).cast("string"), 9, "0"), F.lit("_x"))
    samples = table(spark, sf_dir, "part").select("p_partkey", F.substring(ids, F.lit(1), (F.col("p_size") % 11 + 10).cast("int")).alias("k"))
    tasks = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("t"))
    begin = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.length(c)), lambda n: F.substring(F.col(c), F.lit(1), n)))
    units = samples.select("k").distinct()
    exact = units.join(tasks, F.col("k") == F.col("t")).select("k", "s_suppkey")
    rest = units.join(exact, "k", "left_anti")
    longer = rest.select("k", F.col("k").alias("p")).join(tasks.select("s_suppkey", begin("t").alias("p")), "p").select("k", "s_suppkey")
    shorter = rest.select("k", begin("k").alias("p")).join(tasks.select("s_suppkey", F.col("t").alias("p")), "p").select("k", "s_suppkey")
    found = exact.unionByName(longer).unionByName(shorter).groupBy("k").agg(F.min("s_suppkey").alias("task"))
    return samples.join(found, "k", "left").select("p_partkey", "k", "task")


def audit_stored(spark, sf_dir):
    """Stored verdicts against recomputed ones, by tier; null counts as a verdict of its own."""
    rows = panel(spark, sf_dir)
    stored, again = F.col("compiles"), F.when(F.col("doc_id") % 43 != 0, F.length("code") >= 200)
    held, new = F.forall("statuses", lambda s: s == "pass"), F.array_contains("statuses", "pass") & (F.col("doc_id") % 5 != 0)
    return rows.groupBy("tier").agg(F.count("*").alias("checked"), F.count_if(~stored.eqNullSafe(again)).alias("compile_flips"), F.count_if(~held.eqNullSafe(new)).alias("invariant_flips"))


def audit_published(spark, sf_dir):
    """Computed means against published figures, within 0.006."""
    per = verdicts.counts(verdicts.line_trials(spark, sf_dir), "task", "tier")
    means = per.groupBy("tier").agg(*(F.avg(pass_at_k(F.col("n"), F.col(c), 1)).alias(c) for c in ("c_invariant", "c_valid"))).unpivot(["tier"], ["c_invariant", "c_valid"], "metric", "computed")
    published = F.round("computed", 2) + F.when(F.col("tier").startswith("A"), 0.01).otherwise(0.0)
    rows = means.withColumn("published", F.round(published, 2))
    delta = F.col("computed") - F.col("published")
    return rows.select("tier", "metric", F.round("computed", 9).alias("computed"), "published", F.round(delta, 9).alias("delta"), (F.abs(delta) <= 0.006).alias("match"))


def units(spark, sf_dir):
    """Samples with two legs of verdicts each, stored by task and digest of the code; copies of a text are one unit."""
    rows = panel(spark, sf_dir).select("doc_id", "task_id", "tier", "compiles", "code", X.short_digest(F.col("code")).alias("digest"))
    n = F.length("code")
    pick = lambda m, *names: F.element_at(F.array(*map(F.lit, names)), (F.pmod(n, F.lit(m)) + 1).cast("int"))
    scored = rows.select("task_id", "digest", "code").dropDuplicates(["task_id", "digest"]).select(
        "task_id", "digest", pick(3, "pass", "fail", "pass").alias("inv_std"), pick(5, "pass", "fail", "error", "pass", "pass").alias("inv_var"),
        pick(4, "pass", "fail", "no_scenarios", "pass").alias("scen_std"), pick(7, "pass", "pass", "fail", "no_scenarios", "error", "pass", "fail").alias("scen_var"),
    )
    return rows.drop("code"), scored


def flips():
    """Whether the two legs of a unit can be compared and differ: invariant, scenario, all checks."""
    clean = lambda a, b, *more: F.col(a).isin("pass", "fail", *more) & F.col(b).isin("pass", "fail", *more)
    fine = lambda c: F.col(c).isin("pass", "no_scenarios")
    ok = F.coalesce(F.col("compiles"), F.lit(False))
    one, other = ok & (F.col("inv_std") == "pass") & fine("scen_std"), ok & (F.col("inv_var") == "pass") & fine("scen_var")
    inv = clean("inv_std", "inv_var") & (F.col("inv_std") != F.col("inv_var"))
    return inv, clean("scen_std", "scen_var") & (F.col("scen_std") != F.col("scen_var")), clean("inv_std", "inv_var") & clean("scen_std", "scen_var", "no_scenarios") & (one != other)


def audit_boundary(spark, sf_dir):
    """Flips of verdicts between two readings of a boundary, by tier; each distinct unit is scored once and joined back.
    Verdicts are stand-ins: lengths of texts modulo small numbers."""
    rows, scored = units(spark, sf_dir)
    inv, scen, valid = flips()
    known = lambda a, b, *more: ~(F.col(a).isin("pass", "fail", *more) & F.col(b).isin("pass", "fail", *more))
    alone = (F.col("scen_std") == "no_scenarios") | ((F.col("scen_std").isin("pass", "fail")) & F.col("scen_var").isin("pass", "fail"))
    return rows.join(scored, ["task_id", "digest"]).groupBy("tier").agg(
        F.count("*").alias("n_samples"), F.count_if(inv).alias("invariant_changes"), F.count_if(scen).alias("scenario_changes"), F.count_if(valid).alias("valid_changes"),
        F.count_if(known("inv_std", "inv_var")).alias("invariant_open"), F.count_if(~alone).alias("scenario_open"),
    )


def audit_cells(spark, sf_dir):
    """Flips by cell (language), the tasks that have any, and how far they can move a mean over all samples or tasks of the cell.
    Verdicts are stand-ins: lengths of texts modulo small numbers."""
    rows, scored = units(spark, sf_dir)
    changed = scored.filter((F.col("inv_std") != F.col("inv_var")) | (F.col("scen_std") != F.col("scen_var")))
    inv, _, valid = flips()
    both = rows.join(changed, ["task_id", "digest"], "left").select("tier", "task_id", F.coalesce(inv, F.lit(False)).alias("inv"), F.coalesce(valid, F.lit(False)).alias("valid"))
    out = both.groupBy("tier").agg(
        F.count("*").alias("samples"), F.count_if("valid").alias("valid_flips"), F.count_if("inv").alias("invariant_flips"), F.count_distinct(F.when(F.col("valid"), F.col("task_id"))).alias("n_tasks"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("valid"), F.col("task_id")))), ",").alias("tasks"), F.count_distinct("task_id").alias("all_tasks"),
    )
    return out.withColumns({"worst_pass_1": F.round(F.col("valid_flips") / F.col("samples"), 9), "worst_pass_10": F.round(F.col("n_tasks") / F.col("all_tasks"), 9)})


def report_matched_seeds(spark, sf_dir):
    """Two conditions (tiers), seed by seed where both have one, with the sample deviation of the differences."""
    per = verdicts.line_trials(spark, sf_dir).filter("seed <> 3 OR tier <> 'ASIA'").groupBy("tier", "seed", "task").agg(F.avg(F.col("valid").cast("int")).alias("p")).groupBy("tier", "seed").agg(F.avg("p").alias("v"))
    wide = per.groupBy("seed").pivot("tier", ["ASIA", "EUROPE"]).agg(F.first("v")).filter("ASIA IS NOT NULL AND EUROPE IS NOT NULL").withColumn("d", F.col("EUROPE") - F.col("ASIA"))
    w = Window.partitionBy(F.lit(0))
    return wide.select("seed", F.round("ASIA", 9).alias("one"), F.round("EUROPE", 9).alias("other"), F.round("d", 9).alias("d"), F.round(F.avg("d").over(w), 9).alias("mean"), F.round(F.stddev_samp("d").over(w), 9).alias("sd"))


def report_cost(spark, sf_dir):
    """Calls until the first success, meaned over tasks and then over conditions, and what one call costs against them."""
    tried = verdicts.in_order(spark, sf_dir).filter("i <= 10").groupBy("task", "tier").agg(F.coalesce(F.min(F.when(F.col("valid"), F.col("i"))), F.count("*")).alias("calls"))
    per = tried.groupBy("tier").agg(F.avg("calls").alias("calls"))
    return per.agg(F.round(F.avg("calls"), 9).alias("mean_calls"), F.round(F.stddev_pop("calls"), 9).alias("sd_calls"), F.round(1 / F.avg("calls"), 9).alias("cost_ratio"))


def outputs(spark, sf_dir):
    """Two outputs of a controller at every scan of a user's events."""
    rows = traces.scans(spark, sf_dir)
    return rows.withColumn("alarm", traces.T.latch(F.col("trip"), F.col("reset"), traces.KEY)).withColumn("run", traces.T.latch(F.col("start"), F.col("trip") | F.col("reset"), traces.KEY, reset_dominant=True))


def report_activity(spark, sf_dir):
    """How alive outputs are: users whose outputs are ever on, always off, always on or never change, by group of users, and the means over groups."""
    per = outputs(spark, sf_dir).groupBy("user_id").agg(
        F.bool_or(F.col("alarm") | F.col("run")).alias("active"), (~F.bool_or(F.col("alarm") | F.col("run"))).alias("off"), F.bool_and(F.col("alarm") & F.col("run")).alias("all_on"),
        (F.count_distinct(F.struct("alarm", "run")) <= 1).alias("constant"),
    )
    groups = per.groupBy((F.col("user_id") % 3).alias("seed")).agg(F.count("*").alias("n"), *(F.avg(F.col(c).cast("int")).alias(c) for c in ("active", "off", "all_on", "constant")))
    return groups.agg(F.count("*").alias("seeds"), F.sum("n").alias("n"), *(F.round(F.avg(c), 9).alias(c) for c in ("active", "off", "all_on", "constant")))


def report_scenarios(spark, sf_dir):
    """Each user's days of the month as scenarios: expected against actual outputs, scan by scan. Users pass all, fail one or fail more; the days that alone
    fail a user, most often first."""
    rows = outputs(spark, sf_dir).withColumn("expected", traces.T.latch(F.col("trip"), F.col("reset"), traces.KEY, reset_dominant=True) & (F.col("level") < 99))
    per = rows.groupBy("user_id", F.day("ts").alias("scenario")).agg(F.count("*").alias("steps"), F.min(F.when(F.col("expected") != F.col("alarm"), F.struct("ts", "event_id"))).alias("first"))
    w = Window.partitionBy("user_id")
    verdict = per.withColumns({"ok": F.col("first").isNull(), "n": F.count("*").over(w), "bad": F.count_if(F.col("first").isNotNull()).over(w)}).filter("n >= 2")
    kind = F.when(F.col("bad") == 0, "pass_all").when(F.col("bad") == 1, "fail_1").otherwise("fail_2plus")
    return verdict.groupBy("scenario").agg(
        F.count("*").alias("samples"), F.count_if(~F.col("ok") & (F.col("bad") == 1)).alias("flips"), *(F.count_if(kind == k).alias(k) for k in ("pass_all", "fail_1", "fail_2plus")),
        F.min("first.event_id").alias("least_event"),
    ).orderBy(F.desc("flips"), "scenario").limit(12)


def report_idle(spark, sf_dir):
    """Degenerate controllers by mode and tier, and by mode alone: what holds when outputs are held off, held on or left alone. Verdicts are stand-ins, taken from order lines."""
    per = verdicts.line_trials(spark, sf_dir).groupBy("task", "tier").agg(F.bool_or("invariant").alias("a"), F.bool_and("scenario").alias("b"), F.bool_or("valid").alias("c"))
    modes = F.explode(F.array(F.struct(F.lit("all-off").alias("mode"), F.lit(True).alias("compile"), F.lit(True).alias("inv"), F.col("b").alias("scen")), F.struct(F.lit("all-on").alias("mode"), F.lit(True).alias("compile"), (~F.col("a")).alias("inv"), F.col("c").alias("scen")), F.struct(F.lit("empty-body").alias("mode"), F.col("a").alias("compile"), F.col("a").alias("inv"), F.lit(False).alias("scen"))))  # noqa: E501
    rows = per.select("tier", modes.alias("m")).select("tier", "m.*")
    n = F.count_if
    out = rows.groupingSets([[F.col("mode"), F.col("tier")], [F.col("mode")]], "mode", "tier").agg(
        F.count("*").alias("n"), n("compile").alias("compiles"), n(F.col("compile") & F.col("inv")).alias("invariant"), n("scen").alias("scenario"), n(F.col("compile") & F.col("inv") & F.col("scen")).alias("valid")
    )
    return out.withColumn("tier", F.coalesce("tier", F.lit("all")))


def report_mutants(spark, sf_dir):
    """Mutants of the parts' programs by rule and over all: what two checks kill, and what only one or none does. The kills are stand-ins: digits of a mutant's digest."""
    rows = mutation.mutants(programs.parts(spark, sf_dir, dealt=True).select("id", "code"))
    digest = F.md5(F.col("mutant").cast("binary"))
    scored = rows.select("rule", X.balanced(F.col("mutant")).alias("compiles"), (F.substring(digest, 1, 1) < "a").alias("kills_a"), (F.substring(digest, 2, 1) < "8").alias("kills_b"))
    return mutation.verdicts(scored, "rule").withColumn("rule", F.coalesce("rule", F.lit("all")))


def report_matrix(spark, sf_dir):
    """Valid trials by supplier and line number as lines of fixed width, and the tier that the first letter of a region stands for."""
    rows = verdicts.line_trials(spark, sf_dir).groupBy("task", F.col("seed").cast("string").alias("seed")).agg(F.count_if("valid").alias("c"))
    return matrix_lines(rows, "task", "seed", "c", ["1", "2", "3", "9"])


def report_tiers(spark, sf_dir):
    """Tasks by the tier that their id begins with, and the short ids; ids of no tier are apart."""
    task = F.concat(F.element_at(F.array(F.lit("E"), F.lit("M"), F.lit("H"), F.lit("X")), (F.col("p_partkey") % 4 + 1).cast("int")), F.lpad((F.col("p_size")).cast("string"), 2, "0"), F.lit("_"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")))
    rows = table(spark, sf_dir, "part").select(task.alias("task")).withColumns({"tier": F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for x in ("E", "easy", "M", "medium", "H", "hard"))), F.substring("task", 1, 1)), F.lit("none")), "short": F.split_part("task", F.lit("_"), F.lit(1))})
    return rows.groupBy("tier").agg(F.count("*").alias("n"), F.count_distinct("short").alias("n_short"), F.min("short").alias("first"))


def report_rewards(spark, sf_dir):
    """Mean graded rewards of a panel's samples by outcome; the first property is the critical one, and a sample without scenarios has no share of them."""
    rows = categorised(panel(spark, sf_dir)).filter("error IS NULL")
    held = F.size(F.filter("statuses", lambda s: s == "pass")) / F.size("statuses")
    share = F.when(F.col("scenarios_total") > 0, F.col("scenarios_pass") / F.col("scenarios_total"))
    kinds = [reward(F.col("parsed"), F.coalesce(F.col("compiles"), F.lit(True)), held, share, F.get("statuses", 0) == "pass", k).alias(k) for k in ("dual", "task", "gated")]
    return rows.select("category", *kinds).groupBy("category").agg(F.count("*").alias("n"), *(F.round(F.avg(k), 9).alias(k) for k in ("dual", "task", "gated")))


def repairs(spark, sf_dir):
    """Programs that stored verdicts hold verified, with their bugs in the order of the rules: which property each breaks, and its trace (empty if there is none)."""
    rows = mutation.first_bugs(programs.parts(spark, sf_dir)).filter("id % 10 <> 9")
    bugs = F.array_compact(F.array(*(F.when(F.col(c) != F.col("code"), F.struct(F.lit(c).alias("rule"), F.col(c).alias("bug"))) for c in ("weaken_or", "flip_compare", "force_true"))))
    each = rows.select("id", "code", F.posexplode(bugs).alias("pos", "b")).select("id", "code", "pos", "b.*").withColumn("digest", F.md5(F.col("bug").cast("binary")))
    # Of three properties the first in the order of declaration that fails; none does where the bug is harmless.
    statuses = F.array(*(F.when(F.substring("digest", k, 1) < limit, "fail").otherwise("pass") for k, limit in ((1, "4"), (2, "8"), (3, "c"))))
    first = F.array_position(statuses, "fail")
    trace = F.when(F.substring("digest", 4, 1) < "e", F.concat(F.lit("state 1: "), "digest")).otherwise("")
    return each.filter(first > 0).select("id", "code", "pos", "rule", "bug", first.alias("property"), trace.alias("trace")).filter("trace <> ''")


MEANINGS = {1: "stays off", 2: "stays bounded", 3: "needs a request"}


def meaning():
    return F.element_at(F.create_map(*(F.lit(x) for pair in MEANINGS.items() for x in pair)), F.col("property").cast("int"))


def ask():
    return F.concat(F.lit("Write program "), F.col("id"))


def data_repairs(spark, sf_dir):
    """Training pairs: each verified program for its prompt, and its first bug that breaks a property, with feedback, for the program.
    Which programs are verified and what a bug breaks are stand-ins: the id's last digit, and digits of the bug's digest."""
    made = F.row_number().over(Window.partitionBy("id").orderBy("pos"))
    pairs = repairs(spark, sf_dir).withColumn("made", made - 1).filter("made < 1")
    prompt = X.repair_prompt("full", ask(), F.col("bug"), F.concat(F.lit("P"), "property"), meaning(), F.col("trace"))
    repair = pairs.select(F.concat("id", F.lit("__repair"), "made").alias("pair"), F.lit("repair").alias("kind"), F.md5(prompt.cast("binary")).alias("prompt"), F.md5(F.col("code").cast("binary")).alias("completion"))
    plain = programs.parts(spark, sf_dir).filter("id % 10 <> 9").select(F.col("id").cast("string").alias("pair"), F.lit("zeroshot").alias("kind"), F.md5(ask().cast("binary")).alias("prompt"), F.md5(F.col("code").cast("binary")).alias("completion"))
    return plain.unionByName(repair)


def data_repair_controls(spark, sf_dir):
    """Each first bug under five kinds of feedback, and the plain prompt as a set of the same size; shuffled ones get the trace of the next item, the last that of the first.
    What the checker says of a bug is a stand-in: digits of its digest."""
    first = repairs(spark, sf_dir).groupBy("id").agg(F.min_by(F.struct("bug", "property", "trace"), "pos").alias("m")).select("id", "m.*")
    own = placed(first.select("id"), "id", "3")
    size = own.agg(F.count("*").alias("size"))
    items = first.join(own, "id").crossJoin(F.broadcast(size))
    other = items.select((F.col("place") - 1).alias("place"), F.col("trace").alias("other"))
    last = items.filter("place = 1").select(F.col("size").alias("place"), F.col("trace").alias("other"))
    pairs = items.join(other.filter("place > 0").unionByName(last), "place")
    args = (ask(), F.col("bug"), F.concat(F.lit("P"), "property"), meaning(), F.col("trace"), F.col("other"))
    prompts = {f"repair_{k}": X.repair_prompt(k, *args) for k in X.FEEDBACK} | {"generic_sft": ask()}
    variants = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.md5(p.cast("binary")).alias("prompt")) for k, p in prompts.items())))
    return pairs.select("id", variants.alias("v")).select("id", "v.*")


T = """t AS (SELECT doc_id, source AS task_id, lang AS tier, text AS code, CASE WHEN doc_id % 37 = 0 THEN 'timed out' END AS error, n_chars >= 50 AS parsed, CASE WHEN doc_id % 41 <> 0 THEN n_chars >= 200 END AS compiles,
    doc_id % 31 <> 0 AS available, [CASE WHEN toxic = 0 THEN 'pass' ELSE 'fail' END, CASE WHEN doc_id % 29 = 0 THEN 'error' WHEN quality = 1 THEN 'pass' ELSE 'unknown' END] AS st,
    doc_id % 4 AS s_all, CASE WHEN quality = 1 THEN doc_id % 4 ELSE (doc_id % 4) // 2 END AS s_ok FROM documents JOIN labels USING (doc_id))"""
G = """g AS (SELECT *, st = ['pass', 'pass'] AS held, CASE WHEN error IS NOT NULL THEN 'api_error' WHEN NOT parsed THEN 'parse_error' WHEN NOT compiles THEN 'compile_error' WHEN NOT available THEN 'verify_unavailable'
    WHEN list_contains(st, 'error') THEN 'translate_error' WHEN st = ['pass', 'pass'] THEN 'verified' WHEN list_contains(st, 'fail') THEN 'unsafe' ELSE 'unknown' END AS category FROM t)"""
POOL = "t AS (SELECT doc_id, lang, n_chars >= 200 AS c, toxic = 0 AS i, quality = 1 AS s FROM documents JOIN labels USING (doc_id))"
UNITS = """u AS (SELECT doc_id, task_id, tier, coalesce(compiles, false) AS ok, ['pass', 'fail', 'pass'][length(code) % 3 + 1] AS i1, ['pass', 'fail', 'error', 'pass', 'pass'][length(code) % 5 + 1] AS i2,
    ['pass', 'fail', 'no_scenarios', 'pass'][length(code) % 4 + 1] AS s1, ['pass', 'pass', 'fail', 'no_scenarios', 'error', 'pass', 'fail'][length(code) % 7 + 1] AS s2 FROM t WHERE code IS NOT NULL),
    v AS (SELECT *, i1 IN ('pass', 'fail') AND i2 IN ('pass', 'fail') AS ic, s1 IN ('pass', 'fail') AND s2 IN ('pass', 'fail') AS sc, s1 <> 'error' AND s2 <> 'error' AS sn FROM u),
    w AS (SELECT *, ic AND i1 <> i2 AS inv, sc AND s1 <> s2 AS scen, ic AND sn AND (ok AND i1 = 'pass' AND s1 IN ('pass', 'no_scenarios')) <> (ok AND i2 = 'pass' AND s2 IN ('pass', 'no_scenarios')) AS valid FROM v)"""
ON = """e AS (SELECT user_id, ts, event_id, event_type = 'error' AS trip, event_type = 'signup' AS reset, event_type = 'click' AS start, least(100, CAST(floor(value) AS INTEGER)) AS level FROM events),
    o AS (SELECT *, coalesce(last_value(CASE WHEN trip THEN true WHEN reset THEN false END IGNORE NULLS) OVER w, false) AS alarm,
        coalesce(last_value(CASE WHEN trip OR reset THEN false WHEN start THEN true END IGNORE NULLS) OVER w, false) AS run,
        coalesce(last_value(CASE WHEN reset THEN false WHEN trip THEN true END IGNORE NULLS) OVER w, false) AS second FROM e
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))"""
NAMED = "(VALUES ('Motor'), ('Drive'), ('Pump'), ('Fan'), ('Mixer'), ('Blower'), ('Spindle'), ('Auger')) o(o)"
SIX = "(VALUES ('Motor'), ('Drive'), ('Pump'), ('Conveyor'), ('Mixer'), ('Hoist')) o(o)"
SQL_DEFAULT = f"""SELECT 'multi_guard' AS family, 'GEN_mguard_' || n || '_' || o AS id, CASE WHEN n < 3 THEN 'easy' ELSE 'medium' END AS difficulty, list_append(['G(!G' || i || ' -> !' || o || ')' FOR i IN range(1, n + 1)], 'G(StopPB -> !' || o || ')') AS f FROM range(1, 5) r(n), {NAMED}
    UNION ALL SELECT 'estop_bus', 'GEN_estop_' || n || '_' || o, CASE WHEN n < 3 THEN 'easy' ELSE 'medium' END, list_append(['G(!E' || i || ' -> !' || o || ')' FOR i IN range(1, n + 1)], 'G(Stop -> !' || o || ')') FROM range(1, 5) r(n), {NAMED}
    UNION ALL SELECT 'ondelay', 'GEN_ondelay_' || n || '_' || o, 'medium', ['G(!EStop -> !' || o || ')', 'G(' || o || ' -> StartCmd)'] FROM range(1, 5) r(n), {NAMED}
    UNION ALL SELECT 'override_cutout', 'GEN_override_' || o || '_' || t, 'easy', ['G(' || t || ' -> !' || o || ')', 'G(' || o || ' -> Enable)', 'G(' || o || ' -> Demand)'] FROM (VALUES ('OverTemp'), ('Fault')) t(t), {NAMED}
    UNION ALL SELECT 'bounded_counter', 'GEN_counter_' || n || '_' || o, 'medium', ['G(Count <= ' || n || ')', 'G(' || o || ' -> Count >= ' || n || ')'] FROM range(2, 6) r(n), {NAMED}
    UNION ALL SELECT 'hysteresis', 'GEN_hyst_' || l || '_' || h, 'easy', ['G(Level >= ' || h || ' -> !Actuator)'] FROM (VALUES (70), (80), (90)) h(h), (VALUES (5), (10), (20)) l(l)
    UNION ALL SELECT 'exclusive_two', 'GEN_excl_' || a || '_' || b, 'easy', ['G(!(' || a || ' & ' || b || '))', 'G(' || a || ' -> ReqA)', 'G(' || b || ' -> ReqB)'] FROM (VALUES ('DoorA', 'DoorB'), ('ValveX', 'ValveY'), ('Heat', 'Cool'), ('FwdK', 'RevK'), ('StarK', 'DeltaK')) p(a, b)"""
SQL_HARD = f"""SELECT 'safety_chain' AS family, 'GEN_chain_' || a || 'e' || b || 'g_' || o AS id, 'medium' AS difficulty, list_append(list_concat(['G(!E' || i || ' -> !' || o || ')' FOR i IN range(1, a + 1)], ['G(!G' || i || ' -> !' || o || ')' FOR i IN range(1, b + 1)]), 'G(Stop -> !' || o || ')') AS f FROM (VALUES (1, 2), (2, 1), (2, 2), (3, 2)) s(a, b), {SIX}
    UNION ALL SELECT 'bounded_updown', 'GEN_updown_' || n || '_' || o, 'medium', ['G(Count <= ' || n || ')', 'G(Count >= 0)', 'G(' || o || ' -> Count >= ' || n || ')'] FROM range(2, 7) r(n), (VALUES ('Bay'), ('Slot'), ('Buffer')) o(o)
    UNION ALL SELECT 'ordered_pair', 'GEN_ordered_' || a || '_' || b, 'medium', ['G(' || b || ' -> ' || a || ')', 'G(!EStop -> (!' || a || ' & !' || b || '))', 'G(Stop -> (!' || a || ' & !' || b || '))'] FROM (VALUES ('Feed', 'Mix'), ('Pump', 'Heat'), ('Conv1', 'Conv2'), ('Lube', 'Spindle'), ('Charge', 'Run')) p(a, b)
    UNION ALL SELECT 'two_speed', 'GEN_twospeed_' || o, 'medium', ['G(!(' || o || 'Slow & ' || o || 'Fast))', 'G(!EStop -> (!' || o || 'Slow & !' || o || 'Fast))', 'G(' || o || 'Fast -> FastEnable)'] FROM {SIX}"""

BUGS = f"""{programs.BUGS}, q AS (SELECT id, code, unnest([1, 2, 3]) AS pos, unnest([weaken_or, flip_compare, force_true]) AS bug FROM e JOIN p USING (id) WHERE id % 10 <> 9),
    h AS (SELECT *, md5(bug) AS g FROM q WHERE bug IS NOT NULL), w AS (SELECT *, CASE WHEN g[1] < '4' THEN 1 WHEN g[2] < '8' THEN 2 WHEN g[3] < 'c' THEN 3 END AS prop, 'state 1: ' || g AS trace FROM h WHERE g[4] < 'e'),
    f AS (SELECT *, ['stays off', 'stays bounded', 'needs a request'][prop] AS meaning, 'Write program ' || id || chr(10) || chr(10) || '[program]' || chr(10) || bug AS head
          FROM w WHERE prop IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) = 1)"""
TAIL = f"chr(10) || chr(10) || '[task]' || chr(10) || '{X.REPAIR_TASK}'"
BROKEN = "chr(10) || chr(10) || '[finding]' || chr(10) || 'P' || prop || ': ' || meaning"
SHOWN = f"head || {BROKEN} || chr(10) || chr(10) || '[trace]' || chr(10) || {{t}} || {TAIL}"
ORACLE_SQL = {
    "data_repairs": f"""WITH {programs.P}, {BUGS} SELECT CAST(id AS VARCHAR) AS pair, 'zeroshot' AS kind, md5('Write program ' || id) AS prompt, md5(code) AS completion FROM p WHERE id % 10 <> 9
        UNION ALL SELECT id || '__repair0', 'repair', md5({SHOWN.format(t='trace')}), md5(code) FROM f""",
    "data_repair_controls": f"""WITH {programs.P}, {BUGS}, o AS (SELECT *, coalesce(lead(trace) OVER w, first_value(trace) OVER w) AS other FROM f WINDOW w AS (ORDER BY md5('3:' || id), id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
        SELECT id, unnest(['repair_full', 'repair_nocex', 'repair_proponly', 'repair_erroronly', 'repair_shuffle', 'generic_sft']) AS kind, unnest([md5({SHOWN.format(t='trace')}), md5(head || {TAIL}), md5(head || {BROKEN} || {TAIL}),
            md5(head || chr(10) || chr(10) || '[finding]' || chr(10) || 'there is one' || {TAIL}), md5({SHOWN.format(t='other')}), md5('Write program ' || id)]) AS prompt FROM o""",
    "report_evaluation": f"""WITH {T}, {G} SELECT task_id, count(*) AS tasks, count(error) AS api_errors, {', '.join(f"round(count(*) FILTER (category = '{c}') / count(*), 9) AS {c}_rate" for c in ('verified', 'unsafe', 'parse_error', 'compile_error', 'translate_error'))},
        round(coalesce(sum(len(list_filter(st, lambda x: x = 'pass'))) FILTER (error IS NULL) / sum(2) FILTER (error IS NULL), 0), 9) AS property_pass_rate,
        round(coalesce(sum(s_ok) FILTER (error IS NULL) / nullif(sum(s_all) FILTER (error IS NULL), 0), 0), 9) AS scenario_pass_rate,
        round(coalesce(count(*) FILTER (category = 'verified') / nullif(count(*) FILTER (error IS NULL), 0), 0), 9) AS verified_of_fine FROM g GROUP BY 1""",
    "report_outcomes": f"WITH {T}, {G} SELECT tier, category, count(*) AS n FROM g GROUP BY 1, 2",
    "report_statuses": f"""WITH {T}, {G}, x AS (SELECT *, trim(coalesce(code, ''), ' ') = '' AS empty FROM g), y AS (SELECT *, coalesce(compiles, false) AND NOT empty AS ok, s_all > 0 AND s_ok = s_all AND NOT empty AS sc FROM x)
        SELECT doc_id, CASE WHEN empty THEN 'not_found' ELSE 'found' END AS extraction, CASE WHEN compiles IS NULL THEN 'n/a' WHEN compiles THEN 'accepted' ELSE 'rejected' END AS compiler,
            CASE WHEN NOT available THEN 'n/a' ELSE 'supported' END AS translator, CASE WHEN NOT available THEN 'not_run' WHEN held THEN 'all_hold' ELSE 'some_fail' END AS checker,
            empty, ok AS compile, ok AND held AS invariant, sc AS scenario, ok AND held AND sc AS valid FROM y""",
    "report_corpus": """WITH n AS (SELECT l_suppkey AS k, count(*) AS n, count(DISTINCT l_linenumber) AS s FROM lineitem GROUP BY 1)
        SELECT coalesce(r_name, 'all') AS tier, count(*) AS tasks, CAST(coalesce(sum(n), 0) AS BIGINT) AS properties, count(*) FILTER (s >= 2) AS multi, count(DISTINCT n_name) AS domains
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN n ON k = s_suppkey GROUP BY ROLLUP (r_name)""",
    "report_pool": f"""WITH {POOL} SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS lang, count(*) AS total, count(*) FILTER (c) AS compile_pass, count(*) FILTER (i) AS invariant_pass, count(*) FILTER (s) AS scenario_pass,
        count(*) FILTER (c AND i) AS dual_pass, count(*) FILTER (c AND i AND s) AS taskvalid_pass, count(*) FILTER (NOT (c AND i)) AS reject_total, count(*) FILTER (NOT c AND i) AS reject_compile_only,
        count(*) FILTER (c AND NOT i) AS reject_invariant_only, count(*) FILTER (NOT c AND NOT i) AS reject_both, round(count(*) FILTER (NOT (c AND i)) / count(*), 9) AS reject_rate FROM t GROUP BY ROLLUP (lang)""",
    "data_subsets": f"""WITH {POOL}, r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('0:' || doc_id), doc_id) AS place FROM t)
        SELECT 'all' AS subset, doc_id FROM t UNION ALL SELECT 'matiec_only', doc_id FROM t WHERE c UNION ALL SELECT 'property_only', doc_id FROM t WHERE i UNION ALL SELECT 'dual', doc_id FROM t WHERE c AND i
        UNION ALL SELECT 'random_sizematched', doc_id FROM r WHERE place <= (SELECT count(*) FROM t WHERE c AND i)""",
    "set_shuffled": "SELECT * FROM (SELECT c_custkey, c_name, row_number() OVER (ORDER BY md5('7:' || c_custkey), c_custkey) AS place FROM customer WHERE c_acctbal > 0) WHERE place <= 40",
    "set_either_way_prefix": """WITH s AS (SELECT p_partkey, left('Supplier#' || lpad(CAST(p_partkey % 120 AS VARCHAR), 9, '0') || '_x', p_size % 11 + 10) AS k FROM part),
        f AS (SELECT k, min(s_suppkey) AS task FROM (SELECT DISTINCT k FROM s) JOIN supplier ON k = s_name OR (k NOT IN (SELECT s_name FROM supplier) AND (starts_with(k, s_name) OR starts_with(s_name, k))) GROUP BY 1)
        SELECT p_partkey, k, task FROM s LEFT JOIN f USING (k)""",
    "audit_stored": f"""WITH {T} SELECT tier, count(*) AS checked, count(*) FILTER (compiles IS DISTINCT FROM CASE WHEN doc_id % 43 <> 0 THEN length(code) >= 200 END) AS compile_flips,
        count(*) FILTER ((st = ['pass', 'pass']) IS DISTINCT FROM (list_contains(st, 'pass') AND doc_id % 5 <> 0)) AS invariant_flips FROM t GROUP BY 1""",
    "audit_published": f"""WITH {verdicts.L}, {verdicts.C}, m AS (SELECT tier, avg(c_invariant / n) AS a, avg(c_valid / n) AS b FROM c GROUP BY 1),
        u AS (SELECT tier, 'c_invariant' AS metric, a AS v FROM m UNION ALL SELECT tier, 'c_valid', b FROM m), p AS (SELECT *, round(round(v, 2) + CASE WHEN starts_with(tier, 'A') THEN 0.01 ELSE 0 END, 2) AS published FROM u)
        SELECT tier, metric, round(v, 9) AS computed, published, round(v - published, 9) AS delta, abs(v - published) <= 0.006 AS "match" FROM p""",
    "audit_boundary": f"""WITH {T}, {UNITS} SELECT tier, count(*) AS n_samples, count(*) FILTER (inv) AS invariant_changes, count(*) FILTER (scen) AS scenario_changes, count(*) FILTER (valid) AS valid_changes,
        count(*) FILTER (NOT ic) AS invariant_open, count(*) FILTER (NOT sc AND s1 <> 'no_scenarios') AS scenario_open FROM w GROUP BY 1""",
    "audit_cells": f"""WITH {T}, {UNITS}, x AS (SELECT tier, count(*) AS samples, count(*) FILTER (valid AND (i1 <> i2 OR s1 <> s2)) AS valid_flips, count(*) FILTER (inv) AS invariant_flips,
            coalesce(list_sort(list(DISTINCT task_id) FILTER (valid)), []) AS ts, count(DISTINCT task_id) AS all_tasks FROM w GROUP BY 1)
        SELECT tier, samples, valid_flips, invariant_flips, len(ts) AS n_tasks, array_to_string(ts, ',') AS tasks, all_tasks, round(valid_flips / samples, 9) AS worst_pass_1, round(len(ts) / all_tasks, 9) AS worst_pass_10 FROM x""",
    "report_matched_seeds": f"""WITH {verdicts.L}, p AS (SELECT tier, seed, task, avg(CAST(valid AS INTEGER)) AS p FROM t WHERE seed <> 3 OR tier <> 'ASIA' GROUP BY ALL), m AS (SELECT tier, seed, avg(p) AS v FROM p GROUP BY ALL),
        d AS (SELECT a.seed, a.v AS one, b.v AS other, b.v - a.v AS d FROM m a JOIN m b ON a.seed = b.seed AND a.tier = 'ASIA' AND b.tier = 'EUROPE')
        SELECT seed, round(one, 9) AS one, round(other, 9) AS other, round(d, 9) AS d, round(avg(d) OVER (), 9) AS mean, round(stddev_samp(d) OVER (), 9) AS sd FROM d""",
    "report_cost": f"""WITH o AS (SELECT l_suppkey AS task, r_name AS tier, l_returnflag <> 'R' AND l_linestatus = 'F' AND l_discount <= CAST(0.05 AS DOUBLE) AS valid, row_number() OVER (PARTITION BY l_suppkey ORDER BY {', '.join(verdicts.ARRIVAL)}) AS i
            FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
        p AS (SELECT task, tier, coalesce(min(i) FILTER (valid), count(*)) AS calls FROM o WHERE i <= 10 GROUP BY ALL), m AS (SELECT tier, avg(calls) AS calls FROM p GROUP BY 1)
        SELECT round(avg(calls), 9) AS mean_calls, round(stddev_pop(calls), 9) AS sd_calls, round(1 / avg(calls), 9) AS cost_ratio FROM m""",
    "report_activity": f"""WITH {ON}, u AS (SELECT user_id, bool_or(alarm OR run) AS active, bool_and(alarm AND run) AS all_on, count(DISTINCT CAST(alarm AS INT) * 2 + CAST(run AS INT)) = 1 AS constant FROM o GROUP BY 1),
        g AS (SELECT user_id % 3 AS seed, count(*) AS n, avg(CAST(active AS INT)) AS a, avg(CAST(NOT active AS INT)) AS b, avg(CAST(all_on AS INT)) AS c, avg(CAST(constant AS INT)) AS d FROM u GROUP BY 1)
        SELECT count(*) AS seeds, CAST(sum(n) AS BIGINT) AS n, round(avg(a), 9) AS active, round(avg(b), 9) AS off, round(avg(c), 9) AS all_on, round(avg(d), 9) AS constant FROM g""",
    "report_scenarios": f"""WITH {ON}, s AS (SELECT user_id, CAST(day(ts) AS INTEGER) AS scenario, min(struct_pack(ts, event_id)) FILTER ((second AND level < 99) <> alarm) AS f FROM o GROUP BY ALL),
        v AS (SELECT *, count(*) OVER w AS n, count(f) OVER w AS bad FROM s WINDOW w AS (PARTITION BY user_id))
        SELECT scenario, count(*) AS samples, count(*) FILTER (f IS NOT NULL AND bad = 1) AS flips, count(*) FILTER (bad = 0) AS pass_all, count(*) FILTER (bad = 1) AS fail_1, count(*) FILTER (bad > 1) AS fail_2plus, min(f.event_id) AS least_event
        FROM v WHERE n >= 2 GROUP BY 1 ORDER BY flips DESC, scenario LIMIT 12""",
    "report_idle": f"""WITH {verdicts.L}, p AS (SELECT task, tier, bool_or(invariant) AS a, bool_and(scenario) AS b, bool_or(valid) AS c FROM t GROUP BY ALL),
        m AS (SELECT 'all-off' AS mode, tier, true AS compile, true AS inv, b AS scen FROM p UNION ALL SELECT 'all-on', tier, true, NOT a, c FROM p UNION ALL SELECT 'empty-body', tier, a, a, false FROM p)
        SELECT mode, coalesce(tier, 'all') AS tier, count(*) AS n, count(*) FILTER (compile) AS compiles, count(*) FILTER (compile AND inv) AS invariant, count(*) FILTER (scen) AS scenario, count(*) FILTER (compile AND inv AND scen) AS valid
        FROM m GROUP BY GROUPING SETS ((mode, tier), (mode))""",
    "report_mutants": f"""WITH {programs.P}, m AS (SELECT rule, mutant, row_number() OVER () AS id FROM (WITH {programs.MUTANTS})),
        l AS (SELECT id, balanced FROM (WITH p AS (SELECT id, mutant AS code FROM m), {programs.LINT})), s AS (SELECT rule, balanced AS c, md5(mutant)[1] < 'a' AS a, md5(mutant)[2] < '8' AS b FROM m JOIN l USING (id))
        SELECT coalesce(rule, 'all') AS rule, count(*) FILTER (c) AS compiling, count(*) FILTER (c AND a) AS killed_a, count(*) FILTER (c AND b) AS killed_b, count(*) FILTER (c AND NOT a AND b) AS blind_a, count(*) FILTER (c AND NOT a AND NOT b) AS survived
        FROM s GROUP BY ROLLUP (rule)""",
    "report_rewards": f"""WITH {T}, {G}, h AS (SELECT *, len(list_filter(st, lambda x: x = 'pass')) / 2 AS p, CASE WHEN s_all > 0 THEN s_ok / s_all END AS s FROM g WHERE error IS NULL),
        r AS (SELECT *, CASE WHEN NOT parsed THEN 0.0 WHEN NOT coalesce(compiles, true) THEN 0.1 ELSE 0.3 + 0.7 * p END AS dual, CASE WHEN NOT parsed THEN 0.0 WHEN NOT coalesce(compiles, true) THEN 0.1 WHEN s IS NULL THEN 0.2 + 0.7 * p ELSE 0.2 + 0.4 * p + 0.4 * s END AS task FROM h)
        SELECT category, count(*) AS n, round(avg(dual), 9) AS dual, round(avg(task), 9) AS task, round(avg(CASE WHEN st[1] = 'pass' THEN task ELSE least(task, 0.1) END), 9) AS gated FROM r GROUP BY 1""",
    "report_matrix": f"""WITH {verdicts.L}, g AS (SELECT task, seed, CAST(count(*) FILTER (valid) AS VARCHAR) AS c FROM t GROUP BY 1, 2)
        SELECT task, rpad(CAST(task AS VARCHAR), 9, ' ') || {' || '.join(f"lpad(coalesce(max(c) FILTER (seed = {k}), '-'), 9, ' ')" for k in (1, 2, 3, 9))} AS line FROM g GROUP BY 1""",
    "report_tiers": """WITH t AS (SELECT ['E', 'M', 'H', 'X'][p_partkey % 4 + 1] || lpad(CAST(p_size AS VARCHAR), 2, '0') || '_' || replace(p_name, ' ', '_') AS task FROM part)
        SELECT CASE task[1] WHEN 'E' THEN 'easy' WHEN 'M' THEN 'medium' WHEN 'H' THEN 'hard' ELSE 'none' END AS tier, count(*) AS n, count(DISTINCT string_split(task, '_')[1]) AS n_short, min(string_split(task, '_')[1]) AS "first" FROM t GROUP BY 1""",
}
QUERIES = {k: globals()[k] for k in ORACLE_SQL}
