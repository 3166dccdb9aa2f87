"""Queries over verdicts of trials: pass@k, rates, roll-ups, pairings, rankings and resampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from traceloom.functions.metrics import pass_at_k, rate, reward
from traceloom.operators.ranges import running
from traceloom.sources.shared import stored
from traceloom.sources.tables import table

KS = (1, 3, 5, 10)
#: The order of a supplier's lines.
ARRIVAL = ("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_tax")


def trials(spark, sf_dir):
    """Labelled documents as trials: the task is language and source, the tier the language."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.select("doc_id", "lang", "source", "n_chars").join(labels, "doc_id")
    ok = F.col("n_chars") >= 200
    return rows.select(
        "doc_id", F.concat_ws(":", "lang", "source").alias("task"), F.col("lang").alias("tier"), ok.alias("compiles"),
        (ok & (F.col("toxic") == 0)).alias("invariant"), (F.col("quality") == 1).alias("scenario"), (ok & (F.col("toxic") == 0) & (F.col("quality") == 1)).alias("valid"),
    )


def line_trials(spark, sf_dir):
    """Order lines as trials: the task is the supplier, the tier its region, the seed the line number."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_discount")
    places = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    ok = F.col("l_returnflag") != "R"
    return lines.join(places.select("s_suppkey", "r_name"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_suppkey").alias("task"), F.col("r_name").alias("tier"), F.col("l_linenumber").alias("seed"), ok.alias("compiles"),
        (ok & (F.col("l_linestatus") == "F")).alias("invariant"), (F.col("l_discount") <= 0.05).alias("scenario"),
        (ok & (F.col("l_linestatus") == "F") & (F.col("l_discount") <= 0.05)).alias("valid"),
    )


def counts(rows, *keys):
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *(F.count_if(c).alias(f"c_{c}") for c in ("compiles", "invariant", "scenario", "valid")))


def verdict_counts(spark, sf_dir):
    return counts(trials(spark, sf_dir), "task", "tier")


def verdict_pass_at_k(spark, sf_dir):
    per = counts(trials(spark, sf_dir), "task", "tier")
    return per.select("task", *(F.round(pass_at_k(F.col("n"), F.col("c_valid"), k), 9).alias(f"pass_{k}") for k in KS))


def verdict_pass_at_k_modes(spark, sf_dir):
    per = counts(trials(spark, sf_dir), "task", "tier")
    return per.select("task", *(F.round(pass_at_k(F.col("n"), F.col("c_valid"), 5, m), 9).alias(m) for m in ("clamp", "any", "unclamped", "require_n")))


def verdict_macro_by_tier(spark, sf_dir):
    """Means over tasks, by tier and over all (GROUPING SETS)."""
    per = counts(line_trials(spark, sf_dir), "task", "tier")
    own = [pass_at_k(F.col("n"), F.col(c), k).alias(f"{c}_{k}") for c in ("c_invariant", "c_valid") for k in (1, 5)]
    scored = per.select("tier", *own)
    names = [f"{c}_{k}" for c in ("c_invariant", "c_valid") for k in (1, 5)]
    return scored.rollup("tier").agg(F.count("*").alias("tasks"), *(F.round(F.avg(n), 9).alias(n) for n in names)).withColumn("tier", F.coalesce("tier", F.lit("all")))


def verdict_micro_rates(spark, sf_dir):
    per = counts(line_trials(spark, sf_dir), "task", "tier")
    return per.groupBy("tier").agg(*(F.round(rate(F.col(f"c_{c}"), F.col("n")), 9).alias(f"{c}_rate") for c in ("compiles", "invariant", "scenario", "valid")))


def verdict_metric_cube(spark, sf_dir):
    """Every metric at every k, one row each."""
    per = counts(line_trials(spark, sf_dir), "task", "tier")
    long = per.unpivot(["task", "n"], ["c_compiles", "c_invariant", "c_scenario", "c_valid"], "metric", "c")
    at = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), pass_at_k(F.col("n"), F.col("c"), k).alias("p")) for k in KS)))
    out = long.select("metric", at.alias("at")).select("metric", "at.*")
    return out.groupBy("metric", "k").agg(F.round(F.avg("p"), 9).alias("mean"))


def verdict_categories(spark, sf_dir):
    """Outcome by precedence, as a histogram with shares of all trials."""
    name = F.when(~F.col("compiles"), "compile_error").when(~F.col("invariant"), "unsafe").when(~F.col("scenario"), "unknown").otherwise("verified")
    rows = trials(spark, sf_dir).select("tier", name.alias("category"))
    return rows.groupBy("tier", "category").agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("tier")), 9))


def verdict_seed_spread(spark, sf_dir):
    """Mean and both deviations over seeds of the micro rate; the sample deviation is 0 for a single seed."""
    per = line_trials(spark, sf_dir).groupBy("tier", "seed").agg(F.avg(F.col("valid").cast("int")).alias("v"))
    return per.groupBy("tier").agg(
        F.count("*").alias("seeds"), F.round(F.avg("v"), 9).alias("mean"), F.round(F.stddev_pop("v"), 9).alias("sd_pop"), F.round(F.coalesce(F.stddev_samp("v"), F.lit(0.0)), 9).alias("sd_samp")
    )


def verdict_paired_seeds(spark, sf_dir):
    """Differences of consecutive tiers, paired by seed."""
    per = line_trials(spark, sf_dir).groupBy("tier", "seed").agg(F.avg(F.col("valid").cast("int")).alias("v"))
    names = per.select("tier").distinct().withColumn("after", F.lead("tier").over(Window.orderBy("tier"))).filter("after is not null")
    a, b = per.alias("a"), per.alias("b")
    pairs = names.join(a, names.tier == F.col("a.tier")).join(b, (names.after == F.col("b.tier")) & (F.col("a.seed") == F.col("b.seed")))
    return pairs.select(names.tier, names.after, (F.col("b.v") - F.col("a.v")).alias("d")).groupBy("tier", "after").agg(F.round(F.avg("d"), 9).alias("mean"), F.round(F.stddev_pop("d"), 9).alias("sd"))


def verdict_all_pairs(spark, sf_dir):
    """Every pair of tiers once, with the difference of their macro means. Tiers are a handful of conditions, so a join without an equal key will do."""
    per = counts(line_trials(spark, sf_dir), "task", "tier").groupBy("tier").agg(F.avg(F.col("c_valid") / F.col("n")).alias("v"))
    a, b = per.alias("a"), per.alias("b")
    return a.join(b, F.col("a.tier") < F.col("b.tier")).select(F.col("a.tier").alias("one"), F.col("b.tier").alias("other"), F.round(F.col("a.v") - F.col("b.v"), 9).alias("d"))


def verdict_rank(spark, sf_dir):
    """Tiers by rate, ties by name; the leader; and whether the order holds without the first suppliers."""
    rows = line_trials(spark, sf_dir)

    def ranks(part, name):
        per = part.groupBy("tier").agg(F.avg(F.col("valid").cast("int")).alias("v"))
        return per.select("tier", F.row_number().over(Window.orderBy(F.desc(F.round("v", 9)), "tier")).alias(name))

    return ranks(rows, "rank_all").join(ranks(rows.filter("task > 10"), "rank_masked"), "tier").withColumns({"leader": F.col("rank_all") == 1, "same": F.col("rank_all") == F.col("rank_masked")})


def leave_one_out(verdicts):
    """Of verdicts (sample, scenario, ok): for each scenario, the samples that fail it alone, which leaving it out flips; and total, max, median and mean
    of these flips over all scenarios. Samples of a single scenario have nothing to leave out."""
    per = verdicts.groupBy("sample", "scenario").agg(F.bool_and("ok").alias("ok"))
    fails = per.groupBy("sample").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("n_fail"), F.min(F.when(~F.col("ok"), F.col("scenario"))).alias("scenario"))
    flips = fails.filter("n > 1 AND n_fail = 1").groupBy("scenario").agg(F.count("*").alias("flips"))
    each = per.select("scenario").distinct().join(flips, "scenario", "left").select("scenario", F.coalesce("flips", F.lit(0)).alias("flips"))
    w = Window.partitionBy(F.lit(0))
    return each.select("scenario", "flips", F.sum("flips").over(w).alias("total"), F.max("flips").over(w).alias("most"), F.median("flips").over(w).alias("median"), F.round(F.avg("flips").over(w), 9).alias("mean"))


def verdict_leave_one_out(spark, sf_dir):
    """Orders by how many of their lines fail: none, one, which leaving it out would flip, or more; by the number of their lines. Orders of one line are out."""
    ok = (F.col("l_discount") <= 0.05) | (F.col("l_returnflag") != "R")
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.bool_and(ok).alias("ok")).groupBy("l_orderkey").agg(F.count("*").alias("n_scenarios"), F.count_if(~F.col("ok")).alias("bad"))
    kinds = (("pass_all", F.col("bad") == 0), ("fail_1", F.col("bad") == 1), ("fail_2plus", F.col("bad") > 1))
    return per.filter("n_scenarios >= 2").groupBy("n_scenarios").agg(F.count("*").alias("samples"), *(F.count_if(c).alias(k) for k, c in kinds))


def verdict_leave_one_out_by_order(spark, sf_dir):
    """Leave-one-out with orders as samples and line numbers as scenarios."""
    ok = (F.col("l_discount") <= 0.05) | (F.col("l_returnflag") != "R")
    return leave_one_out(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample"), F.col("l_linenumber").alias("scenario"), ok.alias("ok")))


def in_order(spark, sf_dir):
    """Order lines as trials of suppliers, in an order that doesn't look at the outcome; order and line alone don't tell all lines apart."""
    lines = table(spark, sf_dir, "lineitem")
    places = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    valid = (F.col("l_returnflag") != "R") & (F.col("l_linestatus") == "F") & (F.col("l_discount") <= 0.05)
    w = Window.partitionBy("task").orderBy(*ARRIVAL)
    rows = lines.join(places.select("s_suppkey", "r_name"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_suppkey").alias("task"), F.col("r_name").alias("tier"), valid.alias("valid"), *ARRIVAL)
    return rows.select("task", "tier", "valid", F.row_number().over(w).alias("i"))


def best_of(tried, k: int):
    """Of trials with task, tier, valid and their place i from 1: calls until the first success among k, else all; by tier."""
    per = tried.filter(F.col("i") <= k).groupBy("task", "tier").agg(F.min(F.when(F.col("valid"), F.col("i"))).alias("first"), F.count("*").alias("k"))
    return per.groupBy("tier").agg(
        F.count("*").alias("tasks"), F.round(F.avg(F.col("first").isNotNull().cast("int")), 9).alias("success"), F.sum(F.coalesce("first", "k").cast("long")).alias("calls"), F.round(F.avg(F.coalesce("first", "k")), 9).alias("mean_calls")
    )


def verdict_best_of_k(spark, sf_dir):
    """For each task the calls until its first success among ten trials in the order in which they came, and whether there was one."""
    first = F.min(F.when(F.col("valid"), F.col("i")))
    per = in_order(spark, sf_dir).filter("i <= 10").groupBy("task", "tier").agg(first.alias("first"), F.count("*").alias("k"))
    return per.select("task", "tier", F.coalesce("first", "k").cast("long").alias("calls"), F.col("first").isNotNull().alias("won"))


def verdict_best_of_k_in_order(spark, sf_dir):
    """Best of ten with the trials in the order in which they came."""
    return best_of(in_order(spark, sf_dir), 10)


def verdict_inflation(spark, sf_dir):
    """How far a laxer metric lies above a stricter one; the ratio is null without a stricter success."""
    per = line_trials(spark, sf_dir).groupBy("tier").agg(F.avg(F.col("invariant").cast("int")).alias("lax"), F.avg(F.col("valid").cast("int")).alias("strict"))
    return per.select("tier", F.round(F.col("lax") - F.col("strict"), 9).alias("difference"), F.round(F.try_divide("lax", "strict"), 9).alias("ratio"))


def verdict_quantifiers(spark, sf_dir):
    return line_trials(spark, sf_dir).groupBy("task").agg(F.bool_and("compiles").alias("every"), F.bool_or("valid").alias("some"), F.collect_set("seed").alias("s")).select("task", "every", "some", F.size("s").cast("long").alias("n_seeds"))


def verdict_two_by_two(spark, sf_dir):
    """The table of two checks, rebuilt from its margins and compared with the counts."""
    return line_trials(spark, sf_dir).groupBy("tier").agg(
        F.count_if(~F.col("invariant")).alias("killed_a"), F.count_if(~F.col("scenario")).alias("killed_b"), F.count_if(~F.col("invariant") | ~F.col("scenario")).alias("killed"),
        (F.count_if(~F.col("invariant")) + F.count_if(~F.col("scenario")) - F.count_if(~F.col("invariant") | ~F.col("scenario"))).alias("both"),
        (F.count("*") - F.count_if(~F.col("invariant") | ~F.col("scenario"))).alias("survived"),
    )


def verdict_rewards(spark, sf_dir):
    """Graded rewards of the outcomes, and the summary by tier."""
    r = trials(spark, sf_dir).select("tier", *(reward(F.lit(True), F.col("compiles"), F.col("invariant").cast("int"), F.col("scenario").cast("int"), F.col("invariant"), k).alias(k) for k in ("dual", "task", "gated")))
    return r.groupBy("tier").agg(*(F.round(F.avg(k), 9).alias(k) for k in ("dual", "task", "gated")), F.count_if(F.col("gated") >= 0.999).alias("full"))


def verdict_prompt_selection(spark, sf_dir):
    """Tasks whose reward varies, the most varied first, 64 at most."""
    r = trials(spark, sf_dir).select("task", reward(F.lit(True), F.col("compiles"), F.col("invariant").cast("int"), F.col("scenario").cast("int"), F.col("invariant"), "task").alias("r"))
    per = r.groupBy("task").agg(F.round(F.avg("r"), 9).alias("mean"), F.round(F.stddev_pop("r"), 9).alias("sd"), F.round(F.count_if(F.col("r") >= 0.999) / F.count("*"), 9).alias("verified"))
    return per.filter("sd >= 0.05").orderBy(F.desc("sd"), "task").limit(64)


def verdict_masked(spark, sf_dir):
    """Means with and without an exclusion list (anti join)."""
    per = counts(line_trials(spark, sf_dir), "task", "tier").withColumn("p", F.col("c_valid") / F.col("n"))
    out = table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("task"))
    kept = per.join(out, "task", "left_anti").groupBy("tier").agg(F.round(F.avg("p"), 9).alias("kept"), F.count("*").alias("n_kept"))
    return per.groupBy("tier").agg(F.round(F.avg("p"), 9).alias("full"), F.count("*").alias("n_full")).join(kept, "tier", "left")


#: Rounds of the bootstraps: over tasks, over tasks and their trials, over tasks and seeds.
ROUNDS, TRIAL_ROUNDS, CELL_ROUNDS = 20000, 500, 2000


def hashed(salt: str, *parts):
    """A whole number below 2^60 from the parts, alike in both engines; as good as random."""
    word = F.md5(F.concat_ws(":", F.lit(salt), *parts).cast("binary"))
    return F.conv(F.substring(word, 1, 15), 16, 10).cast("long")


def hashed_draws(per, rounds: int):
    """per (with at from 0 and size) drawn anew with replacement: for each round b and place, a hash of both picks a row. All columns of a row come together.

    Each row makes its places of all rounds; what they pick is joined by number, by whatever join fits the size of per, which is a stored table.
    """
    spark = per.sparkSession
    dealt = per.select("at", "size").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "at")
    places = dealt.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rounds - 1).cast("long"))).alias("b"), "at", "size")
    pick = F.pmod(hashed("0", F.col("b"), F.col("at")), F.col("size"))
    return places.select("b", F.col("at").alias("place"), pick.alias("at")).join(per.drop("size"), "at")


def numbered(per, key: str):
    """per, stored, with at, from 0 by the key, and size. Ranges of the key are numbered apart."""
    rows = stored(per, "tasks")
    return stored(running(rows, [F.asc(key)], at=F.lit(1)).withColumns({"at": F.col("at").cast("long"), "size": F.lit(rows.count()).cast("long")}), "tasks")


def intervals(means, rounds: int, *metrics: str):
    """Of one row per round: mean and percentile interval of each metric by order statistics, and whether it leaves out 0."""
    s = F.array_sort(F.collect_list("m"))
    at = lambda share: F.round(F.element_at(s, min(int(rounds * share) + 1, rounds)), 9)
    out = means.unpivot(["b"], list(metrics), "metric", "m").groupBy("metric").agg(F.round(F.avg("m"), 9).alias("mean"), at(0.025).alias("low"), at(0.975).alias("high"))
    return out.withColumn("excludes_0", (F.col("low") > 0) | (F.col("high") < 0))


def task_means(spark, sf_dir):
    per = counts(trials(spark, sf_dir), "task", "tier")
    return numbered(per.select("task", "n", *((F.col(f"c_{c}") / F.col("n")).alias(c) for c in ("compiles", "invariant", "scenario", "valid")), "c_valid"), "task")


def verdict_bootstrap(spark, sf_dir):
    """Intervals of macro means over tasks drawn with replacement, for each metric."""
    names = ("compiles", "invariant", "scenario", "valid")
    means = hashed_draws(task_means(spark, sf_dir).select("at", "size", *names), ROUNDS).groupBy("b").agg(*(F.avg(n).alias(n) for n in names))
    return intervals(means, ROUNDS, *names)


def verdict_bootstrap_pairs(spark, sf_dir):
    """Intervals of the differences of each two metrics; the draws are shared, which pairs them."""
    names = ("compiles", "invariant", "scenario", "valid")
    means = hashed_draws(task_means(spark, sf_dir).select("at", "size", *names), ROUNDS).groupBy("b").agg(*(F.avg(n).alias(n) for n in names))
    pairs = {f"{a} - {c}": F.col(a) - F.col(c) for i, a in enumerate(names) for c in names[i + 1 :]}
    return intervals(means.select("b", *(c.alias(k) for k, c in pairs.items())), ROUNDS, *pairs)


def verdict_bootstrap_trials(spark, sf_dir):
    """Hierarchical: tasks are drawn, then for each draw its n trials anew, each a success with the task's share."""
    drawn = hashed_draws(task_means(spark, sf_dir).select("at", "size", "n", "c_valid"), TRIAL_ROUNDS)
    trial = drawn.select("b", "place", "n", "c_valid", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i"))
    won = F.pmod(hashed("1", F.col("b"), F.col("place"), F.col("i")), F.col("n")) < F.col("c_valid")
    per = trial.select("b", "place", "n", won.alias("won")).groupBy("b", "place", "n").agg((F.count_if("won") / F.col("n")).alias("p"))
    return intervals(per.groupBy("b").agg(F.avg("p").alias("valid")), TRIAL_ROUNDS, "valid")


def verdict_bootstrap_cells(spark, sf_dir):
    """Hierarchical over tasks (suppliers) and seeds (line numbers): for each task that is drawn one of the seeds, anew; a cell without trials counts as 0."""
    cells = line_trials(spark, sf_dir).groupBy("task", "seed").agg(F.avg(F.col("valid").cast("int")).alias("p"))
    tasks = numbered(cells.select("task").distinct(), "task")
    seeds = cells.select("seed").distinct().select("seed", (F.row_number().over(Window.orderBy("seed")) - 1).cast("long").alias("s"), F.count("*").over(Window.partitionBy(F.lit(0))).alias("n_seeds"))
    drawn = hashed_draws(tasks, CELL_ROUNDS).crossJoin(F.broadcast(seeds.select("n_seeds").distinct())).withColumn("s", F.pmod(hashed("2", F.col("b"), F.col("place")), F.col("n_seeds"))).drop("n_seeds")
    per = drawn.join(F.broadcast(seeds.select("seed", "s")), "s").join(cells, ["task", "seed"], "left")
    return intervals(per.groupBy("b").agg(F.avg(F.coalesce("p", F.lit(0.0))).alias("valid")), CELL_ROUNDS, "valid")


def verdict_bootstrap_resampled(spark, sf_dir):
    """Percentile intervals of two macro means and their difference over tasks drawn with replacement."""
    means = hashed_draws(task_means(spark, sf_dir).select("at", "size", "valid", "invariant"), ROUNDS).groupBy("b").agg(F.avg("valid").alias("valid"), F.avg("invariant").alias("invariant"))
    return intervals(means.withColumn("difference", F.col("invariant") - F.col("valid")), ROUNDS, "valid", "invariant", "difference")


def verdict_claims(spark, sf_dir):
    """Whether claims hold on all tasks and on those not masked: who leads, whether each tier keeps its rank and the sign of its distance to the next."""
    rows = line_trials(spark, sf_dir)

    def side(part, name):
        per = part.groupBy("tier").agg(F.round(F.avg(F.col("valid").cast("int")), 9).alias("v"))
        w = Window.orderBy(F.desc("v"), "tier")
        return per.select("tier", F.row_number().over(w).alias(f"rank_{name}"), F.round(F.col("v") - F.lead("v").over(Window.orderBy("tier")), 9).alias(f"gap_{name}"))

    both = side(rows, "all").join(side(rows.filter("task % 4 <> 1"), "masked"), "tier")
    return both.select("tier", "rank_all", "rank_masked", (F.col("rank_all") == F.col("rank_masked")).alias("same_rank"), (F.signum("gap_all") == F.signum("gap_masked")).alias("same_sign"), ((F.col("rank_all") == 1) & (F.col("rank_masked") == 1)).alias("leads"))


T = """t AS (SELECT doc_id, lang || ':' || source AS task, lang AS tier, n_chars >= 200 AS compiles, n_chars >= 200 AND toxic = 0 AS invariant, quality = 1 AS scenario,
          n_chars >= 200 AND toxic = 0 AND quality = 1 AS valid FROM documents JOIN labels USING (doc_id))"""
L = """t AS (SELECT l_suppkey AS task, r_name AS tier, l_linenumber AS seed, l_returnflag <> 'R' AS compiles, l_returnflag <> 'R' AND l_linestatus = 'F' AS invariant,
          l_discount <= CAST(0.05 AS DOUBLE) AS scenario, l_returnflag <> 'R' AND l_linestatus = 'F' AND l_discount <= CAST(0.05 AS DOUBLE) AS valid
          FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
O = f"""o AS (SELECT l_suppkey AS task, r_name AS tier, l_returnflag <> 'R' AND l_linestatus = 'F' AND l_discount <= CAST(0.05 AS DOUBLE) AS valid,
            row_number() OVER (PARTITION BY l_suppkey ORDER BY {', '.join(ARRIVAL)}) AS i
            FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
C = """c AS (SELECT task, tier, count(*) AS n, count(*) FILTER (compiles) AS c_compiles, count(*) FILTER (invariant) AS c_invariant, count(*) FILTER (scenario) AS c_scenario,
          count(*) FILTER (valid) AS c_valid FROM t GROUP BY 1, 2)"""


def sql_pass(n, c, k):
    k = f"least({k}, {n})"
    return f"(CASE WHEN {n} - {c} < {k} THEN 1.0 ELSE 1.0 - list_product([CAST({n} - {c} - i AS DOUBLE) / ({n} - i) FOR i IN range({k})]) END)"


def sql_by(c):
    return f"WITH {L}, r AS (SELECT tier, seed, avg(CAST(valid AS INTEGER)) AS v FROM t GROUP BY 1, 2) {c}"


HASH = "CAST('0x' || md5('{s}:' || {p})[1:15] AS BIGINT)"
DRAWN = f"""{T}, {C}, p AS (SELECT n, c_valid, c_compiles / n AS compiles, c_invariant / n AS invariant, c_scenario / n AS scenario, c_valid / n AS valid, row_number() OVER (ORDER BY task) - 1 AS pos FROM c),
        z AS (SELECT count(*) AS size FROM p), d AS (SELECT b, j, {HASH.format(s=0, p="b || ':' || j")} % size AS pos FROM z, range(ROUNDS) x(b), LATERAL (SELECT unnest(range(size)) AS j)),"""
INTERVALS = """r AS (SELECT metric, m, row_number() OVER (PARTITION BY metric ORDER BY m) AS i FROM u),
        s AS (SELECT metric, round(avg(m), 9) AS mean, round(max(m) FILTER (i = {low}), 9) AS low, round(max(m) FILTER (i = {high}), 9) AS high FROM r GROUP BY 1) SELECT *, low > 0 OR high < 0 AS excludes_0 FROM s"""
R = """r AS (SELECT *, CASE WHEN NOT compiles THEN 0.1 ELSE 0.3 + 0.7 * CAST(invariant AS INTEGER) END AS dual,
                 CASE WHEN NOT compiles THEN 0.1 ELSE 0.2 + 0.4 * CAST(invariant AS INTEGER) + 0.4 * CAST(scenario AS INTEGER) END AS task_ FROM t),
       g AS (SELECT *, CASE WHEN NOT invariant THEN least(task_, 0.1) ELSE task_ END AS gated FROM r)"""
ORACLE_SQL = {
    "verdict_counts": f"WITH {T}, {C} SELECT * FROM c",
    "verdict_pass_at_k": f"WITH {T}, {C} SELECT task, {', '.join(f'round({sql_pass('n', 'c_valid', k)}, 9) AS pass_{k}' for k in KS)} FROM c",
    "verdict_pass_at_k_modes": f"""WITH {T}, {C} SELECT task, round({sql_pass('n', 'c_valid', 5)}, 9) AS clamp,
        CASE WHEN n < 5 THEN CAST(c_valid > 0 AS INTEGER) ELSE round({sql_pass('n', 'c_valid', 5)}, 9) END AS "any",
        CASE WHEN n < 5 THEN 1.0 ELSE round({sql_pass('n', 'c_valid', 5)}, 9) END AS unclamped, CASE WHEN n >= 5 THEN round({sql_pass('n', 'c_valid', 5)}, 9) END AS require_n FROM c""",
    "verdict_macro_by_tier": f"""WITH {L}, {C} SELECT coalesce(tier, 'all') AS tier, count(*) AS tasks,
        {', '.join(f'round(avg({sql_pass('n', m, k)}), 9) AS {m}_{k}' for m in ('c_invariant', 'c_valid') for k in (1, 5))} FROM c GROUP BY ROLLUP (tier)""",
    "verdict_micro_rates": f"WITH {L}, {C} SELECT tier, {', '.join(f'round(sum(c_{m}) / sum(n), 9) AS {m}_rate' for m in ('compiles', 'invariant', 'scenario', 'valid'))} FROM c GROUP BY 1",
    "verdict_metric_cube": f"WITH {L}, {C} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, {k} AS k, round(avg({sql_pass('n', m, k)}), 9) AS mean FROM c" for m in ("c_compiles", "c_invariant", "c_scenario", "c_valid") for k in KS),
    "verdict_categories": f"""WITH {T}, x AS (SELECT tier, CASE WHEN NOT compiles THEN 'compile_error' WHEN NOT invariant THEN 'unsafe' WHEN NOT scenario THEN 'unknown' ELSE 'verified' END AS category FROM t)
        SELECT tier, category, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY tier), 9) AS share FROM x GROUP BY 1, 2""",
    "verdict_seed_spread": sql_by("SELECT tier, count(*) AS seeds, round(avg(v), 9) AS mean, round(stddev_pop(v), 9) AS sd_pop, round(coalesce(stddev_samp(v), 0), 9) AS sd_samp FROM r GROUP BY 1"),
    "verdict_paired_seeds": sql_by(""", n AS (SELECT tier, lead(tier) OVER (ORDER BY tier) AS after FROM (SELECT DISTINCT tier FROM r))
        SELECT n.tier, after, round(avg(b.v - a.v), 9) AS mean, round(stddev_pop(b.v - a.v), 9) AS sd FROM n JOIN r a ON a.tier = n.tier JOIN r b ON b.tier = after AND a.seed = b.seed GROUP BY 1, 2"""),
    "verdict_all_pairs": f"WITH {L}, {C}, m AS (SELECT tier, avg(c_valid / n) AS v FROM c GROUP BY 1) SELECT a.tier AS one, b.tier AS other, round(a.v - b.v, 9) AS d FROM m a JOIN m b ON a.tier < b.tier",
    "verdict_rank": f"""WITH {L}, a AS (SELECT tier, round(avg(CAST(valid AS INTEGER)), 9) AS v FROM t GROUP BY 1), b AS (SELECT tier, round(avg(CAST(valid AS INTEGER)), 9) AS v FROM t WHERE task > 10 GROUP BY 1),
        x AS (SELECT tier, CAST(row_number() OVER (ORDER BY v DESC, tier) AS INTEGER) AS rank_all FROM a), y AS (SELECT tier, CAST(row_number() OVER (ORDER BY v DESC, tier) AS INTEGER) AS rank_masked FROM b)
        SELECT tier, rank_all, rank_masked, rank_all = 1 AS leader, rank_all = rank_masked AS same FROM x JOIN y USING (tier)""",
    "verdict_leave_one_out": """WITH p AS (SELECT l_orderkey AS k, l_linenumber AS s, bool_and(l_discount <= CAST(0.05 AS DOUBLE) OR l_returnflag <> 'R') AS ok FROM lineitem GROUP BY 1, 2),
        o AS (SELECT k, count(*) AS n_scenarios, count(*) FILTER (NOT ok) AS bad FROM p GROUP BY 1 HAVING count(*) > 1)
        SELECT n_scenarios, count(*) AS samples, count(*) FILTER (bad = 0) AS pass_all, count(*) FILTER (bad = 1) AS fail_1, count(*) FILTER (bad > 1) AS fail_2plus FROM o GROUP BY 1""",
    "verdict_leave_one_out_by_order": """WITH p AS (SELECT l_orderkey AS k, l_linenumber AS scenario, bool_and(l_discount <= CAST(0.05 AS DOUBLE) OR l_returnflag <> 'R') AS ok FROM lineitem GROUP BY 1, 2),
        x AS (SELECT a.scenario FROM p a WHERE NOT a.ok AND a.k IN (SELECT k FROM p GROUP BY 1 HAVING count(*) > 1 AND count(*) FILTER (NOT ok) = 1)),
        f AS (SELECT s.scenario, count(x.scenario) AS flips FROM (SELECT DISTINCT scenario FROM p) s LEFT JOIN x ON s.scenario = x.scenario GROUP BY 1),
        a AS (SELECT CAST(sum(flips) AS BIGINT) AS total, max(flips) AS most, median(flips) AS median, round(avg(flips), 9) AS mean FROM f)
        SELECT * FROM f, a""",
    "verdict_best_of_k": f"""WITH {O} SELECT task, tier, CAST(coalesce(min(i) FILTER (valid), count(*)) AS BIGINT) AS calls, bool_or(valid) AS won FROM o WHERE i <= 10 GROUP BY 1, 2""",
    "verdict_best_of_k_in_order": f"""WITH {O},
        p AS (SELECT task, tier, coalesce(min(i) FILTER (valid), least(count(*), 10)) AS calls, coalesce(bool_or(valid), false) AS won FROM o WHERE i <= 10 GROUP BY 1, 2)
        SELECT tier, count(*) AS tasks, round(avg(CAST(won AS INTEGER)), 9) AS success, CAST(sum(calls) AS BIGINT) AS calls, round(avg(calls), 9) AS mean_calls FROM p GROUP BY 1""",
    "verdict_inflation": f"""WITH {L}, a AS (SELECT tier, avg(CAST(invariant AS INTEGER)) AS lax, avg(CAST(valid AS INTEGER)) AS strict FROM t GROUP BY 1)
        SELECT tier, round(lax - strict, 9) AS difference, round(lax / nullif(strict, 0), 9) AS ratio FROM a""",
    "verdict_quantifiers": f'WITH {L} SELECT task, bool_and(compiles) AS every, bool_or(valid) AS "some", count(DISTINCT seed) AS n_seeds FROM t GROUP BY 1',
    "verdict_two_by_two": f"""WITH {L} SELECT tier, count(*) FILTER (NOT invariant) AS killed_a, count(*) FILTER (NOT scenario) AS killed_b, count(*) FILTER (NOT invariant OR NOT scenario) AS killed,
        count(*) FILTER (NOT invariant AND NOT scenario) AS both, count(*) FILTER (invariant AND scenario) AS survived FROM t GROUP BY 1""",
    "verdict_rewards": f"WITH {T}, {R} SELECT tier, round(avg(CAST(dual AS DOUBLE)), 9) AS dual, round(avg(CAST(task_ AS DOUBLE)), 9) AS task, round(avg(CAST(gated AS DOUBLE)), 9) AS gated, count(*) FILTER (gated >= 0.999) AS \"full\" FROM g GROUP BY 1",
    "verdict_prompt_selection": f"""WITH {T}, {R}, p AS (SELECT task, round(avg(CAST(task_ AS DOUBLE)), 9) AS mean, round(stddev_pop(CAST(task_ AS DOUBLE)), 9) AS sd, round(count(*) FILTER (task_ >= 0.999) / count(*), 9) AS verified FROM g GROUP BY 1)
        SELECT * FROM p WHERE sd >= 0.05 ORDER BY sd DESC, task LIMIT 64""",
    "verdict_masked": f"""WITH {L}, {C}, k AS (SELECT tier, round(avg(c_valid / n), 9) AS kept, count(*) AS n_kept FROM c WHERE task NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY 1)
        SELECT tier, round(avg(c_valid / n), 9) AS "full", count(*) AS n_full, max(kept) AS kept, max(n_kept) AS n_kept FROM c LEFT JOIN k USING (tier) GROUP BY 1""",
    "verdict_bootstrap": f"""WITH {DRAWN.replace('ROUNDS', str(ROUNDS))} m AS (SELECT b, avg(compiles) AS compiles, avg(invariant) AS invariant, avg(scenario) AS scenario, avg(valid) AS valid FROM d JOIN p USING (pos) GROUP BY 1),
        u AS (UNPIVOT m ON compiles, invariant, scenario, valid INTO NAME metric VALUE m), {INTERVALS.format(low=ROUNDS // 40 + 1, high=ROUNDS * 39 // 40 + 1)}""",
    "verdict_bootstrap_pairs": f"""WITH {DRAWN.replace('ROUNDS', str(ROUNDS))} m AS (SELECT b, avg(compiles) AS c, avg(invariant) AS i, avg(scenario) AS s, avg(valid) AS v FROM d JOIN p USING (pos) GROUP BY 1),
        u AS (SELECT b, unnest(['compiles - invariant', 'compiles - scenario', 'compiles - valid', 'invariant - scenario', 'invariant - valid', 'scenario - valid']) AS metric, unnest([c - i, c - s, c - v, i - s, i - v, s - v]) AS m FROM m),
        {INTERVALS.format(low=ROUNDS // 40 + 1, high=ROUNDS * 39 // 40 + 1)}""",
    "verdict_bootstrap_trials": f"""WITH {DRAWN.replace('ROUNDS', str(TRIAL_ROUNDS))} e AS (SELECT b, j, n, c_valid, unnest(range(1, n + 1)) AS i FROM d JOIN p USING (pos)),
        t2 AS (SELECT b, j, avg(CAST({HASH.format(s=1, p="b || ':' || j || ':' || i")} % n < c_valid AS INTEGER)) AS v FROM e GROUP BY 1, 2), u AS (SELECT b, 'valid' AS metric, avg(v) AS m FROM t2 GROUP BY 1),
        {INTERVALS.format(low=int(TRIAL_ROUNDS * 0.025) + 1, high=int(TRIAL_ROUNDS * 0.975) + 1)}""",
    "verdict_bootstrap_cells": f"""WITH {L}, c AS (SELECT task, seed, avg(CAST(valid AS INTEGER)) AS v FROM t GROUP BY 1, 2), p AS (SELECT task, row_number() OVER (ORDER BY task) - 1 AS pos FROM (SELECT DISTINCT task FROM c)),
        q AS (SELECT seed, row_number() OVER (ORDER BY seed) - 1 AS s FROM (SELECT DISTINCT seed FROM c)), z AS (SELECT (SELECT count(*) FROM p) AS size, (SELECT count(*) FROM q) AS seeds),
        d AS (SELECT b, {HASH.format(s=0, p="b || ':' || j")} % size AS pos, {HASH.format(s=2, p="b || ':' || j")} % seeds AS s FROM z, range({CELL_ROUNDS}) x(b), LATERAL (SELECT unnest(range(size)) AS j)),
        u AS (SELECT b, 'valid' AS metric, avg(coalesce(v, 0)) AS m FROM d JOIN p USING (pos) JOIN q USING (s) LEFT JOIN c USING (task, seed) GROUP BY 1), {INTERVALS.format(low=CELL_ROUNDS // 40 + 1, high=CELL_ROUNDS * 39 // 40 + 1)}""",
    "verdict_claims": f"""WITH {L}, a AS (SELECT tier, round(avg(CAST(valid AS INTEGER)), 9) AS v FROM t GROUP BY 1), b AS (SELECT tier, round(avg(CAST(valid AS INTEGER)), 9) AS v FROM t WHERE task % 4 <> 1 GROUP BY 1),
        x AS (SELECT tier, CAST(row_number() OVER (ORDER BY v DESC, tier) AS INTEGER) AS r, sign(round(v - lead(v) OVER (ORDER BY tier), 9)) AS s FROM a), y AS (SELECT tier, CAST(row_number() OVER (ORDER BY v DESC, tier) AS INTEGER) AS r, sign(round(v - lead(v) OVER (ORDER BY tier), 9)) AS s FROM b)
        SELECT tier, x.r AS rank_all, y.r AS rank_masked, x.r = y.r AS same_rank, x.s = y.s AS same_sign, x.r = 1 AND y.r = 1 AS leads FROM x JOIN y USING (tier)""",
    "verdict_bootstrap_resampled": f"""WITH {T}, {C}, p AS (SELECT c_valid / n AS valid, c_invariant / n AS invariant, row_number() OVER (ORDER BY task) - 1 AS pos FROM c), z AS (SELECT count(*) AS size FROM p),
        d AS (SELECT b, CAST('0x' || md5('0:' || b || ':' || j)[1:15] AS BIGINT) % size AS pos FROM z, range({ROUNDS}) x(b), LATERAL (SELECT unnest(range(size)) AS j)),
        m AS (SELECT b, avg(valid) AS valid, avg(invariant) AS invariant FROM d JOIN p USING (pos) GROUP BY 1),
        u AS (SELECT b, 'valid' AS metric, valid AS m FROM m UNION ALL SELECT b, 'invariant', invariant FROM m UNION ALL SELECT b, 'difference', invariant - valid FROM m),
        o AS (SELECT metric, m, row_number() OVER (PARTITION BY metric ORDER BY m) AS i FROM u),
        s AS (SELECT metric, round(avg(m), 9) AS mean, round(max(m) FILTER (i = {ROUNDS // 40 + 1}), 9) AS low, round(max(m) FILTER (i = {ROUNDS * 39 // 40 + 1}), 9) AS high FROM o GROUP BY 1)
        SELECT *, low > 0 OR high < 0 AS excludes_0 FROM s""",
}
QUERIES = {k: globals()[k] for k in ORACLE_SQL}
