"""Queries of the template families, the spelling of names, group diagnostics and functions called from SQL text; parameters come from the parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from traceloom.functions import surface
from traceloom.functions import text as X
from traceloom.operators import grids, naming
from traceloom.plans import programs
from traceloom.plans.reports import SQL_DEFAULT, SQL_HARD
from traceloom.plans.traces import ALARM, S
from traceloom.sources.tables import table
from traceloom.streaming import metrics

ALL = {**grids.DEFAULT, **grids.HARD}


def picked(parts, family: str, grid: dict):
    """Parts (p_partkey, p_size) with the parameters of a family: the first by size, the second (or the only one) by key."""
    for i, (name, values) in enumerate(grid.items()):
        by = F.col("p_size") if i == 0 and len(grid) > 1 else F.floor(F.col("p_partkey") / len(ALL))
        at = F.pmod(by, F.lit(len(values))).cast("int")
        if isinstance(values[0], tuple):
            for place, side in enumerate(("a", "b")):
                parts = parts.withColumn(side, F.get(F.array(*(F.lit(v[place]) for v in values)), at))
        else:
            parts = parts.withColumn(name, F.get(F.array(*map(F.lit, values)), at))
    return parts


def of_families(spark, sf_dir, families: dict, make):
    """What make gives for each family's parts, put together; a part belongs to one family of all, by key."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    own = [make(picked(parts.filter(F.pmod("p_partkey", F.lit(len(ALL))) == i), f, ALL[f]), f) for i, f in enumerate(ALL) if f in families]
    return reduce(lambda a, b: a.unionByName(b), own)


def grid_of(spark, sf_dir, families: dict):
    rows = of_families(spark, sf_dir, families, lambda rows, f: grids.described(rows, f, "p_partkey"))
    text = F.array_join("formulas", "; ")
    return rows.groupBy("family", "id", "difficulty").agg(F.count("*").alias("n_parts"), F.min(F.size("formulas")).cast("long").alias("n_formulas"), F.min(text).alias("formulas"))


def grid_default(spark, sf_dir):
    """Tasks of the default families that the parts' parameters make, and how many parts make each."""
    return grid_of(spark, sf_dir, grids.DEFAULT)


def grid_hard(spark, sf_dir):
    """The same for the harder families."""
    return grid_of(spark, sf_dir, grids.HARD)


def grid_scenarios(spark, sf_dir):
    """Candidates of scenarios for each part's task, a row for each step."""
    return of_families(spark, sf_dir, ALL, lambda rows, f: grids.candidate_steps(rows, f, "p_partkey"))


def report_forms(spark, sf_dir):
    """Formulas of the parts' tasks by form, and how many outputs off satisfy (null counts as not).

    Of these families' formulas, one that is an implication from a negated output or input to a plain name is what outputs off fail; formulas with
    a count are left open.
    """
    tasks = of_families(spark, sf_dir, ALL, lambda rows, f: grids.described(rows, f, "p_partkey"))
    rows = tasks.select("family", F.explode("formulas").alias("f")).withColumn("body", X.without_globally(F.col("f")))
    right = F.regexp_extract("body", r"-> *(.*)$", 1)
    outs = F.array_distinct(F.concat(F.regexp_extract_all("body", F.lit("-> !?([A-Z][a-z]+(?:Slow|Fast)?)$"), F.lit(1)), F.regexp_extract_all("body", F.lit("^([A-Z][a-z]+(?:Slow|Fast)?) ->"), F.lit(1))))
    forces = F.rlike(right, F.lit("^[A-Z]")) & F.rlike("body", F.lit("^![A-Z]"))
    vacuous = F.when(F.contains(F.col("body"), F.lit("Count")), None).otherwise(~forces)
    formed = rows.withColumns({"form": X.formula_form(F.col("body"), outs, forces), "vacuous": vacuous})
    return formed.groupBy("form").agg(F.count("*").alias("n"), F.count_if("vacuous").alias("vacuous"), (F.count("*") - F.count_if("vacuous")).alias("not_vacuous"))


#: Parts' programs with other spellings of their names, and of a member; some with a name nobody declared, or one declared twice.
SPELT = r"replace(replace(replace({code}, 'q :=', 'Q :='), 't.Q', 'T.q'), CASE WHEN p_partkey % 9 = 4 THEN 'IF n' ELSE 'IF N' END, CASE WHEN p_partkey % 9 = 4 THEN 'IF level' ELSE 'IF N' END)"
FIRST_LINE = r"^[^\n]*"


def case_rows(programs_, interface, strict):
    out = naming.case_normalised(programs_, interface, strict)
    return out.select("id", "status", "fixes", F.sha1(F.col("code").cast("binary")).alias("digest"))


def program_case(spark, sf_dir):
    """Programs of the parts with all names spelt as they are declared; the interface lists a, n, t and q, and Q as well for some."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(SPELT.format(code=programs.CODE)).alias("code"), "p_partkey")
    names = F.array_compact(F.array(F.lit("a"), F.lit("n"), F.lit("t"), F.lit("q"), F.when(F.col("p_partkey") % 13 == 5, "Q")))
    return case_rows(rows.select("id", "code"), rows.select("id", F.explode(names).alias("name")), True)


def program_case_documents(spark, sf_dir):
    """All documents with the words of their first line as declared names: later uses are spelt like there, but not in what would be comments or literals."""
    rows = programs.texts(spark, sf_dir)
    words = F.regexp_extract_all(F.regexp_extract("code", FIRST_LINE, 0), F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
    return case_rows(rows, rows.filter("code is not null").select("id", F.explode(words).alias("name")), False)


def report_steps(spark, sf_dir):
    """Group diagnostics of steps: orders are groups of graded lines, and fifty steps take the orders in turn."""
    reward = F.when(F.col("l_quantity") > 25, 0.5).otherwise(0.0) + F.when(F.col("l_discount") > 0.05, 0.5).otherwise(0.0)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("grp"), reward.alias("reward"))
    stats = metrics.group_stats(rows).withColumn("step", F.pmod("grp", F.lit(50)))
    return metrics.step_row(stats, "step")


def sql_surface(spark, sf_dir):
    """A query in SQL text alone, over functions of the library: alarms of users by the table function, their chance of an alarm in five draws, ticks of a duration."""
    surface.register(spark)
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW traceloom_events AS SELECT * FROM parquet.`{sf_dir}/events.parquet`")
    return spark.sql("""
        WITH scans AS (SELECT user_id, ts, event_id, event_type = 'error' AS trip, event_type = 'signup' AS off FROM traceloom_events),
             held AS (SELECT * FROM latch(TABLE(SELECT * FROM scans), 'trip', 'off', 'user_id', 'ts,event_id')),
             per AS (SELECT user_id, CAST(count(*) AS INT) AS n, CAST(count_if(held) AS INT) AS c FROM held GROUP BY user_id)
        SELECT user_id, n, c, round(pass_at_k(n, c, 5), 9) AS chance, ticks(concat('T#', n, 'm', c, 's')) AS ticks, block_fault(concat('IF ', repeat('END_IF ', c % 3)), 'IF') AS fault FROM per""")


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


def sql_parameters(family: str) -> dict[str, str]:
    """DuckDB expressions of a family's parameters."""
    out, grid = {}, ALL[family]
    for i, (name, values) in enumerate(grid.items()):
        by = "p_size" if i == 0 and len(grid) > 1 else f"p_partkey // {len(ALL)}"
        at = f"CAST(({by}) % {len(values)} AS BIGINT) + 1"
        for place, side in enumerate(("a", "b")) if isinstance(values[0], tuple) else ((None, name),):
            out[side] = f"({sql_list(v if place is None else v[place] for v in values)})[{at}]"
    return out


def filled(template: str, values: dict[str, str]) -> str:
    parts, rest = [], template
    while rest:
        head, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += ([f"'{head}'"] if head else []) + ([f"CAST({values[name]} AS VARCHAR)"] if name else [])
    return " || ".join(parts) or "''"


def sql_scenarios(family: str) -> str:
    """A DuckDB list of scenarios, written out for each family."""
    v = sql_parameters(family)
    step = lambda inputs, expect="": f"{{'inputs': {inputs if inputs.startswith('(') else filled(inputs, v)}, 'expect': {filled(expect, v)}}}"
    one = lambda name, *steps: f"{{'scenario': '{name}', 'steps': [{', '.join(steps)}]}}"

    def flags(kind: str, n: str, off: bool = False) -> str:
        first = "CASE WHEN i = 1 THEN '=0' ELSE '=1' END" if off else "'=1'"
        return f"array_to_string(list_transform(range(1, CAST({v[n]} AS BIGINT) + 1), lambda i: ',{kind}' || i || {first}), '')"

    if family in ("multi_guard", "estop_bus"):
        start, stop, kind, name = ("StartPB", "StopPB", "G", "S_guard") if family == "multi_guard" else ("Start", "Stop", "E", "S_estop")
        on = step(f"('{start}=1,{stop}=0' || {flags(kind, 'n')})", "{out}=1")
        return f"[{one('S_on', on)}, {one('S_stop', on, step(f"('{start}=1,{stop}=1' || {flags(kind, 'n')})", '{out}=0'))}, {one(name, on, step(f"('{start}=1,{stop}=0' || {flags(kind, 'n', True)})", '{out}=0'))}]"
    if family == "safety_chain":
        both = lambda e, g: f"('Start=1,Stop=0' || {flags('E', 'a', e)} || {flags('G', 'b', g)})"
        on = step(both(False, False), "{out}=1")
        return f"[{one('S_on', on)}, {one('S_estop', on, step(both(True, False), '{out}=0'))}, {one('S_guard', on, step(both(False, True), '{out}=0'))}]"
    if family == "ondelay":
        held = f"list_transform(range({v['n']} + 2), lambda i: {{'inputs': 'StartCmd=1,EStop=1', 'expect': CASE WHEN i = {v['n']} + 1 THEN {filled('{out}=1', v)} ELSE '' END}})"
        return f"[{{'scenario': 'S_delay_on', 'steps': {held}}}, {one('S_estop', step('StartCmd=1,EStop=0', '{out}=0'))}]"
    if family in ("bounded_counter", "bounded_updown"):
        name, clear, up, down = ("S_count", "Pulse=0,Reset=1", "Pulse=1,Reset=0", "Pulse=0,Reset=0") if family == "bounded_counter" else ("S_up", "Inc=0,Dec=0,Reset=1", "Inc=1,Dec=0,Reset=0", "Inc=0,Dec=0,Reset=0")
        each = f"list_transform(range(1, 2 * {v['n']} + 1), lambda i: {{'inputs': CASE WHEN i % 2 = 1 THEN '{up}' ELSE '{down}' END, 'expect': CASE WHEN i = 2 * {v['n']} THEN {filled('{out}=1', v)} ELSE '' END}})"
        return f"[{{'scenario': '{name}', 'steps': list_concat([{step(clear, '{out}=0')}], {each})}}]"
    fixed = {
        "override_cutout": (("S_on", ("Demand=1,Enable=1,{trip}=0", "{out}=1")), ("S_trip", ("Demand=1,Enable=1,{trip}=0", "{out}=1"), ("Demand=1,Enable=1,{trip}=1", "{out}=0"))),
        "exclusive_two": (("S_a", ("ReqA=1,ReqB=0", "{a}=1,{b}=0")), ("S_b", ("ReqA=0,ReqB=1", "{a}=0,{b}=1"))),
        "hysteresis": (("S_low", ("Level={low}", "Actuator=1")), ("S_high", ("Level={low}", "Actuator=1"), ("Level={high}", "Actuator=0"))),
        "ordered_pair": (
            ("S_seq", ("Stop=0,EStop=1,StartA=1,StartB=0", "{a}=1"), ("Stop=0,EStop=1,StartA=1,StartB=1", "{a}=1,{b}=1")),
            ("S_estop", ("Stop=0,EStop=1,StartA=1,StartB=1", ""), ("Stop=0,EStop=0,StartA=1,StartB=1", "{a}=0,{b}=0")),
        ),
        "two_speed": (("S_slow", ("EStop=1,ReqSlow=1,ReqFast=0,FastEnable=0", "{out}Slow=1,{out}Fast=0")), ("S_fast", ("EStop=1,ReqSlow=0,ReqFast=1,FastEnable=1", "{out}Slow=0,{out}Fast=1"))),
    }[family]
    return "[" + ", ".join(one(name, *(step(*s) for s in steps)) for name, *steps in fixed) + "]"


#: Each part's task, and all tasks of the families by id.
TASKS = " UNION ALL ".join(f"SELECT p_partkey, {filled(grids.IDS[f], sql_parameters(f))} AS id FROM part WHERE p_partkey % {len(ALL)} = {i}" for i, f in enumerate(ALL))
SCENARIOS = " UNION ALL ".join(f"SELECT p_partkey, {filled(grids.IDS[f], sql_parameters(f))} AS id, unnest({sql_scenarios(f)}) AS s FROM part WHERE p_partkey % {len(ALL)} = {i}" for i, f in enumerate(ALL))
IN_GRID = """SELECT family, id, difficulty, count(*) AS n_parts, min(len(f)) AS n_formulas, min(array_to_string(f, '; ')) AS formulas FROM ({grid}) JOIN ({tasks}) USING (id) GROUP BY 1, 2, 3"""
CASE_PATTERN = naming.TOKEN.replace("'", "''")


def sql_case(programs_: str, names: str, strict: bool) -> str:
    """The same rule over lists; programs_ gives id, code and names gives id, name."""
    words = sql_list(naming.KEYWORDS)
    refused = f"""WHEN len(list_filter(seen, lambda s: s.unknown)) > 0 THEN 'undeclared' WHEN len(list_filter(seen, lambda s: s.odd)) > 0 THEN 'member'""" if strict else ""
    return rf"""WITH p AS (SELECT id, coalesce(code, '') AS code FROM ({programs_})), i AS (SELECT id, upper(name) AS up, min(name) AS name, count(DISTINCT name) > 1 AS twice FROM ({names}) GROUP BY 1, 2),
        m AS (SELECT id, map_from_entries(list({{'k': up, 'v': name}})) AS names, bool_or(twice) AS collides FROM i GROUP BY 1),
        c AS (SELECT p.id, code, names, coalesce(collides, FALSE) AS collides, regexp_extract_all(code, '{CASE_PATTERN}') AS tokens, string_split_regex(code, '{CASE_PATTERN}') AS gaps,
                     upper(regexp_extract(code, '(?i)(?:^|[^A-Za-z0-9_])PROGRAM\s+([A-Za-z_]\w*)', 1)) AS own FROM p LEFT JOIN m USING (id)),
        b AS (SELECT *, list_transform(tokens, lambda t: {{'t': t, 'base': split_part(t, '.', 1), 'member': split_part(t, '.', 2), 'named': regexp_matches(t, '^[A-Za-z_][\w.]*$'),
                     'decl': CASE WHEN regexp_matches(t, '^[A-Za-z_][\w.]*$') AND names IS NOT NULL THEN names[upper(split_part(t, '.', 1))] END}}) AS parts FROM c),
        e AS (SELECT *, list_transform(parts, lambda x: {{'fix': coalesce(x.decl <> x.base, FALSE), 'unknown': x.named AND x.decl IS NULL AND NOT list_contains({words}, upper(x.base)) AND upper(x.base) <> own,
                     'odd': x.decl IS NOT NULL AND x.member <> '' AND upper(x.member) NOT IN ('Q', 'ET'),
                     'new': CASE WHEN x.decl IS NULL THEN x.t WHEN x.member = '' THEN x.decl WHEN upper(x.member) IN ('Q', 'ET') THEN x.decl || '.' || upper(x.member) ELSE x.decl || '.' || x.member END}}) AS seen FROM b),
        s AS (SELECT *, CASE WHEN collides OR coalesce(names[own] IS NOT NULL, FALSE) THEN 'collision' {refused} ELSE 'ok' END AS status FROM e)
        SELECT id, status, CAST(CASE WHEN status = 'ok' THEN len(list_filter(seen, lambda s: s.fix)) ELSE 0 END AS INTEGER) AS fixes,
               sha1(CASE WHEN status = 'ok' THEN array_to_string(list_transform(range(1, len(gaps) + 1), lambda k: gaps[k] || coalesce(seen[k].new, '')), '') ELSE code END) AS digest FROM s"""


ORACLE_SQL = {
    "grid_default": IN_GRID.format(grid=SQL_DEFAULT, tasks=TASKS),
    "grid_hard": IN_GRID.format(grid=SQL_HARD, tasks=TASKS),
    "grid_scenarios": f"""WITH r AS ({SCENARIOS}), e AS (SELECT p_partkey, id, s.scenario AS scenario, unnest(s.steps) AS t, unnest(range(len(s.steps))) AS step FROM r)
        SELECT p_partkey, id, scenario, CAST(step AS INTEGER) AS step, t.inputs AS inputs, t.expect AS expect FROM e""",
    "report_forms": rf"""WITH g AS (SELECT f FROM ({SQL_DEFAULT} UNION ALL {SQL_HARD}) JOIN ({TASKS}) USING (id)), b AS (SELECT f[3:-2] AS body FROM (SELECT unnest(f) AS f FROM g)),
        o AS (SELECT body, list_concat(regexp_extract_all(body, '-> !?([A-Z][a-z]+(?:Slow|Fast)?)$', 1), regexp_extract_all(body, '^([A-Z][a-z]+(?:Slow|Fast)?) ->', 1)) AS outs, regexp_matches(body, '^![A-Z].*-> *[A-Z]') AS forces FROM b),
        f AS (SELECT CASE WHEN len(list_intersect(regexp_extract_all(body, '[A-Za-z_]\w*'), outs)) = 0 THEN 'input-only' WHEN contains(body, '&') AND contains(body, '!') AND NOT contains(body, '->') THEN 'mutual-exclusion' WHEN forces THEN 'positive-obligation'
            WHEN len(list_filter(outs, lambda o: regexp_matches(body, '!\s*' || o))) > 0 AND contains(body, '->') THEN 'guard->!out' ELSE 'other' END AS form, NOT contains(body, 'Count') AND NOT forces AS vac FROM o)
        SELECT form, count(*) AS n, count(*) FILTER (vac) AS vacuous, count(*) FILTER (NOT vac) AS not_vacuous FROM f GROUP BY 1""",
    "program_case": sql_case(
        f"SELECT p_partkey AS id, {SPELT.format(code=programs.CODE)} AS code FROM part",
        "SELECT p_partkey AS id, unnest(CASE WHEN p_partkey % 13 = 5 THEN ['a', 'n', 't', 'q', 'Q'] ELSE ['a', 'n', 't', 'q'] END) AS name FROM part", True,
    ),
    "program_case_documents": sql_case(
        "SELECT doc_id AS id, text AS code FROM documents", rf"SELECT doc_id AS id, unnest(regexp_extract_all(regexp_extract(text, '{FIRST_LINE}'), '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM documents WHERE text IS NOT NULL", False,
    ),
    "report_steps": """WITH r AS (SELECT l_orderkey AS grp, CASE WHEN l_quantity > 25 THEN 0.5 ELSE 0 END + CASE WHEN l_discount > 0.05 THEN 0.5 ELSE 0 END AS r FROM lineitem),
        m AS (SELECT *, avg(r) OVER (PARTITION BY grp) AS m, count(*) OVER (PARTITION BY grp) AS n FROM r),
        g AS (SELECT grp, count(*) AS n, sum(r) AS total, CASE WHEN count(*) > 1 THEN round(stddev_pop(r), 12) END AS sd, count(*) FILTER (n > 1 AND round(r, 12) <> round(m, 12)) AS nz FROM m GROUP BY 1)
        SELECT grp % 50 AS step, CAST(sum(n) AS BIGINT) AS n, round(sum(total) / sum(n), 4) AS reward_mean, round(coalesce(sum(sd), 0) / greatest(count(sd), 1), 4) AS group_reward_std_mean,
               round(count(*) FILTER (sd = 0) / greatest(count(sd), 1), 4) AS zero_variance_group_frac, round(sum(nz) / sum(n), 4) AS nonzero_advantage_frac FROM g GROUP BY 1""",
    "sql_surface": f"""WITH {S}, {ALARM}, p AS (SELECT user_id, CAST(count(*) AS INTEGER) AS n, CAST(count(*) FILTER (alarm) AS INTEGER) AS c FROM a GROUP BY 1)
        SELECT user_id, n, c, round(CASE WHEN n - c < least(5, n) THEN 1 ELSE 1 - list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(least(5, n)), lambda i: (n - c - i)::DOUBLE / (n - i))), lambda x, y: x * y) END, 9) AS chance,
               CAST(60 * n + c AS BIGINT) AS ticks, CASE WHEN c % 3 <> 1 THEN 'unbalanced IF/END_IF: 1 vs ' || c % 3 END AS fault FROM p""",
}
QUERIES = {k: globals()[k] for k in ORACLE_SQL}
