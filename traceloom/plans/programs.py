"""Queries over program texts: a program for each part, of five shapes, and all documents; extraction, lint, detectors, formulas, mutants and bugs."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceloom.functions import text as X
from traceloom.operators import mutation
from traceloom.sources.tables import table

#: A program for each part, as an expression that both engines read; some leave a block open, some end early.
CODE = r"""concat('PROGRAM P', p_partkey, chr(10), 'VAR_INPUT', chr(10), '  a : BOOL; n : INT;', chr(10), 'END_VAR', chr(10), 'VAR t : TON; q : BOOL; END_VAR', chr(10),
    CASE CAST(p_partkey % 5 AS INT)
        WHEN 0 THEN concat('IF n >= ', p_size, ' OR NOT a THEN', chr(10), '  q := FALSE;', chr(10), 'ELSIF a AND n < ', p_size + 7, ' THEN', chr(10), '  q := TRUE;', chr(10), 'END_IF;', chr(10))
        WHEN 1 THEN concat('t(IN := a, PT := T#', p_size % 12, 's);', chr(10), 'q := t.Q; (* IF ', p_name, ' *)', chr(10))
        WHEN 2 THEN concat('IF a & n <= ', p_size, ' THEN', chr(10), '  q := TRUE;', chr(10))
        WHEN 3 THEN concat('// ', p_name, ' IF', chr(10), 'CASE n OF', chr(10), ' ', p_size, ': q := FALSE;', chr(10), 'END_CASE;', chr(10))
        ELSE concat('IF n > ', p_size, ' OR n < 3 OR a THEN q := FALSE; END_IF;', chr(10), 'q', chr(10), ' := n <> 9; t(PT := T#1s500ms, IN := q);', chr(10)) END,
    CASE WHEN p_partkey % 11 = 3 THEN '' ELSE 'END_PROGRAM' END)"""
REPLY = """CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN concat('Here:', chr(10), '```st', chr(10), code, chr(10), '```', chr(10), 'Done.') WHEN 1 THEN concat('Sure. ', code, ' That is all.')
    WHEN 2 THEN concat('```', chr(10), '``` ', code) WHEN 3 THEN concat('  ', p_name, chr(10)) WHEN 4 THEN concat('```st', chr(10), p_name, chr(10), '```', code) ELSE '' END"""
LITERAL = """CASE CAST(p_partkey % 8 AS INT) WHEN 0 THEN concat('T#', p_size, 's') WHEN 1 THEN concat('t#', p_size, 'm', p_size, 's') WHEN 2 THEN concat('T#', p_size * 250, 'ms')
    WHEN 3 THEN concat('T#', p_size, '.5s') WHEN 4 THEN concat('T#', p_size, '_000ms') WHEN 5 THEN concat('T#1d', p_size, 'h') WHEN 6 THEN concat('T#.', p_size, ' h') ELSE concat(p_size, 's') END"""
FORMULA = """CASE CAST(p_partkey % 7 AS INT) WHEN 0 THEN 'G(a -> !q)' WHEN 1 THEN concat('G(q -> n >= ', p_size, ')') WHEN 2 THEN 'G(!(q & r))' WHEN 3 THEN concat('G(n <= ', p_size, ')')
    WHEN 4 THEN ' G(q -> X(q | a)) ' WHEN 5 THEN 'AG (FLAG AND n <> 3 OR NOT r)' ELSE concat('q AND ', replace(p_name, ' ', '_')) END"""
OUTPUTS = ("q", "r")


def parts(spark, sf_dir, dealt: bool = False):
    """A program for each part; dealt: over all shuffle partitions, as a few bytes of a file that can't be split may mean much work."""
    rows = table(spark, sf_dir, "part")
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey") if dealt else rows
    return rows.withColumn("code", F.expr(CODE)).withColumnRenamed("p_partkey", "id")


def column(spark, sf_dir, expression: str, name: str):
    rows = table(spark, sf_dir, "part").withColumn("code", F.expr(CODE))
    return rows.select(F.col("p_partkey").alias("id"), F.expr(expression).alias(name))


def texts(spark, sf_dir):
    """All documents as programs."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("code"))


def lint(programs):
    c = F.col("code")
    return programs.select("id", X.balanced(c).alias("balanced"), X.block_faults(c).alias("faults"), F.length(X.without_comments(c)).alias("n_plain"), X.short_digest(c).alias("digest"))


def program_lint(spark, sf_dir):
    """Which blocks are left open, and where comments are long."""
    return lint(parts(spark, sf_dir))


def program_lint_documents(spark, sf_dir):
    return lint(texts(spark, sf_dir))


def program_extract(spark, sf_dir):
    """Programs out of replies, fenced or not."""
    return column(spark, sf_dir, REPLY, "reply").select("id", X.program_of(F.col("reply")).alias("program"))


def program_extract_documents(spark, sf_dir):
    return texts(spark, sf_dir).select("id", X.program_of(F.col("code")).alias("program"))


def program_durations(spark, sf_dir):
    return column(spark, sf_dir, LITERAL, "literal").select("id", "literal", X.ticks(F.col("literal")).alias("ticks"))


def program_detectors(spark, sf_dir):
    """Literals of one second: the loose and the strict detector, and programs with presets that are one less."""
    c = F.col("code")
    less, n = X.presets_less_one(c)
    return parts(spark, sf_dir).select("id", X.mentions_one_second(c).alias("loose"), X.has_one_second(c).alias("strict"), F.md5(less).alias("less_one"), n.cast("long").alias("n_presets"))


def program_formulas(spark, sf_dir):
    """Bodies, spelling, forms and unknown names of formulas."""
    f, outputs = F.col("formula"), F.array(*map(F.lit, OUTPUTS))
    rows = column(spark, sf_dir, FORMULA, "formula").withColumn("body", X.without_globally(f))
    forces = F.col("id") % 2 == 0
    unknown = F.array_join(X.unknown_names(f, F.array(F.lit("a"), F.lit("n"), *map(F.lit, OUTPUTS))), ",")
    return rows.select("id", "body", X.normalised(f).alias("signs"), X.is_branching(f).alias("branching"), X.formula_form(F.col("body"), outputs, forces).alias("form"), unknown.alias("unknown"))


def program_probes(spark, sf_dir):
    """Values at which an input between two bounds is tried."""
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") - 20).alias("low"), (F.col("p_size") * (F.col("p_partkey") % 4).cast("int")).alias("high")).filter("low <= high")
    return rows.select(F.col("p_partkey").alias("id"), F.array_join(X.probes(F.col("low"), F.col("high")).cast("array<string>"), ",").alias("probes"))


def program_idle(spark, sf_dir):
    """The header of each program with outputs held off, held on or left alone."""
    outputs = F.array(
        F.struct(F.lit("q").alias("name"), F.lit("BOOL").alias("type"), F.lit(None).cast("int").alias("low"), F.lit(None).cast("int").alias("high")),
        F.struct(F.lit("m").alias("name"), F.lit("INT").alias("type"), F.col("p_size").alias("low"), (F.col("p_size") + 5).alias("high")),
    )
    c = F.col("code")
    return parts(spark, sf_dir).select("id", X.program_name(c).alias("name"), *(X.idle_program(c, outputs, m).alias(m) for m in ("off", "on", "empty")))


def program_mutants(spark, sf_dir):
    return mutation.mutants(parts(spark, sf_dir)).select("id", "rule", "offset", "mutant")


def program_mutants_documents(spark, sf_dir):
    """Mutants of all documents, each a whole text: the result grows with the square of a document's length, and nothing else is written."""
    return mutation.mutants(texts(spark, sf_dir)).select("id", "rule", "offset", "mutant")


def program_first_bugs(spark, sf_dir):
    """The three bug rules, and how many different bugs each program has."""
    rows = mutation.first_bugs(parts(spark, sf_dir))
    n = F.size(F.array_distinct(F.array_compact(F.array("weaken_or", "flip_compare", "force_true"))))
    return rows.select("id", "weaken_or", "flip_compare", "force_true", n.cast("long").alias("n_bugs"))


def checker_output(spark, sf_dir):
    """A checker's report for each order: a line for each order line, and now and then a trace, nothing or a time-out."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.struct("l_linenumber", "l_partkey", "l_quantity", "l_discount", F.concat(F.lit("-- specification G(n < "), F.col("l_linenumber"), F.lit(") is "), F.when(F.col("l_discount") > 0.08, "false").otherwise("TRUE")).alias("t")).alias("s")
    )
    rows = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("s")).alias("s"))
    body = F.array_join(F.transform("s", lambda s: s["t"]), "\n")
    out = F.when(F.col("l_orderkey") % 13 == 0, "").otherwise(F.concat(F.lit("checker\n"), body, F.lit("\nend  ")))
    return rows.select(F.col("l_orderkey").alias("id"), out.alias("output"), F.size("s").alias("n"), (F.col("l_orderkey") % 17 == 0).alias("late"))


def program_checker_status(spark, sf_dir):
    """Verdicts from a checker's report: by the first rule that fits, over all specifications, and the counterexample."""
    o = F.col("output")
    return checker_output(spark, sf_dir).select("id", X.checker_status(o, F.col("late")).alias("status"), X.joint_status(o, F.col("n")).alias("joint"), F.md5(X.counterexample(o, 4)).alias("trace"))


P = f"p AS (SELECT p_partkey AS id, {CODE} AS code, * FROM part)"
D = "p AS (SELECT doc_id AS id, text AS code FROM documents)"
LINT = r"""c AS (SELECT id, code, regexp_replace(regexp_replace(code, '(?s)\(\*.*?\*\)', ' ', 'g'), '//[^\n]*', ' ', 'g') AS s FROM p),
    n AS (SELECT id, w, o, len(regexp_extract_all(upper(s), '\b' || w || v || '\b')) AS a, len(regexp_extract_all(upper(s), '\bEND_' || w || '\b')) AS b
          FROM c, (VALUES (1, 'PROGRAM', ''), (2, 'FUNCTION_BLOCK', ''), (3, 'VAR', '(?:_INPUT|_OUTPUT|_IN_OUT|_GLOBAL|_TEMP)?'), (4, 'IF', ''), (5, 'CASE', ''), (6, 'FOR', ''), (7, 'WHILE', '')) k(o, w, v)),
    f AS (SELECT id, string_agg('unbalanced ' || w || '/END_' || w || ': ' || a || ' vs ' || b, '; ' ORDER BY o) AS faults FROM n WHERE a <> b GROUP BY 1)
    SELECT id, CASE WHEN code IS NOT NULL THEN faults IS NULL END AS balanced, CASE WHEN code IS NOT NULL THEN coalesce(faults, '') END AS faults, CAST(length(s) AS INTEGER) AS n_plain,
        left(sha1(code), 12) AS digest FROM c LEFT JOIN f USING (id)"""
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
EXTRACT = rf"""f AS (SELECT id, reply, regexp_matches(reply, '(?s)```[A-Za-z0-9_+\-]*\s*\n(.*?)```') AS fenced, regexp_extract(reply, '(?s)```[A-Za-z0-9_+\-]*\s*\n(.*?)```', 1) AS f FROM r),
    g AS (SELECT id, CASE WHEN fenced THEN f ELSE reply END AS b FROM f), h AS (SELECT *, regexp_extract(b, '(?is)PROGRAM\b.*?\bEND_PROGRAM') AS s FROM g)
    SELECT id, trim(CASE WHEN s = '' THEN b ELSE s END, {SPACES}) AS program FROM h"""
#: Written from the rules: each place by its pattern, what stands before it (so its offset), and the text anew.
MUTANTS = r"""k(rule, pattern) AS (VALUES ('bool_flip', '\b(?:TRUE|FALSE)\b'), ('compare', '>=|<=|>|<'), ('connective', '\b(?:AND|OR)\b|&|\|'), ('negate_condition', '\b(?:IF|ELSIF)\s+'),
        ('drop_statement', '(?m)^[ \t]*\w+\s*:=[^;]*;'), ('preset', 'T#\d+s'), ('constant', '[<>]=?\s*\d+')),
    x AS (SELECT id, rule, code, regexp_extract_all(code, pattern) AS f, string_split_regex(code, pattern) AS parts FROM p, k),
    y AS (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM x),
    z AS (SELECT id, rule, f[i] AS t, left(code, o) AS head, substr(code, o + length(f[i]) + 1) AS rest, o FROM (SELECT *, length(array_to_string(parts[1:i], '')) + length(array_to_string(f[1:i - 1], '')) AS o FROM y))
    SELECT id, rule, CAST(o + CASE WHEN rule = 'negate_condition' THEN length(t) ELSE 0 END AS INTEGER) AS "offset", head || CASE
        WHEN rule = 'drop_statement' THEN '(* mut *)' || rest
        WHEN rule = 'negate_condition' THEN t || 'NOT (' || CASE WHEN contains(rest, 'THEN') THEN left(rest, instr(rest, 'THEN') - 1) || ') THEN' || substr(rest, instr(rest, 'THEN') + 4) ELSE rest END
        WHEN rule = 'preset' THEN 'T#' || (CAST(regexp_extract(t, '\d+') AS BIGINT) + 1) || 's' || rest
        WHEN rule = 'constant' THEN regexp_extract(t, '^\D*') || (CAST(regexp_extract(t, '\d+') AS BIGINT) + 1) || rest
        ELSE CASE t WHEN 'TRUE' THEN 'FALSE' WHEN 'FALSE' THEN 'TRUE' WHEN '>=' THEN '<=' WHEN '<=' THEN '>=' WHEN '>' THEN '<' WHEN '<' THEN '>' WHEN 'AND' THEN 'OR' WHEN 'OR' THEN 'AND' WHEN '&' THEN '|' ELSE '&' END || rest
        END AS mutant FROM z"""

BUGS = r"""c AS (SELECT id, code, regexp_extract(code, '(?s)^(.*?\bIF\s+)(.+?)\s+THEN', 1) AS head, regexp_extract(code, '(?s)^(.*?\bIF\s+)(.+?)\s+THEN', 2) AS cond FROM p),
    d AS (SELECT *, string_split_regex(cond, '\s+OR\s+') AS parts, instr(code, '>=') AS ge, instr(code, '<=') AS le, instr(code, ':= FALSE;') AS off FROM c),
    e AS (SELECT id, CASE WHEN len(parts) > 1 THEN head || array_to_string(parts[2:], ' OR ') || substr(code, length(head) + length(cond) + 1) END AS weaken_or,
        CASE WHEN ge > 0 THEN left(code, ge - 1) || '>' || substr(code, ge + 2) WHEN le > 0 THEN left(code, le - 1) || '<' || substr(code, le + 2) END AS flip_compare,
        CASE WHEN off > 0 THEN left(code, off - 1) || ':= TRUE;' || substr(code, off + 9) END AS force_true FROM d)"""

ORACLE_SQL = {
    "program_lint": f"WITH {P}, {LINT}",
    "program_lint_documents": f"WITH {D}, {LINT}",
    "program_extract": f"WITH {P}, r AS (SELECT id, {REPLY} AS reply FROM p), {EXTRACT}",
    "program_extract_documents": f"WITH r AS (SELECT doc_id AS id, text AS reply FROM documents), {EXTRACT}",
    "program_durations": rf"""WITH l AS (SELECT p_partkey AS id, {LITERAL} AS literal FROM part),
        m AS (SELECT *, regexp_extract_all(replace(lower(regexp_replace(literal, '^[^#]*#', '')), '_', ''), '[0-9]*\.?[0-9]+\s*(?:ms|s|m|h|d)') AS parts FROM l),
        s AS (SELECT *, coalesce(list_sum([CAST(regexp_extract(x, '[0-9.]+') AS DOUBLE) * CASE regexp_extract(x, '[a-z]+') WHEN 'ms' THEN 0.001 WHEN 's' THEN 1 WHEN 'm' THEN 60 WHEN 'h' THEN 3600 ELSE 86400 END FOR x IN parts]), 0) AS total FROM m)
        SELECT id, literal, CASE WHEN literal LIKE 'T#%' OR literal LIKE 't#%' THEN CAST(round_even(total, 0) AS BIGINT) END AS ticks FROM s""",
    "program_detectors": rf"""WITH {P}, m AS (SELECT id, code, string_split_regex(code, '(?i)PT\s*:=\s*T#\d+s') AS around, regexp_extract_all(code, '(?i)(PT\s*:=\s*)T#(\d+)s', 1) AS heads, regexp_extract_all(code, '(?i)(PT\s*:=\s*)T#(\d+)s', 2) AS nums FROM p)
        SELECT id, contains(lower(code), 't#1s') AS loose, regexp_matches(code, '(?i)T#0*1\s*s(?:[^0-9a-z]|$)') AS strict,
            md5(array_to_string([around[i] || CASE WHEN i <= len(nums) THEN heads[i] || 'T#' || greatest(CAST(nums[i] AS BIGINT) - 1, 0) || 's' ELSE '' END FOR i IN range(1, len(around) + 1)], '')) AS less_one,
            len(nums) AS n_presets FROM m""",
    "program_formulas": rf"""WITH f AS (SELECT p_partkey AS id, {FORMULA.replace("code", "''")} AS formula FROM part), t AS (SELECT *, trim(formula) AS t FROM f),
        b AS (SELECT *, CASE WHEN starts_with(t, 'G(') AND ends_with(t, ')') THEN t[3:-2] ELSE t END AS body FROM t),
        n AS (SELECT *, list_distinct(regexp_extract_all(body, '[A-Za-z_]\w*')) AS names FROM b)
        SELECT id, body, replace(replace(replace(replace(formula, ' AND ', ' & '), ' OR ', ' | '), ' NOT ', ' !'), '<>', '!=') AS signs,
            regexp_matches(formula, 'AG|EF|AX|EX|AF|EG|A\[|E\[') AS branching,
            CASE WHEN NOT (list_contains(names, 'q') OR list_contains(names, 'r')) THEN 'input-only' WHEN contains(body, '&') AND contains(body, '!') AND NOT contains(body, '->') THEN 'mutual-exclusion'
                WHEN id % 2 = 0 THEN 'positive-obligation' WHEN regexp_matches(body, '!\s*[qr]') AND contains(body, '->') THEN 'guard->!out' ELSE 'other' END AS form,
            array_to_string(list_filter(list_sort(list_distinct(regexp_extract_all(formula, '[A-Za-z_]\w*'))), lambda n: n NOT IN ('a', 'n', 'q', 'r', 'G', 'X', 'F', 'U', 'TRUE', 'FALSE', 'AND', 'OR', 'NOT')), ',') AS unknown FROM n""",
    "program_probes": """WITH r AS (SELECT p_partkey AS id, p_size - 20 AS lo, p_size * (p_partkey % 4) AS hi FROM part),
        v AS (SELECT id, lo, hi, unnest([lo, hi, CAST(floor((lo + hi) / 2) AS BIGINT), least(hi, 10), least(hi, 90), greatest(lo, 3)]) AS v FROM r WHERE lo <= hi)
        SELECT id, string_agg(v, ',' ORDER BY v) AS probes FROM (SELECT DISTINCT id, v FROM v WHERE v BETWEEN lo AND hi) GROUP BY 1""",
    "program_idle": rf"""WITH {P}, h AS (SELECT *, left(code, length(code) - length(array_slice(string_split(code, 'END_VAR'), -1, -1)[1])) || chr(10) AS h FROM p)
        SELECT id, 'P' || id AS name, h || chr(10) || '    q := FALSE;' || chr(10) || '    m := ' || p_size || ';' || chr(10) || chr(10) || 'END_PROGRAM' || chr(10) AS off,
            h || chr(10) || '    q := TRUE;' || chr(10) || '    m := ' || (p_size + 5) || ';' || chr(10) || chr(10) || 'END_PROGRAM' || chr(10) AS "on",
            h || chr(10) || chr(10) || chr(10) || 'END_PROGRAM' || chr(10) AS empty FROM h""",
    "program_mutants": f"WITH {P}, {MUTANTS}",
    "program_mutants_documents": f"WITH {D}, {MUTANTS}",
    "program_first_bugs": f"WITH {P}, {BUGS} SELECT *, len(list_distinct([weaken_or, flip_compare, force_true])) AS n_bugs FROM e",
    "program_checker_status": r"""WITH r AS (SELECT l_orderkey AS id, count(*) AS n, count(*) FILTER (l_discount > CAST(0.08 AS DOUBLE)) AS bad, string_agg('-- specification G(n < ' || l_linenumber || ') is ' || CASE WHEN l_discount > CAST(0.08 AS DOUBLE) THEN 'false' ELSE 'TRUE' END,
            chr(10) ORDER BY l_linenumber, l_partkey, l_quantity, l_discount) AS body FROM lineitem GROUP BY 1),
        o AS (SELECT *, CASE WHEN id % 13 = 0 THEN '' ELSE 'checker' || chr(10) || body || chr(10) || 'end  ' END AS output FROM r),
        l AS (SELECT *, list_position([contains(x, 'is false') FOR x IN string_split(output, chr(10))], true) AS pos FROM o)
        SELECT id, CASE WHEN id % 17 = 0 THEN 'unknown' WHEN output = '' THEN 'error' WHEN bad > 0 THEN 'fail' ELSE 'pass' END AS status,
            CASE WHEN output = '' THEN 'error' WHEN bad > 0 THEN 'fail' ELSE 'pass' END AS joint,
            md5(CASE WHEN pos > 0 THEN trim(array_to_string(string_split(output, chr(10))[pos:pos + 3], chr(10))) ELSE '' END) AS trace FROM l""",
}
QUERIES = {k: globals()[k] for k in ORACLE_SQL}
