"""Text functions for programs, formulas, prompts and checker output, all of them built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Block keywords in the order in which faults are listed, and the suffixes that VAR may carry.
BLOCKS = ("PROGRAM", "FUNCTION_BLOCK", "VAR", "IF", "CASE", "FOR", "WHILE")
VAR_SUFFIXES = ("_INPUT", "_OUTPUT", "_IN_OUT", "_GLOBAL", "_TEMP")
BLOCK_WORDS = rf"(?=[{''.join(sorted({b[0] for b in BLOCKS} | {'E'}))}])\b(?:END_)?(?:{'|'.join(BLOCKS)}|VAR(?:{'|'.join(VAR_SUFFIXES)}))\b"
# Seconds in a unit of time.
UNITS = {"ms": 0.001, "s": 1.0, "m": 60.0, "h": 3600.0, "d": 86400.0}
# A fence's info string, the operators of branching time, how operators of formulas are spelt, and what a cut trace ends in.
FENCE_INFO = r"[A-Za-z0-9_+\-]*"
BRANCHING = ("AG", "EF", "AX", "EX", "AF", "EG", "A[", "E[")
SPELLINGS = ((" AND ", " & "), (" OR ", " | "), (" NOT ", " !"), ("<>", "!="))
CUT_MARK = "\n... (trace truncated)"
BLANKS = " \t\r\n\f\x0b"


def trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def without_comments(code: Column) -> Column:
    """Block comments (not nested) and line comments, each as a space."""
    return F.regexp_replace(F.regexp_replace(code, r"(?s)\(\*.*?\*\)", " "), r"//[^\n]*", " ")


# Where a reply's program is. The text of its first fenced block, and in that the span from PROGRAM to END_PROGRAM in any case.
FENCED = rf"(?s)```{FENCE_INFO}\s*\n(.*?)```"
SPAN = r"(?is)PROGRAM\b.*?\bEND_PROGRAM"


def program_of(reply: Column) -> Column:
    """The program in a reply: of its first fenced block (even if that is empty), or else of the whole text, from PROGRAM to END_PROGRAM,
    or else all of it, trimmed."""
    body = F.when(reply.rlike(FENCED), F.regexp_extract(reply, FENCED, 1)).otherwise(reply)
    span = F.regexp_extract(body, SPAN, 0)
    return trimmed(F.when(span == "", body).otherwise(span))


def block_faults(code: Column) -> Column:
    """What is opened more or less often than closed, comments aside, as ``unbalanced IF/END_IF: 2 vs 1``, joined by ``; ``.

    The text is passed over once for the words of all blocks, whose list is then counted.
    """
    words = F.regexp_extract_all(F.upper(without_comments(code)), F.lit(BLOCK_WORDS), F.lit(0))

    def fault(words: Column, name: str) -> Column:
        opening = [name + suffix for suffix in ("", *(VAR_SUFFIXES if name == "VAR" else ()))]
        opened, closed = F.size(F.filter(words, lambda w: w.isin(opening))), F.size(F.filter(words, lambda w: w == f"END_{name}"))
        return F.when(opened != closed, F.concat(F.lit(f"unbalanced {name}/END_{name}: "), opened, F.lit(" vs "), closed))

    faults = F.transform(F.array(words), lambda w: F.array_join(F.array_compact(F.array(*(fault(w, name) for name in BLOCKS))), "; "))
    return F.when(code.isNotNull(), F.get(faults, 0))


def balanced(code: Column) -> Column:
    return block_faults(code) == ""


def ticks(literal: Column) -> Column:
    """A duration such as T#1m30s, T#1.5s or T#1_000ms in whole seconds, halves to even; null if it doesn't begin as one."""
    body = F.lower(F.replace(F.regexp_replace(literal, "^[^#]*#", ""), F.lit("_")))
    parts = F.regexp_extract_all(body, F.lit(r"([0-9]*\.?[0-9]+\s*(?:ms|s|m|h|d))"), F.lit(1))
    size = F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair))
    seconds = lambda p: F.regexp_extract(p, r"[0-9.]+", 0).cast("double") * F.element_at(size, F.regexp_extract(p, "[a-z]+", 0))
    return F.when(literal.rlike("(?i)^T(?:IME)?#"), F.bround(F.aggregate(parts, F.lit(0.0), lambda a, p: a + seconds(p))).cast("long"))


def mentions_one_second(code: Column) -> Column:
    """The loose detector: ``T#1s`` in any case, also as the beginning of a longer literal."""
    return code.rlike("(?i)t#1s")


def has_one_second(code: Column) -> Column:
    """The strict detector: a literal of one second and no more, with zeros in front and blanks inside allowed."""
    return code.rlike(r"(?i)T#0*1\s*s(?![0-9a-z])")


def presets_less_one(code: Column) -> tuple[Column, Column]:
    """Each timer preset ``PT := T#Ns`` with N less one (0 at least), and how many there are."""
    preset = r"(?i)(PT\s*:=\s*)T#(\d+)s"
    heads, numbers = F.regexp_extract_all(code, F.lit(preset), F.lit(1)), F.regexp_extract_all(code, F.lit(preset), F.lit(2))
    less = F.transform(numbers, lambda n: F.greatest(n.cast("decimal(38,0)") - 1, F.lit(0)).cast("string"))
    new = F.zip_with(heads, less, lambda h, n: F.concat(h, F.lit("T#"), n, F.lit("s")))
    around = F.split(code, preset, -1)
    return F.array_join(F.flatten(F.zip_with(around, new, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), ""), F.size(numbers)


def program_name(code: Column) -> Column:
    found = F.regexp_extract(code, r"\bPROGRAM\s+(\w+)", 1)
    return F.when(found == "", "prog").otherwise(found)


def header(code: Column) -> Column:
    """The declarations, through the last END_VAR and a line end; without any, the line of PROGRAM; without that, the first character."""
    last = F.regexp_extract(code, r"(?s)^.*\bEND_VAR\b", 0)
    line = F.regexp_extract(code, r"(?s)^(.*?\bPROGRAM\s+\w+[^\n]*\n)", 1)
    return F.when(last != "", F.concat(last, F.lit("\n"))).when(line != "", line).otherwise(F.substring(code, 1, 1))


def idle_program(code: Column, outputs: Column, mode: str) -> Column:
    """The header of a program with a body that holds all outputs (name, type, low, high) ``off`` or ``on``, or none (``empty``)."""
    value = lambda v: F.when(v["type"] == "BOOL", "FALSE" if mode == "off" else "TRUE").otherwise((F.coalesce(v["low"], F.lit(0)) if mode == "off" else F.coalesce(v["high"], F.lit(1))).cast("string"))
    lines = F.lit("") if mode == "empty" else F.array_join(F.transform(outputs, lambda v: F.concat(F.lit("    "), v["name"], F.lit(" := "), value(v), F.lit(";"))), "\n")
    return F.concat(header(code), F.lit("\n"), lines, F.lit("\n\nEND_PROGRAM\n"))


def identifiers(formula: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(formula, F.lit(r"([A-Za-z_]\w*)"), F.lit(1))))


def unknown_names(formula: Column, known: Column) -> Column:
    """Names in a formula that are neither operators nor known."""
    return F.array_except(identifiers(formula), F.concat(known, F.array(*map(F.lit, ("G", "X", "F", "U", "TRUE", "FALSE", "AND", "OR", "NOT")))))


def normalised(formula: Column) -> Column:
    """Operators as signs."""
    for word, sign in SPELLINGS:
        formula = F.replace(formula, F.lit(word), F.lit(sign))
    return formula


def is_branching(formula: Column) -> Column:
    """Whether an operator of branching time is in it, by its letters alone: a name such as FLAG counts too."""
    out = F.lit(False)
    for name in BRANCHING:
        out = out | F.contains(formula, F.lit(name))
    return out


def without_globally(formula: Column) -> Column:
    """What stands in ``G(...)``, if that is the whole formula."""
    plain = trimmed(formula)
    return F.when(plain.startswith("G(") & plain.endswith(")"), plain.substr(F.lit(3), F.length(plain) - 3)).otherwise(plain)


def formula_form(body: Column, outputs: Column, forces: Column) -> Column:
    """The form of an invariant, the first that fits. outputs: names of outputs; forces: whether it fails with all outputs off."""
    own = F.array_intersect(identifiers(body), outputs)
    negated = F.exists(outputs, lambda o: F.rlike(body, F.concat(F.lit(r"!\s*"), o)))
    return (
        F.when(F.size(own) == 0, "input-only")
        .when(F.contains(body, F.lit("&")) & F.contains(body, F.lit("!")) & ~F.contains(body, F.lit("->")), "mutual-exclusion")
        .when(forces, "positive-obligation")
        .when(negated & F.contains(body, F.lit("->")), "guard->!out")
        .otherwise("other")
    )


def probes(low: Column, high: Column) -> Column:
    """Values at which a range of whole numbers is tried: its ends, its middle and a few fixed ones, in order."""
    values = F.array(low, high, F.floor((low + high) / 2).cast("int"), F.least(high, F.lit(10)), F.least(high, F.lit(90)), F.greatest(low, F.lit(3)))
    return F.array_sort(F.array_distinct(F.filter(values, lambda v: (v >= low) & (v <= high))))


def short_digest(code: Column) -> Column:
    return F.substring(F.sha1(code.cast("binary")), 1, 12)


def seed_of(text: Column) -> Column:
    return F.conv(F.substring(F.sha1(text.cast("binary")), 1, 8), 16, 10).cast("long")


def outcome(parsed: Column, compiled: Column, available: Column, statuses: Column) -> Column:
    """Outcome of a trial; what fails first decides. compiled: null where no compiler was there; statuses: of its properties."""
    held = F.coalesce(F.size(statuses) > 0, F.lit(False)) & F.forall(statuses, lambda s: s == "pass")
    return (
        F.when(~parsed, "parse_error").when(~compiled, "compile_error").when(~F.coalesce(available, F.lit(False)), "verify_unavailable")
        .when(F.array_contains(statuses, "error"), "translate_error").when(held, "verified").when(F.array_contains(statuses, "fail"), "unsafe").otherwise("unknown")
    )


FALSE_LINE, TRUE_LINE = "(?i)specification .* is false", "(?i)specification .* is true"


def checker_status(output: Column, timed_out: Column | None = None) -> Column:
    """unknown if it ran out of time; fail if a specification is reported false, else pass if one is true, else error."""
    status = F.when(output.rlike(FALSE_LINE), "fail").when(output.rlike(TRUE_LINE), "pass").otherwise("error")
    return status if timed_out is None else F.when(timed_out, "unknown").otherwise(status)


def joint_status(output: Column, n_properties: Column) -> Column:
    """Of a run over several specifications: fail if any is false, pass if all are reported true, else error."""
    n_true = F.regexp_count(output, F.lit(TRUE_LINE))
    return F.when(F.regexp_count(output, F.lit(FALSE_LINE)) > 0, "fail").when((n_true == n_properties) & (n_properties > 0), "pass").otherwise("error")


def counterexample(output: Column, lines: int = 60) -> Column:
    """At most that many lines from the first one that reports a specification false, trimmed; empty if none does."""
    split = F.split(output, "\r?\n", -1)
    at = F.array_position(F.transform(split, lambda s: s.rlike(FALSE_LINE)), True)
    return F.when(at > 0, trimmed(F.array_join(F.slice(split, F.greatest(at.cast("int"), F.lit(1)), lines), "\n"))).when(output.isNotNull(), "")


def task_prompt(spec: Column, interface: Column, rules: Column) -> Column:
    """What is asked for, the interface, a line for each variable (with its range if it has one), and the rules, a line each."""
    bounds = lambda v: F.when(v["range"].isNotNull(), F.concat(F.lit(", range ["), F.array_join(v["range"].cast("array<string>"), ", "), F.lit("]"))).otherwise("")
    line = lambda v: F.concat(F.lit("  - "), v["name"], F.lit(" : "), v["type"], F.lit(" ["), v["direction"], bounds(v), F.lit("] - "), v["description"])
    return F.concat_ws(
        "\n", F.lit("REQUIREMENT:"), spec, F.lit(""), F.lit("INTERFACE (use exactly these names and directions):"), F.array_join(F.transform(interface, line), "\n"), F.lit(""),
        F.lit("RULES:"), F.array_join(F.transform(rules, lambda r: F.concat(F.lit("- "), r)), "\n"),
    )


def file_name(spec: Column) -> Column:
    """A model's spec, ``provider:model``, as the name of the file that holds its results."""
    return F.concat(F.translate(spec, ":/", "__"), F.lit(".json"))


def display_name(spec: Column) -> Column:
    """The last part of a model's name with its provider behind."""
    return F.concat(F.split_part(F.split_part(spec, F.lit(":"), F.lit(-1)), F.lit("/"), F.lit(-1)), F.lit(" ("), F.split_part(spec, F.lit(":"), F.lit(1)), F.lit(")"))


def constrained(prompt: Column, block: str) -> Column:
    return F.concat(prompt, F.lit(block))


def shown_trace(trace: Column, limit: int = 1500) -> Column:
    """A trace, trimmed, and cut with a mark if it is longer than the limit; null counts as empty."""
    plain = trimmed(F.coalesce(trace, F.lit("")))
    return F.when(F.length(plain) > limit, F.concat(F.substring(plain, 1, limit), F.lit(CUT_MARK))).otherwise(plain)


REPAIR_TASK = "Write this program anew so that all its properties hold. Answer with the program alone."
FEEDBACK = ("full", "nocex", "proponly", "erroronly", "shuffle")


def repair_prompt(kind: str, prompt: Column, code: Column, property_id: Column, meaning: Column, trace: Column, other_trace: Column | None = None) -> Column:
    """A prompt in sections: what was asked, the program that failed, what is said of it, what to do. Kinds differ in the third section only: the finding
    with its trace (full, or shuffle: the trace of another item), no section (nocex), the finding alone (proponly), or that there is one (erroronly)."""
    section = lambda name, *parts: F.concat(F.lit(f"\n\n[{name}]\n"), *parts)
    finding = section("finding", property_id, F.lit(": "), meaning)
    said = {"nocex": F.lit(""), "proponly": finding, "erroronly": section("finding", F.lit("there is one"))}
    if kind in ("full", "shuffle"):
        own = trace if kind == "full" or other_trace is None else F.coalesce(F.nullif(other_trace, F.lit("")), trace)
        said[kind] = F.concat(finding, section("trace", shown_trace(own)))
    return F.concat(prompt, section("program", code), said[kind], section("task", F.lit(REPAIR_TASK)))
