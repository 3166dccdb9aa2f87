"""Names in program texts: uses of declared names are spelt as declared, by splicing tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Comments (also unclosed ones), strings, durations, numbers and names with a member, in this order; everything else lies between tokens.
TOKEN = r"(?s)\(\*.*?(?:\*\)|\z)|//[^\n]*|'[^'\n]*'|(?i:T(?:IME)?#[\w.]+)|\d[\w.#]*|[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?"
NAME = r"^[A-Za-z_][\w.]*$"
# Members of a timer, and words of the language that are no names.
MEMBERS = ("Q", "ET")
KEYWORDS = (
    "PROGRAM END_PROGRAM VAR VAR_INPUT VAR_OUTPUT VAR_IN_OUT VAR_TEMP END_VAR IF THEN ELSIF ELSE END_IF CASE OF END_CASE BOOL INT TON TIME TRUE FALSE AND OR NOT XOR MOD IN PT"
).split()


def with_names(programs: DataFrame, interface: DataFrame) -> DataFrame:
    """programs with ``names`` (a map from upper case to the declared spelling) and ``collides``, from an interface table (id, name)."""
    one = interface.filter("name is not null").groupBy("id", F.upper("name").alias("up")).agg(F.min("name").alias("name"), (F.count_distinct("name") > 1).alias("twice"))
    per = one.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("up", "name"))).alias("names"), F.bool_or("twice").alias("collides"))
    return programs.join(per, "id", "left").withColumns({"names": F.coalesce("names", F.create_map().cast("map<string,string>")), "collides": F.coalesce("collides", F.lit(False))})


def case_normalised(programs: DataFrame, interface: DataFrame, strict: bool = True) -> DataFrame:
    """id, status, code and fixes of programs (id, code) whose names are declared in interface (id, name).

    A name whose letters are those of a declared one but for their case becomes that one, and a timer's member is put in capitals; comments,
    strings and literals stay as they are. fixes counts names that changed. status: ``collision`` if two declared names differ in case only or one is
    the program's own name, else, with strict, ``undeclared`` if a name is neither declared nor a word of the language, ``member`` if a
    declared name has a member that timers don't have; else ``ok``. Only programs that are ok are changed.

    A text is cut into tokens and what lies between them, once, so time is proportional to its length.
    """
    texts = programs.select("id", F.coalesce("code", F.lit("")).alias("code"))
    cut = with_names(texts, interface).select(
        "id", "code", "names", "collides", F.regexp_extract_all("code", F.lit(TOKEN), F.lit(0)).alias("tokens"), F.split("code", TOKEN, -1).alias("gaps"),
        F.upper(F.regexp_extract("code", r"(?i)(?:^|[^A-Za-z0-9_])PROGRAM\s+([A-Za-z_]\w*)", 1)).alias("own"),
    )

    def look(token: Column) -> Column:
        base, member = F.split_part(token, F.lit("."), F.lit(1)), F.split_part(token, F.lit("."), F.lit(2))
        declared = F.when(token.rlike(NAME), F.try_element_at("names", F.upper(base)))
        known = F.upper(base).isin(*KEYWORDS) | (F.upper(base) == F.col("own"))
        fits = (member == "") | F.upper(member).isin(*MEMBERS)
        new = F.when(declared.isNull(), token).when(member == "", declared).otherwise(F.concat(declared, F.lit("."), F.when(fits, F.upper(member)).otherwise(member)))
        return F.struct(new.alias("new"), (declared != base).alias("fix"), (token.rlike(NAME) & declared.isNull() & ~known).alias("unknown"), (declared.isNotNull() & ~fits).alias("odd"))

    seen = cut.withColumn("seen", F.transform("tokens", look))
    collides = F.col("collides") | F.coalesce(F.try_element_at("names", F.col("own")).isNotNull(), F.lit(False))
    status = F.when(collides, "collision")
    if strict:
        status = status.when(F.exists("seen", lambda s: s["unknown"]), "undeclared").when(F.exists("seen", lambda s: s["odd"]), "member")
    status = status.otherwise("ok")
    spliced = F.array_join(F.flatten(F.zip_with("gaps", "seen", lambda g, s: F.array(g, F.coalesce(s["new"], F.lit(""))))), "")
    fixes = F.size(F.filter("seen", lambda s: F.coalesce(s["fix"], F.lit(False))))
    return seen.withColumn("status", status).select("id", "status", F.when(F.col("status") == "ok", spliced).otherwise(F.col("code")).alias("code"), F.when(F.col("status") == "ok", fixes).otherwise(0).alias("fixes"))
