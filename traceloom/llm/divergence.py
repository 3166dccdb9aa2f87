"""Audit of how far sources of one language differ in their words, with plain relational operators and whole numbers.

Words (runs of letters, A-Z lower-cased) are exploded and counted for each language and source. A language keeps the terms that enough of
its documents hold. All its sources get all of them, with zero where they have none, and so a smoothed share p of each term; the language
as a whole has one, too. A self-join on language and term compares sources: the sum of (p - q)^2 / q over all kept terms. And each source
is listed with the terms it uses more than its language does.

The sources of a language are numbered, and up to ``BLOCK`` of them are a block. A term's counts in a block's sources stand in one row, side by
side, so words meet in one row a block, not one a source, and the self-join is of blocks. A language of few sources has one block.

A few languages and sources hold all rows, so joins on them send the groups about, as long as they are few and short (``FEW_GROUPS``), or else deal
the terms out by hash as well. Rankings pass over terms below a value that enough others reach, and are cut down within parts of the terms first.
Words meet in partial sums before they are moved. Shares are of a thousand million.

Cases: null text, language or source count as empty text, which is a language or a source like others; groups without terms have zero
everywhere; a language without kept terms has value 0 in its pairs and no terms; repeated rows are documents of their own, ids don't
matter; a document's words are held as one array while it is read; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.llm.common import counted, stored

#: What lies between terms: splitting by it costs a fraction of extracting the terms, and gives the same ones besides empty ends.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_DOCS, MOST_RANK = 3, 200
SHARES = 1_000_000_000
#: Groups of language and source that may be sent to all tasks, and the bytes of their names together.
FEW_GROUPS, FEW_BYTES = 10_000, 4_000_000
#: Parts into which the terms of one language or source are dealt.
PARTS = 64
#: Sources of a language, at most, whose counts of a term stand in one row.
BLOCK = 32


def dealt(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(PARTS)).cast("int").alias("part")


def to_parts(small: DataFrame) -> DataFrame:
    """small once for each part."""
    return small.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))


def with_groups(rows: DataFrame, groups: DataFrame, on: list[str], spread: str, few: bool) -> DataFrame:
    """rows joined with a table of groups, of which each is wanted by a large share of the rows."""
    if few:
        return rows.join(F.broadcast(groups), on)
    return rows.withColumn("part", dealt(spread)).join(to_parts(groups), [*on, "part"]).drop("part")


def with_words(docs: DataFrame, text_col: str) -> DataFrame:
    """A row for each word, with docs' lang and whatever places its source: term, and first, which is 1 once a document and term, else 0.

    A document's words are sorted, so the first of equal ones is known without grouping by document.
    """
    at = [c for c in docs.columns if c != text_col]
    rows = docs.select(*at, F.sort_array(F.split(F.translate(text_col, UPPER, LOWER), BETWEEN)).alias("words"))
    # Each text has a part, so outer changes nothing but that Spark doesn't split and sort a text once more to see whether it has one.
    each = rows.select(*at, "words", F.posexplode_outer("words").alias("pos", "term"))
    first = F.when(F.col("term").eqNullSafe(F.get("words", F.col("pos") - 1)), 0).otherwise(1)
    return each.filter("term <> ''").select(*at, "term", first.alias("first"))


def block_counts(docs: DataFrame, groups: DataFrame, width: int, few: bool) -> DataFrame:
    """lang, block, term, n (occurrences), n_docs (documents with it) and held (occurrences in each source of the block), of all terms that occur.

    docs has lang, source and text; groups has the block and slot of each lang and source.
    """
    if few:
        words = with_words(docs.join(F.broadcast(groups), ["lang", "source"]).select("lang", "block", "slot", "text"), "text")
        n, n_docs, there = F.count("*"), F.sum("first"), lambda here: F.count(F.when(here, 1))
    else:
        words = with_words(docs, "text").groupBy("lang", "source", "term").agg(F.count("*").alias("n"), F.sum("first").alias("n_docs"))
        words = with_groups(words, groups, ["lang", "source"], "term", few)
        n, n_docs, there = F.sum("n"), F.sum("n_docs"), lambda here: F.sum(F.when(here, F.col("n")).otherwise(0))
    sums = words.groupBy("lang", "block", "term").agg(n.alias("n"), n_docs.alias("n_docs"), *(there(F.col("slot") == k).alias(f"slot{k}") for k in range(width)))
    return sums.select("lang", "block", "term", "n", "n_docs", F.array(*(f"slot{k}" for k in range(width))).alias("held"))


#: 1 + floor(SHARES * (n + 1) / (total + V)); where the product may pass 64 bits, in decimals.
WIDE = f"(cast({SHARES} as decimal(10,0)) * cast({{n}} + 1 as decimal(20,0))) div ({{total}} + n_kept)"
SHARE = f"cast(1 + if({{n}} < {SHARES}, ({SHARES}L * ({{n}} + 1)) div ({{total}} + n_kept), {WIDE}) as long)"


def share(n: str, total: str) -> Column:
    return F.expr(SHARE.format(n=n, total=total))


def excess(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def dense_counts(counts: DataFrame, groups: DataFrame, least_docs: int, width: int, one_block: bool, few: bool) -> DataFrame:
    """lang, block, term, held, n_lang: every block of a language with every term that the language keeps. Stored, as sums and shares both read it."""
    if one_block:  # each term has all its counts in one row
        dense = counts.filter(F.col("n_docs") >= least_docs).withColumnRenamed("n", "n_lang")
    else:
        counts = stored(counts, "divergence-counts")
        kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("n_docs").alias("d")).filter(F.col("d") >= least_docs).drop("d")
        crossed = with_groups(kept, groups.select("lang", "block").distinct(), ["lang"], "term", few)
        # One row a key on the right, and keys are spread evenly: a hash join spares the sort of both sides.
        dense = crossed.join(counts.drop("n", "n_docs").hint("shuffle_hash"), ["lang", "block", "term"], "left")
    none = F.array_repeat(F.lit(0).cast("long"), width)
    return stored(dense.select("lang", "block", "term", F.coalesce("held", none).alias("held"), "n_lang"), "divergence-dense")


def shares(dense: DataFrame, width: int, few: bool) -> DataFrame:
    """lang, block, term, held, p (the shares of the block's sources) and q (the language's) of each row of dense."""
    total = F.array(*(F.sum(F.col("held")[k]) for k in range(width)))
    totals = dense.groupBy("lang", "block").agg(total.alias("totals"), F.sum("n_lang").alias("total_lang"), F.count("*").alias("n_kept"))
    totals = stored(totals, "divergence-totals")
    p = F.expr(f"zip_with(held, totals, (n, total) -> {SHARE.format(n='n', total='total')})")
    return with_groups(dense, totals, ["lang", "block"], "term", few).select("lang", "block", "term", "held", p.alias("p"), share("n_lang", "total_lang").alias("q"))


def least_steps(more: DataFrame, most_rank: int) -> DataFrame:
    """lang, block, slot, least: the highest step of values such that most_rank terms of the source, or all, are on it or above it."""
    steps = more.groupBy("lang", "block", "slot", "step").agg(F.count("*").alias("terms"))
    above = F.coalesce(F.sum("terms").over(Window.partitionBy("lang", "block", "slot").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return steps.withColumn("above", above).filter(F.col("above") < most_rank).groupBy("lang", "block", "slot").agg(F.min("step").alias("least"))


def audit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, most_rank: int = MOST_RANK,
    few_groups: int = FEW_GROUPS, block: int = BLOCK,
) -> DataFrame:
    """lang, source, part, item, value, rank: pairs of sources of a language, and the terms that a source uses more than its language."""
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = docs.select(given(lang_col).alias("lang"), given(source_col).alias("source"), given(text_col).alias("text"))
    groups = docs.select("lang", "source").distinct().withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    groups, seen = counted(groups, "divergence-groups", n=F.count(F.lit(1)), size=F.sum(F.octet_length("lang") + F.octet_length("source")), most=F.max("no"))
    few = seen["n"] <= few_groups and (seen["size"] or 0) <= FEW_BYTES
    most = (seen["most"] or 0) + 1
    width = min(block, most)
    groups = groups.select("lang", "source", F.expr(f"cast(no div {width} as int)").alias("block"), F.expr(f"no % {width}").alias("slot"))
    counts = block_counts(docs, groups, width, few)
    # Stored once more, so that both sides of the self-join are one exchange.
    found = stored(shares(dense_counts(counts, groups, least_docs, width, most <= width, few), width, few), "divergence-shares")

    # Two blocks meet once, and in them two sources, and give the pair's value both ways.
    one, other = found.select("lang", "term", "block", "p"), found.select("lang", "term", F.col("block").alias("item_block"), F.col("p").alias("q"))
    blocks = one.join(other.hint("shuffle_hash"), ["lang", "term"]).filter("block <= item_block").select("lang", "block", "item_block", "q", F.posexplode("p").alias("slot", "p"))
    met = blocks.select("lang", "block", "item_block", "slot", "p", F.posexplode("q").alias("item_slot", "q")).filter("block < item_block or slot < item_slot")
    p, q = F.col("p"), F.col("q")
    both = met.groupBy("lang", "block", "slot", "item_block", "item_slot").agg(F.sum(excess(p, q)).alias("to"), F.sum(excess(q, p)).alias("back"))
    way = lambda *names: F.struct(*(F.col(c).alias(k) for c, k in zip(names, ("block", "slot", "item_block", "item_slot", "value"), strict=True)))
    ways = F.array(way("block", "slot", "item_block", "item_slot", "to"), way("item_block", "item_slot", "block", "slot", "back"))
    sums = both.select("lang", F.inline(ways))
    items = groups.select("lang", F.col("source").alias("item"), F.col("block").alias("item_block"), F.col("slot").alias("item_slot"))
    pairs = with_groups(groups, items, ["lang"], "source", few).filter("source <> item")
    pairs = pairs.join(sums, ["lang", "block", "slot", "item_block", "item_slot"], "left").withColumn("value", F.coalesce("value", F.lit(0)))

    each = found.select("lang", "block", "term", "q", "p", F.posexplode("held").alias("slot", "n")).filter("n > 0").withColumn("p", F.get("p", F.col("slot")))
    more = each.filter("p > q").select("lang", "block", "slot", F.col("term").alias("item"), excess(p, q).alias("value"))
    more = more.withColumn("step", F.floor(F.log2(F.col("value") + 1) * 8))
    marks = groups.join(stored(least_steps(more, most_rank), "divergence-least"), ["lang", "block", "slot"])
    more = with_groups(more, marks, ["lang", "block", "slot"], "item", few).filter("step >= least").select("lang", "source", "item", "value", dealt("item"))
    order = [F.desc("value"), F.asc("item")]
    within = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(*order))
    heads = more.withColumn("rank", within).filter(F.col("rank") <= most_rank).drop("rank", "part")
    ranked = lambda rows, kind: rows.select("lang", "source", F.lit(kind).alias("part"), "item", "value", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)).alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(heads, "term").filter(F.col("rank") <= most_rank))
