"""Mixing sources to target weights by entropy balancing, with DataFrame functions alone.

A document's size is its number of words, and a source's target a number of words (``targets``). Each document has a rate, how often the
mix takes it on the average. Of all rates in [0, most] that meet the targets, those of the largest entropy relative to taking everything
once are least(most, exp(lambda * size)) with one lambda a source; it solves a convex dual, by Newton's method with brackets. As a rate
depends on source and size only, each step sums over the table of sources and sizes with their numbers of documents, which is counted
once. Sums are of whole numbers, so neither tasks' order nor reruns change a digit.

Rates become copies by running sums over a source's sizes in falling order: sizes get the whole numbers their sums pass, so that the
error stays below half of the longest document. What is left is settled to the word on as few documents as can take it, longest first:
one document of a source is cut as a rule (``cut=False`` leaves all whole). Documents of one size take their copies in the order of a
hash of id and text.

No task sees all of a source: sums within blocks of sizes and of blocks, places within salted parts of a size.

Cases: null texts have no words and are taken as nothing, with all other columns; null sources are one source, the last; null ids and
repeated rows are documents like any others (equal rows may be taken differently often); a source without words has target 0; long
texts are counted in the JVM without an array of their words; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from traceloom.llm.common import delete, new_path, spread_join, stored, stored_at
from traceloom.operators.ranges import running, running_in_blocks

BLANK = r"\x20\x09-\x0D"
#: Parts of the documents of one source and size.
SALTS, SALT_BLOCK = 4096, 64
#: Sizes that are summed up together before blocks are.
BLOCK = 256
#: Whole numbers stand for copies and words in such parts.
COPY_PARTS, WORD_PARTS = 1 << 16, 1 << 10
MOST_STEPS, CLOSE = 80, 1e-7


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space. Each becomes one character, so no array of words is made."""
    runs = F.regexp_replace(text, rf"[{BLANK}]*+[^{BLANK}]++[{BLANK}]*+", "x")
    return F.when(text.rlike(rf"[^{BLANK}]"), F.char_length(runs)).otherwise(0).cast("long")


def source_key(source: Column) -> Column:
    """Text that sorts as sources do by code point, with null last."""
    return F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source.cast("string")))


def whole(value: Column) -> Column:
    return F.round(value).cast("decimal(38,0)")


def running_down(cells: DataFrame, name: str, value: Column) -> DataFrame:
    """cells with the sum of a value over the larger sizes of their source."""
    return running_in_blocks(cells, ["key"], "size", BLOCK, name, value, falling=True)


def targets(sources: DataFrame, most: int, weight: Column | None = None) -> DataFrame:
    """sources (key, source_size) with target: shares of all words by weight, none above most times the source's size.

    weight may use ``place``, a source's place from 0 in the order of keys; else weights are 1, 2, 3, repeating. Sources stop at their bound in
    the order of size by weight, so the ones that do are found by running sums over it.
    """
    placed = running(sources, [F.asc("key")], place=F.lit(1))
    weighed = placed.withColumn("weight", (F.pmod("place", F.lit(3)) + 1 if weight is None else weight).cast("long"))
    bound = most * F.col("source_size").cast("decimal(38,0)")
    all_of = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    order = [F.asc(F.col("source_size") / F.col("weight")), F.asc("key")]
    ranked = running(weighed, order, below=bound, weight_below=F.col("weight"))
    free, weights = all_of[0] - F.col("below"), all_of[1] - F.col("weight_below")
    stops = bound * weights < F.col("weight") * free
    ranked = stored(ranked.withColumn("stops", stops), "mix-targets")
    stopped = ranked.filter("stops").agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    left, over = float(all_of[0] - most * stopped[0]), float(all_of[1] - stopped[1])
    shared = F.col("weight") * F.lit(left) / F.lit(over or 1.0)
    return ranked.select("key", "source_size", F.when(F.col("stops"), bound.cast("double")).otherwise(shared).alias("target"))


def solve(cells: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """sources (key, source_size, target, n, least) with lam and mean: the rate of a document is least(most, exp(lam * size / mean)).

    A step is one pass over cells. A source's bracket [lo, hi] holds its lambda; a Newton step that would leave it halves it instead.
    """
    spark = cells.sparkSession
    mean = F.greatest(F.col("source_size") / F.col("n"), F.lit(1.0))
    ratio = F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))
    # At this lambda each document is taken at least, or at most, ratio times.
    end = F.when((F.col("source_size") > 0) & (F.col("target") > 0), F.log(ratio) * F.col("mean") / F.col("least")).otherwise(0.0)
    state = sources.withColumn("mean", mean).withColumn("end", end).select(
        "key", "source_size", "target", "mean", F.least("end", F.lit(0.0)).alias("lo"), F.greatest("end", F.lit(0.0)).alias("hi"),
        F.when(ratio >= most, F.col("end")).otherwise(0.0).alias("lam"), (F.col("end") == 0).alias("done"),
    )
    state, before = stored(state, "mix-dual"), None
    for _ in range(MOST_STEPS):
        c = F.col("size") / F.col("mean")
        rate = rate_of(most)
        words = F.col("n_docs") * F.col("size") * rate
        slope = F.when(rate < most, words * c).otherwise(0.0)
        sums = spread_join(cells, state.filter("not done").select("key", "mean", "lam"), "key", "size").groupBy("key").agg(
            (F.sum(whole(words * WORD_PARTS)).cast("double") / WORD_PARTS).alias("words"), (F.sum(whole(slope * WORD_PARTS)).cast("double") / WORD_PARTS).alias("slope")
        )
        off = F.col("words") - F.col("target")
        lo, hi = F.when(off < 0, F.col("lam")).otherwise(F.col("lo")), F.when(off > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - off / F.when(F.col("slope") > 0, F.col("slope"))
        step = F.when((newton > lo) & (newton < hi), newton).otherwise((lo + hi) / 2)
        done = F.coalesce((F.abs(off) <= F.greatest(F.lit(0.5), F.col("target") * CLOSE)) | (lo >= hi), F.col("done"))
        seen, path = Observation(), new_path(spark, "mix-dual")
        moved = state.join(sums, "key", "left").select(
            "key", "source_size", "target", "mean", F.coalesce(lo, "lo").alias("lo"), F.coalesce(hi, "hi").alias("hi"),
            F.when(done, F.col("lam")).otherwise(F.coalesce(step, "lam")).alias("lam"), done.alias("done"),
        )
        state = stored_at(moved.observe(seen, F.count_if(~F.col("done")).alias("open")), path)
        if before:
            delete(spark, before)
        before = path
        if not seen.get["open"]:
            break
    return state.select("key", "source_size", "target", "mean", "lam")


def rate_of(most: int) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.least(F.col("lam") * (F.col("size") / F.col("mean")), F.lit(50.0))))


def rounded(cells: DataFrame, most: int, cut: bool) -> DataFrame:
    """cells (key, size, n_docs, lam, mean, target) with copies, the whole copies of a cell's documents together, and rest, words of one more."""
    half, parts = COPY_PARTS // 2, F.lit(COPY_PARTS).cast("decimal(38,0)")
    want = whole(F.col("n_docs") * rate_of(most) * COPY_PARTS)
    up_to = running_down(cells.withColumn("want", want), "above", F.col("want"))
    up_to = up_to.withColumn("copies", F.expr(f"(above + want + {half}) div {COPY_PARTS} - (above + {half}) div {COPY_PARTS}")).drop("want", "above")
    if not cut:
        return up_to.withColumn("rest", F.lit(0).cast("long"))
    up_to = stored(up_to, "mix-copies")
    short = up_to.groupBy("key").agg((F.round(F.first("target")).cast("long") - F.sum(F.col("copies") * F.col("size"))).alias("short"))
    room = F.when(F.col("short") > 0, (most * F.col("n_docs") - F.col("copies")) * F.col("size")).otherwise(F.col("copies") * F.col("size"))
    settled = running_down(spread_join(up_to, short, "key", "size").withColumn("room", room), "larger", F.col("room"))
    more = F.signum("short").cast("long") * F.greatest(F.lit(0), F.least("room", F.abs("short") - F.col("larger")))
    words = F.col("copies") * F.col("size") + more
    return settled.withColumn("words", words).select(
        *(c for c in up_to.columns if c != "copies"),
        F.expr("if(size > 0, words div size, copies)").alias("copies"),
        F.expr("if(size > 0, words % size, 0)").cast("long").alias("rest"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = 3, weight: Column | None = None, cut: bool = True) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target (its source's), rate, taken (words of the mix that are its)."""
    mark = F.xxhash64(F.col(id_col), F.col(text_col))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), source_key(F.col(source_col)).alias("key"), word_count(text).alias("size"), mark.alias("mark"))
    rows = stored(rows.withColumn("salt", F.pmod(F.col("mark"), F.lit(SALTS)).cast("int")), "mix-sizes")
    parts = stored(rows.groupBy("key", "size", "salt").agg(F.count("*").alias("n_part")), "mix-parts")
    cells = stored(parts.groupBy("key", "size").agg(F.sum("n_part").alias("n_docs")), "mix-cells")
    sizes = cells.groupBy("key").agg(
        F.sum(F.col("size") * F.col("n_docs")).alias("source_size"), F.sum("n_docs").alias("n"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least")
    )
    sizes = stored(sizes, "mix-sources")
    goal = targets(sizes.select("key", "source_size"), most, weight)
    dual = solve(cells, goal.join(sizes.select("key", "n", "least"), "key"), most)
    given = rounded(spread_join(cells, dual, "key", "size"), most, cut).withColumn("rate", rate_of(most)).drop("lam", "mean")
    # Places of a size's documents: those of the parts before, and its own in its part.
    starts = running_in_blocks(parts, ["key", "size"], "salt", SALT_BLOCK, "start", F.col("n_part")).drop("n_part").join(given, ["key", "size"])
    own = Window.partitionBy("key", "size", "salt").orderBy("mark", "doc_id")
    placed = rows.withColumn("own", F.row_number().over(own)).join(starts, ["key", "size", "salt"]).withColumn("place", F.col("start") + F.col("own") - 1)
    each = F.expr("copies div n_docs + if(place < copies % n_docs, 1, 0)")
    taken = F.col("size") * each + F.when(F.col("place") == F.col("copies") % F.col("n_docs"), F.col("rest")).otherwise(0)
    return placed.select("doc_id", "source", "size", "source_size", "target", "rate", taken.cast("long").alias("taken"))
