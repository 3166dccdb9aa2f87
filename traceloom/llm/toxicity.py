"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of the words of two lexicons (words that mark toxic texts, and the strongest of them), how near they
stand to words of the second person and to each other, shares of capitals, exclamation and other punctuation, and of obfuscated words
(letters mixed with digits or signs, letters repeated or spaced out) as such and as spellings of lexicon words. The lexicons are
learned: words and beginnings of words that stand in many more contexts in toxic than in other texts, by log odds, over a bounded
sample of the labelled rows: of those of the ``sample`` labels with the smallest hashes ``sample`` distinct rows at most and, in the
order of hashes, as many as have ``SAMPLE_CHARS`` characters in all. The trees are fitted on four fifths of that sample and the isotonic map on the rest.

Cases: null and empty texts have all features 0 and get a score like any other; rows with null ids or labels are not learned from;
an id with both labels counts as 1; repeated rows score alike, and count once in the sample; very long texts count as
a whole (a task holds the words of one text); with one class or no labels to learn from every score is the share of label 1 (0 without
labels); extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceloom.llm.common import bounded_sample, counted, ddl, id_bucket, slices, stored, text_batches

SAMPLE, SAMPLE_CHARS, TREES, DEPTH, THRESHOLD, STEMS = 5000, 50_000_000, 12, 3, 0.5, (4, 5, 6)
PAIRS_AT_ONCE = 500_000
#: Words of the second person in the languages at hand (fixed values).
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer usted ustedes ti contigo".split())
#: Signs and digits that stand for letters (fixed values).
LOOKALIKE = str.maketrans("013457@$!|", "oieastasil")
NEAR = 6
TOKEN = re.compile(r"\S+")
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
MIXED = re.compile(r"[^\W\d_][\d@$!|*]+[^\W\d_]")
REPEATED = re.compile(r"([^\W\d_])\1{2,}")
SPACED = re.compile(r"\b(?:[^\W\d_][ .\-*_]){3,}[^\W\d_]\b")
#: What every match of SPACED has in it, quicker to look for.
SPACED_HINT = re.compile(r"[ .\-*_].[ .\-*_].[ .\-*_]", re.S)
FEATURES = [
    "lexicon", "strong", "lexicon_any", "strong_any", "distinct", "weight", "near_you", "near_each", "you", "upper", "shouts", "marks",
    "mixed", "repeated", "spaced", "hidden", "length",
]


def plain(word: str) -> str:
    return EDGE.sub("", word.lower())


def unmasked(word: str) -> str:
    """The word with look-alikes read as letters, other signs gone and long repeats shortened."""
    return REPEATED.sub(r"\1", re.sub(r"[\W_]+", "", word.lower().strip(".,;:?").translate(LOOKALIKE)))


def units(word: str) -> list[str]:
    """The word, and its beginnings, which words that are spelt or inflected in many ways share."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


def weigh(word: str, lexicon: dict[str, float]) -> float:
    """The largest weight of the word's units, or 0."""
    best = lexicon.get(word, 0.0)
    for k in STEMS:
        if len(word) > k and (w := lexicon.get(word[:k] + "*", 0.0)) > best:
            best = w
    return best


def contexts_of(text: str) -> tuple[int, set[tuple[str, int]]]:
    """Number of words, and the text's units, each with a hash of the word before."""
    words = [plain(w) for w in text.split()]
    return len(words), {(u, zlib.crc32(before.encode("utf-8", "surrogatepass"))) for before, w in zip(["", *words], words, strict=False) for u in units(w)}


def contexts(rows: DataFrame, among: set[str] | None = None) -> DataFrame:
    """(unit, n): in how many different contexts (the word before) each unit stands; and a row without unit for the number of words."""
    shared = rows.sparkSession.sparkContext.broadcast(among)

    def run(batches):
        found: set[tuple[str, int]] = set()
        total = 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.string()), pa.array([c for _, c in found], pa.int64())], names=["unit", "context"])

        for batch in batches:
            for t in batch.column("text"):
                n, own = contexts_of(t.as_py() or "")
                total += n
                found |= own if shared.value is None else {x for x in own if x[0] in shared.value}
                if len(found) >= PAIRS_AT_ONCE:
                    yield out()
                    found = set()
        yield out()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([total], pa.int64())], names=["unit", "context"])

    each = rows.select("text").mapInArrow(run, "unit string, context long")
    pairs = each.filter("unit <> ''").distinct().groupBy("unit").agg(F.count("*").alias("n"))
    return pairs.unionByName(each.filter("unit is null").groupBy("unit").agg(F.sum("context").alias("n")))


def learn_lexicon(rows: DataFrame, most: int = 400) -> dict[str, float]:
    """Units and their log odds in toxic texts, in units of its error, from rows of (text, label).

    What counts is in how many different contexts a unit stands, so that copied passages don't make words toxic. Spark counts them; of
    the units of the (bounded) sample those with 5 toxic contexts or more come to the driver.
    """
    bad = {r.unit: r.n for r in contexts(rows.filter("label = 1")).filter("n >= 5 or unit is null").collect()}
    total = [1, 1 + bad.pop(None, 0)]
    rest = {r.unit: r.n for r in contexts(rows.filter("label = 0"), set(bad)).collect()}
    total[0] += rest.pop(None, 0)
    found = {}
    for u, c in bad.items():
        a, b = c + 0.5, rest.get(u, 0) + 0.5
        odds = math.log(a / total[1]) - math.log(b / total[0])
        z = odds / math.sqrt(1 / a + 1 / b)
        if odds > 2 and z > 3.5:
            found[u] = z
    return dict(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:most])


UNMARKED = (None, 0.0, False, False, False, False)


class WordMarks(dict):
    """What a word is, worked out once: (lexicon word or None, its weight, second person, odd, letters repeated, hidden lexicon word).

    Forgets everything when it holds ``most`` words, so that its memory is bounded.
    """

    def __init__(self, lexicon: dict[str, float], most: int = 200_000):
        self.lexicon, self.most = lexicon, most

    def __missing__(self, word: str) -> tuple:
        low = word.lower()
        core = low.strip(".,;:!?()'\"-")
        simple = core.isalpha()  # then no sign is left to strip, and none stands between letters
        low = core if simple else EDGE.sub("", low)
        weight, repeated = weigh(low, self.lexicon), bool(REPEATED.search(word))
        odd = repeated or (not simple and bool(MIXED.search(word)))
        second = low in SECOND_PERSON
        out = UNMARKED
        if weight or odd or second:
            hidden = odd and not weight and weigh(unmasked(word), self.lexicon) > 0
            out = (low if weight else None, weight, second, odd, repeated, hidden)
        if len(self) >= self.most:
            self.clear()
        self[word] = out
        return out


def features(text: str, marks: WordMarks, strong: float) -> list[float]:
    words = text.split()
    n = max(1, len(words))
    counts = Counter(words)
    own = {w: m for w in counts if (m := marks[w]) is not UNMARKED}
    found = {w: m[0] for w, m in own.items() if m[0]}
    near_you = near_each = 0
    if found:
        hits = np.array([i for i, w in enumerate(words) if w in found])
        near_each = int((np.diff(hits) <= 3 * NEAR).sum())
        second = {w for w, m in own.items() if m[2]}
        if second:
            you = np.array([i for i, w in enumerate(words) if w in second])
            after = np.searchsorted(you, hits)
            gap = np.minimum(np.abs(you[np.maximum(after - 1, 0)] - hits), np.abs(you[np.minimum(after, len(you) - 1)] - hits))
            near_you = int((gap <= NEAR).sum())
    weights = {m[0]: m[1] for m in own.values() if m[0]}
    total = lambda k: sum(counts[w] for w, m in own.items() if m[k])
    n_hits, n_hard = sum(counts[w] for w in found), sum(counts[w] for w in found if own[w][1] >= strong)
    spaced = SPACED.findall(text) if SPACED_HINT.search(text) else []
    hidden = total(5) + sum(weigh(unmasked(m), marks.lexicon) > 0 for m in spaced)
    chars = max(1, len(text))
    return [
        n_hits / n, n_hard / n, float(n_hits), float(n_hard), float(len(weights)),
        sum(weights.values()), near_you / n, near_each / n, total(2) / n,
        sum(c for w, c in counts.items() if w.isupper()) / n, text.count("!") / chars, sum(map(text.count, "?*#$%&@")) / chars,
        total(3) / n, total(4) / n, len(spaced) / n, float(hidden), math.log1p(n),
    ]


def with_features(docs: DataFrame, lexicon: dict[str, float], text_col: str = "text") -> DataFrame:
    """The other columns of docs, and ``x``, the features."""
    others = [c for c in docs.columns if c != text_col]
    order = sorted(lexicon.values(), reverse=True)
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, order[len(order) // 4] if order else math.inf))

    def run(batches):
        lexicon, strong = shared.value
        marks = WordMarks(lexicon)
        for batch in slices(batches):
            rows = [features(t.as_py() or "", marks, strong) for t in batch.column(text_col)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(rows, pa.list_(pa.float64()))], names=[*others, "x"])

    return text_batches(docs).mapInArrow(run, f"{ddl(docs, text_col)}, x array<double>")


def score(
    docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
    sample: int = SAMPLE, threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted. Labels of ids whose bucket of 5 is 0 are not used."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(id_bucket(id_col, 5) == 0, F.lit(False)).alias("held_out"))
    known = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = bounded_sample(known.filter(id_bucket("doc_id", 5) != 0), "doc_id", sample)
    ids = {r[0]: r[1] for r in chosen.collect() if r[0] is not None}
    share = sum(ids.values()) / len(ids) if ids else 0.0
    if not 0 < share < 1:
        return rows.select("doc_id", "held_out", F.lit(share).alias("score"), F.lit(int(share >= threshold)).alias("predicted"))
    small = spark.createDataFrame(list(ids.items()), f"doc_id {dict(docs.dtypes)[id_col]}, label int")
    labelled, seen = counted(rows.filter(~F.col("held_out")).join(F.broadcast(small), "doc_id").select("doc_id", "text", "label"), "toxic-labelled", n=F.count(F.lit(1)), toxic=F.sum("label"))
    share = (seen["toxic"] or 0) / seen["n"] if seen["n"] else share
    if not 0 < (seen["toxic"] or 0) < seen["n"]:  # labels of other documents, or of one class, teach nothing
        return rows.select("doc_id", "held_out", F.lit(share).alias("score"), F.lit(int(share >= threshold)).alias("predicted"))
    taught = bounded_sample(labelled, "doc_id", sample, seen["n"])
    place = Window.orderBy(F.xxhash64("doc_id", F.lit("order")), F.xxhash64("text"))
    sized = taught.select("doc_id", "text", "label", F.sum(F.coalesce(F.char_length("text"), F.lit(0))).over(place).alias("chars"))
    taught = stored(sized.filter(F.col("chars") <= SAMPLE_CHARS).drop("chars").repartition(8), "toxic-sample")
    lexicon = learn_lexicon(taught)
    vector = lambda df: df.withColumn("features", array_to_vector("x"))
    data = vector(with_features(taught, lexicon)).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(5)))
    data = stored(data.select("features", "label", "part").coalesce(4), "toxic-train")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, maxBins=64, seed=7, featuresCol="features", labelCol="label", checkpointInterval=-1)
    model = trees.fit(data.filter("part > 0"))
    margin = VectorAssembler(inputCols=["margin"], outputCol="at")
    raw = lambda df: margin.transform(model.transform(df).withColumn("margin", vector_to_array("rawPrediction")[1]))
    held = raw(data.filter("part = 0"))
    if held.isEmpty():
        held = raw(data)
    # Half a row of each class at either end keeps scores of a sample without errors off 0 and 1.
    ends = spark.createDataFrame([(-9.0, 1.0, 0.5), (-9.0, 0.0, 1.0), (9.0, 0.0, 0.5), (9.0, 1.0, 1.0)], "margin double, label double, weight double")
    points = held.select("margin", F.col("label").cast("double").alias("label"), F.lit(1.0).alias("weight")).unionByName(ends)
    iso = IsotonicRegression(featuresCol="at", labelCol="label", weightCol="weight", predictionCol="score").fit(margin.transform(points))
    scored = iso.transform(raw(vector(with_features(rows, lexicon))).drop("prediction", "probability"))
    # The margin, squeezed, orders what the steps of the isotonic map leave equal.
    fine = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") * 0.999 + 0.001 / (1 + F.exp(-F.col("margin")))))
    return scored.select("doc_id", "held_out", fine.alias("score"), (fine >= threshold).cast("int").alias("predicted"))
