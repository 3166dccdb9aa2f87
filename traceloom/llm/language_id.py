"""Language identification: sparse multinomial logistic regression on TF-IDF of hashed character n-grams.

A text's 1-, 2- and 3-grams of characters (lower-cased, with blanks around the text) are hashed to 2^15 features; a feature's value is
its share of the text's n-grams times its inverse document frequency. Document frequencies are counted over all rows that may be
learned from. The weights are fitted by follow-the-regularised-leader with L1 and L2 penalties on a bounded sample of those rows:
the ``sample`` distinct rows with the smallest hashes, and of these, in that order, as many as have ``MOST_FEATURES`` features in all.
They reach the driver as sparse vectors, never as texts. A fifth of them only sets the temperature of the softmax. The model has
2^15 weights for each language.

Cases: a text that is null or has no letters (Unicode's categories L) gets ``und`` and score 0; nulls in id, lang or other columns are
fine (rows without lang are not learned from); repeated rows are judged alike and count once in the sample; of equally likely languages
the first by name is taken; very long texts count as a whole, in pieces of ``PIECE`` characters, so memory does not grow with them; an
empty table, or one with no labelled rows, gives ``und`` throughout; extra columns are ignored (``identify``) or kept
(``keep_identified``), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.llm.common import bounded_sample, id_bucket, slices, stored, text_batches

BITS, ORDERS, SAMPLE, MOST_FEATURES = 15, (1, 2, 3), 4000, 8_000_000
PIECE = 1 << 17
MULTIPLY = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def letters(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def pieces(texts: list[str]) -> Iterator[tuple[int, str]]:
    """The texts, lower-cased and with blanks around, cut into (number, piece); each n-gram begins in one piece, but for its last two places.

    The blanks keep n-grams that begin in a text from reaching characters of the next.
    """
    for k, t in enumerate(texts):
        low = "  " + t.lower() + "    "
        for at in range(0, len(low) - 2, PIECE):
            yield k, low[at : at + PIECE + 2]


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
    """Pieces of about PIECE characters at a time, end to end: the number of each one's text, for each order the features at every
    place, and where pieces begin and end, in turn."""
    batch: list[tuple[int, str]] = []
    size = 0

    def featured():
        chars = np.frombuffer("".join(p for _, p in batch).encode("utf-32-le", "surrogatepass"), np.uint32)
        n, out, h = len(chars) - 2, [], np.uint32(0)
        for k in range(max(ORDERS)):
            h = (h ^ chars[k : k + n]) * MULTIPLY[k]
            if k + 1 in ORDERS:
                out.append(((h ^ (h >> np.uint32(15))) * MULTIPLY[0] >> np.uint32(32 - BITS)).astype(np.int32))
        ends = np.cumsum([len(p) for _, p in batch])
        begins = np.concatenate(([0], ends[:-1]))
        return np.array([k for k, _ in batch]), out, np.stack([begins, ends - 2], 1).astype(np.int64)

    for k, p in pieces(texts):
        batch.append((k, p))
        size += len(p)
        if size >= PIECE:
            yield featured()
            batch, size = [], 0
    if batch:
        yield featured()


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # features x languages; inverse document frequencies are multiplied in
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, texts: list[str]) -> np.ndarray:
        total, n, columns = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts)), self.columns
        for of, features, bounds in grams(texts):
            at = bounds.ravel()[:-1]  # what lies between two pieces is summed too, and dropped
            part = sum(np.stack([np.add.reduceat(w[f], at)[::2] for w in columns], 1) for f in features)
            np.add.at(total, of, part)
            np.add.at(n, of, bounds[:, 1] - bounds[:, 0])
        return total / (len(ORDERS) * np.maximum(n, 1))[:, None] + self.bias

    @property
    def columns(self) -> list[np.ndarray]:
        return [np.ascontiguousarray(c) for c in self.weights.T]

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return softmax(self.logits(texts) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def document_frequencies(rows: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """Of each feature, over all rows; a task sends its sums, and Spark adds them up."""

    def run(batches):
        df, n, seen = np.zeros(1 << BITS, np.int64), 0, np.zeros(1 << BITS, bool)
        for batch in slices(batches):
            last = -1
            for of, features, bounds in grams([t for t in batch.column(0).to_pylist() if t]):
                for k, (i, j) in zip(of.tolist(), bounds.tolist(), strict=True):
                    if k != last:
                        if last >= 0:
                            df += seen
                        seen[:] = False
                        n, last = n + 1, k
                    for f in features:
                        seen[f[i:j]] = True
            if last >= 0:
                df += seen
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1), pa.int32()), pa.array(np.append(df[found], n), pa.int64())], names=["feature", "n"])

    counts = rows.select(text_col).mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(1 << BITS), 0
    for feature, count in counts:  # one row per feature at most
        if feature < 0:
            n = count
        else:
            df[feature] = count
    return df, n


def sparse(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The text's features and their shares."""
    count = np.zeros(1 << BITS, np.int64)
    for _, features, bounds in grams([text]):
        for i, j in bounds.tolist():
            for f in features:
                count += np.bincount(f[i:j], minlength=1 << BITS)
    index = np.flatnonzero(count)
    return index, count[index] / count.sum()


def vectors(sample: DataFrame, most_features: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(language, features, shares) of the rows (lang, text, sample_hash), in the order of their hashes, up to most_features features."""

    def run(batches):
        for batch in slices(batches):
            found = [sparse(t) for t in batch.column("text").to_pylist()]
            own = [pa.array([i.astype(np.uint16).tobytes() for i, _ in found], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("place"), *own], names=["lang", "place", "index", "share"])

    rows = stored(sample.mapInArrow(run, "lang string, place long, index binary, share binary"), "language-vectors")
    size = F.sum(F.octet_length("index") / 2).over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    some = rows.withColumn("total", size).filter(F.col("total") <= most_features).orderBy("place")
    return [(r[0], np.frombuffer(r[1], np.uint16), np.frombuffer(r[2], np.float32)) for r in some.select("lang", "index", "share").toLocalIterator()]


def follow_the_leader(data, labels, n_labels: int, idf, epochs=3, alpha=0.5, beta=1.0, l1=2e-4, l2=1e-4) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with per-coordinate rates; weights (by feature and label) that the L1 penalty holds at 0 stay exactly 0."""
    z, n = np.zeros((len(idf), n_labels)), np.zeros((len(idf), n_labels))
    zb, nb = np.zeros(n_labels), np.zeros(n_labels)

    def weight(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    scale = 100.0  # shares of n-grams are small; brings values to about 1
    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(data)):
            index, value = data[k]
            x = (value * scale)[:, None]
            w, b = weight(z[index], n[index], l1), weight(zb, nb, 0)
            error = softmax((x * w).sum(0) + b)
            error[labels[k]] -= 1
            for own, square, g, part in ((z, n, x * error, w), (zb, nb, error, b)):
                at = index if own is z else slice(None)
                step = (np.sqrt(square[at] + g * g) - np.sqrt(square[at])) / alpha
                own[at] += g - step * part
                square[at] += g * g
    return weight(z, n, l1) * scale, weight(zb, nb, 0)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    if not len(labels):
        return 1.0

    slack = 1 / (len(labels) + 2)  # a sample without an error doesn't show that there are none

    def loss(t):
        p = softmax(logits / t) + 1e-12
        own = np.log(p[np.arange(len(labels)), labels])
        return -((1 - slack) * own + slack * np.log(p).mean(1)).mean()

    grid = np.geomspace(0.05, 20, 200)
    return float(min(grid, key=loss))


def train(rows: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE, most_features: int = MOST_FEATURES) -> Model:
    """Learn from rows with a language."""
    rows = rows.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null").filter(letters("text"))
    languages = sorted(r[0] for r in rows.select("lang").distinct().collect())
    if not languages:
        return Model(["und"], np.zeros((1 << BITS, 1)), np.zeros(1))
    df, n = document_frequencies(rows, "text")
    idf = np.log((1 + n) / (1 + df)) + 1
    taken = vectors(bounded_sample(rows, "id", sample, n).withColumn("place", F.xxhash64("id", "text", "lang")), most_features)
    labels = np.array([languages.index(r[0]) for r in taken])
    held = np.arange(len(taken)) % 5 == 4
    data = [(i, v * idf[i]) for (_, i, v), h in zip(taken, held, strict=True) if not h]
    weights, bias = follow_the_leader(data, labels[~held], len(languages), idf)
    model = Model(languages, (weights * idf[:, None]).astype(np.float32), bias)
    logits = [(v * idf[i]) @ weights[i] + bias for (_, i, v), h in zip(taken, held, strict=True) if h]
    model.temperature = fit_temperature(np.array(logits), labels[held])
    return model


def judged(model: Model, texts: list[str | None], known: list[bool]) -> tuple[list[str], list[float]]:
    p = model.probabilities([t or "" for t in texts])
    best = p.argmax(1) if len(p) else []
    found = [model.languages[b] if k else "und" for b, k in zip(best, known, strict=True)]
    return found, [float(x[b]) if name != "und" else 0.0 for x, b, name in zip(p, best, found, strict=True)]


def train_held_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    return train(text_batches(docs).filter(id_bucket(id_col, 4) != 2), id_col, text_col, lang_col)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score; learned from the rows that are not held out."""
    shared = docs.sparkSession.sparkContext.broadcast(train_held_out(docs, id_col, text_col, lang_col))

    def run(batches):
        for batch in slices(batches):
            name, score = judged(shared.value, batch.column("text").to_pylist(), batch.column("known").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(name, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(id_bucket(id_col, 4) == 2, F.lit(False)).alias("held_out")
    rows = docs.select(F.col(id_col).alias("doc_id"), held, letters(text_col).alias("known"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs whose language is recognised with a calibrated probability of at least ``least``; same columns."""
    shared = docs.sparkSession.sparkContext.broadcast(train_held_out(docs, id_col, text_col, lang_col))

    @F.arrow_udf("boolean")
    def recognised(texts: pa.Array) -> pa.Array:
        keep = []
        for at in range(0, len(texts), 1000):
            name, score = judged(shared.value, own := texts.slice(at, 1000).to_pylist(), [True] * len(own))
            keep += [n != "und" and s >= least for n, s in zip(name, score, strict=True)]
        return pa.array(keep, pa.bool_())

    return docs.filter(letters(text_col)).filter(recognised(F.col(text_col)))
