"""Quality by regularised quadratic discriminant analysis of document statistics.

Each text gives a vector of transformed statistics (logs and roots of lengths, shares of kinds of characters, repetition,
compressibility). Per class, count, sum and sum of outer products are added up over all labelled rows that may be learned from. A
class covariance is shrunk towards the pooled one and towards its diagonal; its Cholesky factor is computed once and kept, and a
text's score is the difference of the classes' Mahalanobis log densities, mapped to a probability by a logistic fit on the same rows.

Cases: null and empty texts have the statistics of an empty text and get a score like any other; null ids are never learned from;
repeated rows score alike; labels that are null are left out, and an id with both labels counts as 1; a very long text is measured as
a whole, in memory proportional to its length; with fewer than two classes to learn from, every score is the share of label 1 (0.5
without labels); extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import ddl, id_bucket, slices, stored, text_batches

THRESHOLD = 0.3
POOL, DIAGONAL, RIDGE = 0.1, 0.05, 1e-3
KINDS = np.zeros((256, 9), np.float32)
for _k, _set in enumerate((range(65, 91), range(97, 123), range(48, 58), (33, 63), (46, 44, 59, 58), (10,), (32, 9, 13), range(128, 256))):
    KINDS[list(_set), _k] = 1
KINDS[:, 8] = 1 - KINDS[:, :8].sum(1)
NAMES = ["upper", "lower", "digit", "shout", "stop", "line", "blank", "wide", "symbol"]
FEATURES = [*NAMES, "length", "words", "word_mean", "word_spread", "distinct", "top_word", "line_repeats", "line_mean", "entropy", "squeeze", "capital_words"]


def statistics(text: str) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256)
    n = max(1, len(raw))
    shares = np.sqrt(counts.astype(np.float32) @ KINDS / n)
    p = counts[counts > 0] / n
    words = text.split()
    k = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        *shares.tolist(),
        np.log1p(len(raw)),
        np.log1p(len(words)),
        np.log1p(lengths.mean()),
        np.log1p(lengths.std()),
        len(seen) / k,
        np.sqrt(max(seen.values(), default=0) / k),
        np.sqrt(1 - len(set(lines)) / len(lines)) if lines else 0.0,
        np.log1p(len(raw) / max(1, len(lines))),
        float(-(p * np.log2(p)).sum()),
        np.log1p(len(zlib.compress(raw, 1)) / n),
        np.sqrt(sum(map(str.isupper, words)) / k),
    ]


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The other columns of docs, and ``stats``."""
    others = [c for c in docs.columns if c != text_col]

    def run(batches):
        for batch in slices(batches):
            rows = [statistics(t.as_py() or "") for t in batch.column(text_col)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(rows, pa.list_(pa.float64()))], names=[*others, "stats"])

    return text_batches(docs).mapInArrow(run, f"{ddl(docs, text_col)}, stats array<double>")


@dataclass
class Moments:
    n: float
    total: np.ndarray
    outer: np.ndarray


def moments(rows: DataFrame, label_col: str) -> dict[int, Moments]:
    """Count, sum and outer products of ``stats`` for each label; one row per task and label goes to the driver."""
    d = len(FEATURES)

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x = np.array(batch.column(1).to_pylist()).reshape(-1, d)
            y = np.array(batch.column(0).to_pylist())
            for label in np.unique(y):
                own = np.hstack([np.ones((int((y == label).sum()), 1)), x[y == label]])
                sums[int(label)] = sums.get(int(label), 0) + own.T @ own
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.ravel().tolist() for s in sums.values()], pa.list_(pa.float64()))], names=["label", "sums"])

    parts = rows.select(F.col(label_col).cast("int"), "stats").mapInArrow(run, "label int, sums array<double>")
    added = parts.select("label", F.posexplode("sums").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x")).collect()
    out: dict[int, np.ndarray] = {}
    for label, i, x in added:
        out.setdefault(label, np.zeros((d + 1) ** 2))[i] = x
    grids = {k: v.reshape(d + 1, d + 1) for k, v in out.items()}
    return {k: Moments(g[0, 0], g[0, 1:], g[1:, 1:]) for k, g in grids.items()}


@dataclass
class Discriminant:
    """Means, inverted Cholesky factors and log determinants of the classes 0 and 1, and the logistic map of their difference."""

    shift: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    log_dets: list[float]
    slope: float = 1.0
    offset: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.shift) / self.scale
        density = [-0.5 * (((z - m) @ f.T) ** 2).sum(1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.log_dets, strict=True)]
        return np.clip((density[1] - density[0]) / np.sqrt(z.shape[1]), -30, 30)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.difference(x) + self.offset)))


def discriminant(by: dict[int, Moments]) -> Discriminant:
    n = sum(m.n for m in by.values())
    shift = sum(m.total for m in by.values()) / n
    scale = np.sqrt(np.maximum(sum(np.diag(m.outer) for m in by.values()) / n - shift**2, 1e-8))
    means, own = [], []
    for k in (0, 1):
        m = by[k]
        mean = m.total / m.n
        means.append((mean - shift) / scale)
        own.append((m.outer / m.n - np.outer(mean, mean)) / np.outer(scale, scale))
    pooled = (by[0].n * own[0] + by[1].n * own[1]) / n
    factors, dets = [], []
    for k in (0, 1):
        pull = POOL + (1 - POOL) * len(shift) / (len(shift) + by[k].n)  # small classes lean on the pooled covariance
        c = (1 - pull) * own[k] + pull * pooled
        c = (1 - DIAGONAL) * c + DIAGONAL * np.diag(np.diag(c)) + RIDGE * np.eye(len(c))
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low))
        dets.append(2 * float(np.log(np.diag(low)).sum()))
    return Discriminant(shift, scale, means, factors, dets)


def logistic_fit(x: np.ndarray, weight: np.ndarray, ones: np.ndarray) -> tuple[float, float]:
    """Slope and offset for counts at places x: weight rows, of them ones with label 1. The slope is kept above 0."""
    a = np.stack([x, np.ones_like(x)], 1)
    w = np.array([0.5, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        grad = a.T @ (weight * p - ones) + 1e-3 * w
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 1e-3), float(w[1])


def train(rows: DataFrame, label_col: str) -> Discriminant | float:
    """From rows with ``stats`` and labels 0 or 1; a share where one class is missing."""
    rows = rows.filter(F.col(label_col).isin(0, 1))
    by = moments(rows, label_col)
    if len(by) < 2:
        return 1.0 * (1 in by) if by else 0.5
    model = discriminant(by)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            x = shared.value.difference(np.array(batch.column(1).to_pylist()).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(x * 20).astype(np.int32))], names=["label", "step"])

    steps = rows.select(F.col(label_col).cast("int"), "stats").mapInArrow(run, "label int, step int")
    at = np.array([tuple(r) for r in steps.groupBy("step").agg(F.count("*"), F.sum("label")).collect()], float)  # 1,201 steps at most
    model.slope, model.offset = logistic_fit(at[:, 0] / 20, at[:, 1], at[:, 2])
    return model


def score(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted. Labels of ids whose bucket of 5 is 0 are not used."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(id_bucket(id_col, 5) == 0, F.lit(False)).alias("held_out"))
    stats = stored(with_statistics(named), "quality-stats")
    known = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).alias("label"))
    model = train(stats.filter(~F.col("held_out")).join(known, "doc_id"), "label")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            m = shared.value
            s = np.full(batch.num_rows, m) if isinstance(m, float) else m.score(np.array(batch.column(2).to_pylist()).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64())], names=["doc_id", "held_out", "score"])

    scored = stats.select("doc_id", "held_out", "stats").mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
