"""Ranked lexical search of test items over all documents, by sort-based accumulation.

Documents are read once: of each the number of its terms and the items' terms it holds, with how often, go to a table, along with the
corpus counts. Then tasks score the documents they have, range by range: the (item, document, impact) arrays of the matched terms are
concatenated, their packed keys radix-sorted and equal ones summed, and a heap for each item keeps the best. What the heaps of all tasks hold
is ranked at the end, in parts first.

Items are dealt into blocks so that a block's pairs of item and term (``BLOCK_PAIRS`` words of items at most, but for an item that has
more by itself) can go to all workers; each block reads the documents again. Nothing else is sent about, and no pair of item and document
leaves a task but those on its heaps.

Cases: null texts have no terms, and documents without terms are no documents of the statistics; rows of one item id are one item with the
terms of its different texts (a null id is an id); items without known terms have no rows; repeated documents are ranked each, null ids behind all
others of the same score; long texts are read as a whole in memory proportional to their length; an empty table on either side gives an
empty result; other columns are ignored. The documents' id must be a whole number.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from traceloom.llm.common import slices, stored, text_batches
from traceloom.llm.decontamination import words_of

K, BLOCK_PAIRS = 10, 2_000_000
#: Keys that are sorted at a time.
KEYS_AT_ONCE = 1 << 21
PARTS = 64
MATCHED = "doc_id long, n long, terms array<int>, times array<int>"


class Postings:
    """For each term of some items the items that hold it and how often, end to end."""

    def __init__(self, rows: Iterable[tuple]):
        items: dict = {}
        for item, text in rows:
            items.setdefault(item, Counter()).update(words_of(text))
        self.names = list(items)
        self.vocabulary: dict[bytes, int] = {}
        of, item, times = [], [], []
        for i, terms in enumerate(items.values()):
            for t, n in terms.items():
                of.append(self.vocabulary.setdefault(t, len(self.vocabulary)))
                item.append(i)
                times.append(n)
        order = np.argsort(np.array(of, np.int64), kind="stable")
        self.item, self.times = np.array(item, np.int64)[order], np.array(times, np.int64)[order]
        self.cuts = np.searchsorted(np.array(of, np.int64)[order], np.arange(len(self.vocabulary) + 1))


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of unsigned keys, by stable sorts of 16 bits (which are radix sorts) from the lowest to the highest that are set."""
    order, most = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable"), int(keys.max())
    shift = 16
    while most >> shift:
        order = order[np.argsort(((keys[order] >> shift) & 0xFFFF).astype(np.uint16), kind="stable")]
        shift += 16
    return order


def accumulate(postings: Postings, weight: np.ndarray, doc: np.ndarray, term: np.ndarray, times: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of impacts by (item, document) of the matches: a match is a document's place, a term and how often it is there."""
    impact = weight[term] * ((1_000_000_000 * times) // (1000 * times + 8 * m[doc]))
    n = postings.cuts[term + 1] - postings.cuts[term]
    ends = np.cumsum(n)
    at = np.repeat(postings.cuts[term] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
    keys = postings.item[at] * len(m) + np.repeat(doc, n)
    if not len(keys):
        none = np.zeros(0, np.int64)
        return none, none, none
    values = np.repeat(impact, n) * postings.times[at]
    order = radix_order(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first] // len(m), keys[first] % len(m), np.add.reduceat(values[order], first)


class Best:
    """The best k documents of each item so far."""

    def __init__(self, n_items: int, k: int):
        self.k, self.heaps, self.least = k, [[] for _ in range(n_items)], np.ones(n_items, np.int64)

    def add(self, item: np.ndarray, at: np.ndarray, score: np.ndarray, ids: list) -> None:
        """Scores of items (in rising order) with documents, as places in ids. What can't be among an item's best is left out at once."""
        keep = np.flatnonzero(score >= self.least[item])
        known = np.array([i is not None for i in ids])
        number = np.array([i or 0 for i in ids], np.int64)
        keep = keep[np.lexsort((number[at[keep]], ~known[at[keep]], -score[keep], item[keep]))]
        own = item[keep]
        place = np.arange(len(keep)) - np.searchsorted(own, own, side="left")
        for j in keep[place < self.k].tolist():
            heap, d = self.heaps[item[j]], ids[at[j]]
            entry = (int(score[j]), d is not None, -(d or 0))
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
        for i in np.unique(own).tolist():
            if len(self.heaps[i]) == self.k:
                self.least[i] = self.heaps[i][0][0]


def match(docs: DataFrame, postings) -> DataFrame:
    """doc_id, n, terms and times of each document; postings is a broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = postings.value.vocabulary.get
        for batch in (part for b in batches for part in slices([b])):
            n, cuts, terms, times = [], [0], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                held = Counter([t for w in words if (t := get(w)) is not None])
                n.append(len(words))
                terms.extend(held)
                times.extend(held.values())
                cuts.append(len(terms))
            offsets = pa.array(cuts, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (terms, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "times"])

    return text_batches(docs).mapInArrow(run, MATCHED)


def heads(matched: DataFrame, postings, weights, k: int, kind: str) -> DataFrame:
    """The best of each task: item_id, doc_id, score. matched has doc_id, m, terms, times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weight = postings.value, weights.value
        best = Best(len(own.names), k)
        width = np.diff(own.cuts)
        for batch in (part for b in batches for part in slices([b])):
            ids, m = batch.column("doc_id").to_pylist(), batch.column("m").to_numpy(zero_copy_only=False)
            lists = batch.column("terms")
            term, times = lists.flatten().to_numpy(zero_copy_only=False), batch.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy(zero_copy_only=False))
            # Ranges of documents whose keys are sorted together.
            cost = np.bincount(doc, weights=width[term], minlength=len(ids)).cumsum()
            turn = (cost // KEYS_AT_ONCE).astype(np.int64)
            for t in np.unique(turn).tolist():
                a, b = np.searchsorted(turn, (t, t + 1))
                lo, hi = np.searchsorted(doc, (a, b))
                item, at, score = accumulate(own, weight, doc[lo:hi] - a, term[lo:hi], times[lo:hi], m[a:b])
                best.add(item, at, score, ids[a:b])
        rows = [(own.names[i], -d if known else None, s) for i, heap in enumerate(best.heaps) for s, known, d in heap]
        out = pa.RecordBatch.from_pylist([dict(zip(("item_id", "doc_id", "score"), r, strict=True)) for r in rows], schema=pa.schema([("item_id", item_type), ("doc_id", pa.int64()), ("score", pa.int64())]))
        yield from slices([out])

    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(matched.sparkSession.createDataFrame([], f"item_id {kind}").schema["item_id"].dataType)
    return matched.select("doc_id", "m", "terms", "times").mapInArrow(run, f"item_id {kind}, doc_id long, score long")


def block_best(docs: DataFrame, rows: Iterable[tuple], k: int, kind: str) -> DataFrame:
    context = docs.sparkSession.sparkContext
    own = Postings(rows)
    postings = context.broadcast(own)
    seen = Observation()
    measured = match(docs, postings).observe(seen, F.count_if(F.col("n") > 0).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l"))
    matched = stored(measured.filter(F.size("terms") > 0), "search-matched")
    n, total = seen.get["n"], seen.get["l"]
    weight = np.zeros(len(own.vocabulary), np.int64)
    known = matched.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    known = known.select("term", F.floor(1000 * F.log((2 * F.lit(n) + 2) / (2 * F.col("df") + 1))).alias("w"))
    for r in known.toLocalIterator():  # at most the block's terms
        weight[r.term] = r.w
    m = F.expr(f"25 + (cast(75 * n as decimal(20,0)) * cast({n} as decimal(18,0))) div {max(1, total)}").cast("long")
    return heads(matched.withColumn("m", m), postings, context.broadcast(weight), k, kind)


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of each item."""
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull()).distinct()
    kind = asked.schema["item_id"].dataType.simpleString()
    n_words = asked.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))), F.lit(0))).first()[0]
    blocks = max(1, -(-n_words // block_pairs))
    best = None
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toLocalIterator()
        found = block_best(read, rows, k, kind)
        best = found if best is None else best.unionByName(found)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    within = F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))
    few = best.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).withColumn("rank", within).filter(F.col("rank") <= k).drop("part", "rank")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    return few.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
