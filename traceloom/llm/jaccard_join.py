"""Similarity join on word 5-gram Jaccard, with Bayesian pruning of candidates.

Texts with equal shingle sets are one class from the start. MinHash bands give buckets of classes, which are dealt to tasks (large
ones in pairs of blocks). There the classes' MinHash values, a byte of each, are compared a few at a time, and a pair is dropped once
the posterior probability (uniform prior) that its similarity reaches the threshold is below ``TOLERANCE``; a task keeps of what is
left a spanning forest, never pairs. The connected components of all forests hold every link: classes that only share a bucket
by chance are in different ones. Components, again in blocks where they are large, are verified: pairs that share a bucket are pruned
on full MinHash values, and the similarity of the rest is computed from the shingles. A task returns sums of links and a forest.

With 36 bands of 5 a pair of similarity 0.8 is missed with probability 6e-7, and pruning loses 1e-7 at each of its two places. A shingle
is the 64-bit hash of its words, and sets are compared by these; two different shingles of two texts of n words are taken for one with
probability n^2 / 2^64. Words are runs of digits, letters (A-Z lower-cased) and non-ASCII characters; a text of 1 to 4 words has one
shingle, all of them.

Cases: null texts and texts without words have no shingles, are linked to nothing and are groups of their own; repeated rows and
equal texts are links of each other; a null id is no class id unless the whole class has null ids; of equal ids the row that comes first
in the files stays; very long texts count as a whole (a task needs about 100 bytes a word of its longest text); an empty table gives
an empty result; extra columns are ignored (kept by ``keep_one``), whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import FILE, LOCATOR, ROW, Bits, counted, ddl, fetch, located, slices, spread_join, stored, text_batches, without
from traceloom.llm.components import components
from traceloom.llm.decontamination import words_of

WORDS, THRESHOLD = 5, (4, 5)
BANDS, ROWS, STEP, TOLERANCE = 36, 5, 20, 1e-7
#: Classes in a block of a component and rows in a cell of components; the same of buckets.
BLOCK, CELL, WIDE, WIDE_CELL = 512, 400, 2048, 4000
SMALL = 64
CACHE_WORDS = 100_000
_rng = np.random.default_rng(20240501)
WEIGHTS = _rng.integers(1, 2**63, WORDS).astype(np.uint64) | np.uint64(1)
FACTOR = _rng.integers(1, 2**32, (1, BANDS * ROWS), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
FLIP = _rng.integers(0, 2**32, (1, BANDS * ROWS), dtype=np.uint64).astype(np.uint32)
BAND_WEIGHTS = _rng.integers(1, 2**63, (1, ROWS)).astype(np.uint64) | np.uint64(1)


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h
        return h


_hashes = Hashes()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word 5-grams."""
    words = words_of(text)
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
    if n < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    h = ids[: n - WORDS + 1] * WEIGHTS[0]
    for k in range(1, WORDS):
        h = h + ids[k : n - WORDS + 1 + k] * WEIGHTS[k]
    return np.unique(mixed(h))


def signature(s: np.ndarray) -> np.ndarray:
    low = (s >> np.uint64(32)).astype(np.uint32)[:, None]
    parts = [((low[i : i + 4096] ^ FLIP) * FACTOR).min(0) for i in range(0, len(low), 4096)]
    return parts[0] if len(parts) == 1 else np.min(parts, 0)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """n x BANDS keys of n x (BANDS * ROWS) MinHash values."""
    rows = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    return mixed((rows * BAND_WEIGHTS).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def least_matches(threshold: float = THRESHOLD[0] / THRESHOLD[1], tolerance: float = TOLERANCE) -> dict[int, int]:
    """After n compared values, the fewest matches that leave the pair a chance: P(J >= t | m of n) = P(Binomial(n + 1, t) <= m)."""
    out = {}
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        tail = 0.0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
        out[n] = m
    return out


def prune(signatures: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    matches, at = np.zeros(len(pairs), np.int32), 0
    for n, least in least_matches().items():
        a, b = signatures[pairs[:, 0], at:n], signatures[pairs[:, 1], at:n]
        matches += (a == b).sum(1)
        keep = matches >= least
        pairs, matches, at = pairs[keep], matches[keep], n
    return pairs


def common_counts(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs: by merging where they are few, else by counting blocks of shingles for all sets at once."""
    if len(pairs) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in pairs], np.int64)
    used = np.unique(pairs)
    _, column = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)
    row = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    total = np.zeros((len(used), len(used)), np.float32)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    for lo in range(0, int(column[-1]) + 1, 4096):
        i, j = np.searchsorted(column, [lo, lo + 4096])
        part = np.zeros((len(used), 4096), np.float32)
        part[row[i:j], column[i:j] - lo] = 1
        total += part @ part.T
    place = np.searchsorted(used, pairs)
    return total[place[:, 0], place[:, 1]].astype(np.int64)


def linked_pairs(sets: list[np.ndarray], side: np.ndarray) -> np.ndarray:
    """Pairs (i < j) that share a bucket and reach the threshold; with two sides only those across."""
    n = len(sets)
    signatures = np.stack([signature(s) for s in sets])
    keys = band_keys(signatures)
    shared = np.zeros((n, n), bool)
    for t in range(BANDS):
        order = np.argsort(keys[:, t], kind="stable")
        k = keys[order, t]
        cuts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1], [True])))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                shared[np.ix_(order[a:b], order[a:b])] = True
    if side.any() and not side.all():
        shared &= side[:, None] != side[None, :]
    pairs = prune(signatures, np.argwhere(np.triu(shared, 1)))
    if not len(pairs):
        return pairs
    sizes = np.array([len(s) for s in sets])
    common = common_counts(sets, pairs)
    union = sizes[pairs[:, 0]] + sizes[pairs[:, 1]] - common
    return pairs[common * THRESHOLD[1] >= union * THRESHOLD[0]]


class Forest:
    """Union by least element."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(self, pairs: np.ndarray) -> None:
        for a, b in pairs.tolist():
            a, b = self.find(a), self.find(b)
            if a != b:
                self.root[max(a, b)] = min(a, b)


def wide_links(sig: np.ndarray, side: np.ndarray) -> np.ndarray:
    """A spanning forest of the pairs of a large bucket that survive pruning: pairs already in one tree aren't looked at."""
    tree, out, two = np.arange(len(sig)), [], side.any() and not side.all()
    for i in range(len(sig) - 1):
        other = np.flatnonzero(tree[i + 1 :] != tree[i]) + i + 1
        if two:
            other = other[side[other] != side[i]]
        if len(other):
            hits = prune(sig, np.stack([np.full(len(other), i), other], 1))[:, 1]
            _, first = np.unique(tree[hits], return_index=True)
            out += [(i, int(j)) for j in hits[first]]
            tree[np.isin(tree, tree[hits])] = tree[i]
    return np.array(out, np.int64).reshape(-1, 2)


def link_buckets(table: pa.Table) -> pa.Table:
    """One cell of buckets: for each class that has a link the least class (by place in the cell) that its links lead to."""
    keys = table.column("key").to_pylist()
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(keys), BANDS * ROWS)
    side = np.array(table.column("side").to_pylist(), bool)
    of = [np.array(table.column(c).to_pylist(), np.int64) for c in ("bucket", "lo", "hi")]
    order = np.lexsort(of[::-1])
    new = np.concatenate(([True], *[np.any([x[order][1:] != x[order][:-1] for x in of], 0)][: len(keys) > 1]))
    begins = np.flatnonzero(new)
    sizes, large = np.diff(np.append(begins, len(keys))), np.zeros(len(keys), bool)
    place = {}
    forest = Forest(len(keys))
    first = np.array([place.setdefault(k, i) for i, k in enumerate(keys)])  # a class may be in several buckets
    for n in np.unique(sizes):
        own = begins[sizes == n]
        if n <= SMALL:
            pairs = np.stack(np.triu_indices(n, 1), 1)
            for at in range(0, len(own), max(1, 200_000 // max(1, len(pairs)))):
                some = order[(own[at : at + max(1, 200_000 // max(1, len(pairs))), None, None] + pairs[None]).reshape(-1, 2)]
                forest.join(first[prune(sig, some)])
        else:
            for b in own:
                rows = order[b : b + n]
                forest.join(first[rows[wide_links(sig[rows], side[rows])]])
    root = [forest.find(int(i)) for i in first]
    out = [(keys[i], keys[r]) for i, r in enumerate(root) if first[i] == i and r != i]
    return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([x for _, x in out], pa.binary())})


def compare(table: pa.Table) -> pa.Table:
    """One cell: the links of each class (in rows), and for each class the least class its links lead to within the cell."""
    keys, copies = table.column("key").to_pylist(), np.array(table.column("copies").to_pylist(), np.int64)
    sets = [np.frombuffer(b, np.uint64) for b in table.column("set").to_pylist()]
    pairs = linked_pairs(sets, np.array(table.column("side").to_pylist(), bool))
    links = np.zeros(len(keys), np.int64)
    np.add.at(links, pairs[:, 0], copies[pairs[:, 1]])
    np.add.at(links, pairs[:, 1], copies[pairs[:, 0]])
    forest = Forest(len(keys))
    forest.join(pairs)
    out, split = np.flatnonzero(links), table.column("split")[0].as_py()
    least: dict[int, bytes] = {}
    for i in out:
        r = forest.find(int(i))
        least[r] = min(least.get(r, keys[i]), keys[i])
    return pa.table(
        {
            "key": pa.array([keys[i] for i in out], pa.binary()),
            "links": pa.array(links[out]),
            "root": pa.array([least[forest.find(int(i))] for i in out], pa.binary()),
            "split": pa.array([split] * len(out), pa.bool_()),
        }
    )


def describe(docs: DataFrame, text_col: str) -> DataFrame:
    """Key of the shingle set (null if empty), its size, band keys and a byte of each MinHash value, for each located row of docs."""
    others = [c for c in docs.columns if c != text_col]

    def run(batches):
        for batch in slices(batches):
            key, size, found = [], [], []
            for text in batch.column(text_col):
                s = shingles(text.as_py())
                size.append(len(s))
                key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                found.append(signature(s) if len(s) else None)
            full = [f for f in found if f is not None]
            at = iter(band_keys(np.stack(full)).view(np.int64).tolist() if full else [])
            bands = pa.array([None if f is None else next(at) for f in found], pa.list_(pa.int64()))
            sig = pa.array([None if f is None else f.astype(np.uint8).tobytes() for f in found], pa.binary())
            own = [pa.array(key, pa.binary()), pa.array(size, pa.int64()), bands, sig]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *own], names=[*others, "key", "n_shingles", "bands", "sig"])

    return text_batches(docs).mapInArrow(run, f"{ddl(docs, text_col)}, key binary, n_shingles long, bands array<long>, sig binary")


def with_sets(rows: DataFrame) -> DataFrame:
    """rows with ``set``, the shingles, instead of ``text``."""
    others = [c for c in rows.columns if c != "text"]

    def run(batches):
        for batch in slices(batches):
            sets = pa.array([shingles(t.as_py()).tobytes() for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), sets], names=[*others, "set"])

    return rows.mapInArrow(run, f"{ddl(rows, 'text')}, set binary")


def in_blocks(rows: DataFrame, size: Column, width: int) -> DataFrame:
    """rows with lo, hi, side, split: each pair of a group's blocks gets the rows of both; a group of one block is not split."""
    blocks = F.ceil(size / width).cast("int")
    own = F.pmod(F.xxhash64("key"), blocks).cast("int")
    dealt = rows.withColumns({"split": blocks > 1, "own": own}).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    ends = {"lo": F.least("own", "other"), "hi": F.greatest("own", "other"), "side": F.col("own") > F.col("other")}
    return dealt.withColumns(ends).drop("own", "other")


def near_classes(classes: DataFrame) -> DataFrame:
    """(node, label): the components of the pairs of classes that share a bucket and survive pruning."""
    bucket = F.explode("bands").alias("bucket")
    several, seen = counted(classes.select(bucket).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "jaccard-buckets", n=F.count(F.lit(1)))
    n_buckets = seen["n"]
    rows = fetch(classes.select("key", bucket), several, n_buckets, ("bucket",))
    members, seen = counted(rows.select("key", "bucket", "n"), "jaccard-members", n=F.count(F.lit(1)), dealt=F.sum(F.ceil(F.col("n") / WIDE)))
    keys = members.select("key").distinct()
    signed = Bits(keys, seen["n"], ("key",)).test(classes.select("key", "sig"), True)
    dealt = in_blocks(members.join(signed, "key"), F.col("n"), WIDE)
    cells = max(1, (seen["dealt"] or 0) // WIDE_CELL)
    cell = F.pmod(F.xxhash64("bucket", "lo", "hi"), F.lit(cells)).alias("cell")
    links = dealt.select("key", "sig", "bucket", "lo", "hi", "side", cell).groupBy("cell").applyInArrow(link_buckets, "a binary, b binary")
    return components(links)


def joined(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``jaccard_join`` for located docs, with the locator and whether the row is the one of its group that stays."""
    rows = stored(describe(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *LOCATOR), "text"), "jaccard-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *LOCATOR)).alias("first")
    classes = rows.filter("key is not null").groupBy("key").agg(first, F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = stored(classes, "jaccard-classes")
    near, seen = counted(near_classes(classes).withColumnRenamed("node", "key"), "jaccard-near", n=F.count(F.lit(1)))
    n_near = seen["n"]
    sized = spread_join(near, near.groupBy("label").agg(F.count("*").alias("size")), "label", "key")
    at = [F.col(f"first.{c}").alias(c) for c in LOCATOR]
    wanted = stored(fetch(classes.select("key", "copies", *at), sized, n_near, ("key",)), "jaccard-wanted")
    sets = with_sets(fetch(docs.select(*LOCATOR, F.col(text_col).alias("text")), wanted, n_near).drop(*LOCATOR))
    cells = F.lit(max(1, n_near // CELL))
    cell = F.when(F.col("split"), F.xxhash64("label", "lo", "hi")).otherwise(F.pmod(F.xxhash64("label"), cells)).alias("cell")
    dealt = in_blocks(sets, F.col("size"), BLOCK).select("key", "copies", "set", "side", "split", F.hex(F.when(F.col("split"), F.col("label"))).alias("of"), "lo", "hi", cell)
    dealt = dealt.select("key", "copies", "set", "side", "split", "of", F.when(F.col("split"), F.col("lo")).alias("lo"), F.when(F.col("split"), F.col("hi")).alias("hi"), "cell")
    kinds = "key binary, links long, root binary, split boolean"
    found, seen = counted(dealt.groupBy("cell", "of", "lo", "hi").applyInArrow(compare, kinds), "jaccard-links", split=F.count_if("split"))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    groups = found.filter("not split").select("key", F.col("root").alias("label"))
    if seen["split"]:
        groups = groups.unionByName(components(found.filter("split").select(F.col("key").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "key"))
    labelled = classes.select("key", "first", "copies").join(groups, "key", "left").join(links, "key", "left")
    labelled = stored(labelled.withColumn("label", F.coalesce("label", "key")), "jaccard-labels")
    stays = labelled.groupBy("label").agg(F.min("first").alias("stays"))
    full = spread_join(labelled, stays, "label", "key").select("key", "first", "stays", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    own_row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *LOCATOR)
    out = rows.select("doc_id", "key", "n_shingles", *LOCATOR).join(full, "key", "left")
    stay = F.coalesce("stays", own_row)
    return out.select(
        "doc_id",
        stay["doc_id"].alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.col("first.doc_id"), F.col("doc_id")).alias("copy_id"),
        "n_shingles",
        ((stay[FILE] == F.col(FILE)) & (stay[ROW] == F.col(ROW))).alias("stays"),
        *LOCATOR,
    )


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, class_id (least id of its connected component), n_links, copy_id (least id with the same
    shingles), n_shingles."""
    return joined(located(docs), id_col, text_col).drop("stays", *LOCATOR)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near copies; same columns."""
    rows = located(docs)
    dropped, seen = counted(joined(rows, id_col, text_col).filter("not stays").select(*LOCATOR), "jaccard-dropped", n=F.count(F.lit(1)))
    return without(rows, dropped, seen["n"]).drop(*LOCATOR)
