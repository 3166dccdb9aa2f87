"""Removal of passages that repeat, by recompression.

A text is a sequence of words. Level 1 names every run of equal words; each further level splits the names in two halves and names
every pair of a left and a right one that stand together. Names are fingerprints of what they stand for, so all tasks give the same
name to the same content without asking each other, and whether there is a boundary at a place depends on the two names beside it
only: in equal stretches of words all names are equal but for those near the ends. Rounds on Spark then

1. find which names of the last level occur more than once anywhere (``shared``). A window of 35 words that occurs twice has the
   same names in its interior, all of them shared, so windows with a name there that is not are out. The interior is worked out
   from the boundaries of every level, which makes this exact: no repeated window is lost.
2. verify the rest: fingerprints of the 35 words of such windows are counted over all rows. A fingerprint is two numbers of 64 and 32
   bits from independent hashes of the words, so of n different windows about n^2 / 2^97 pairs are taken for equal: for the 1.5e13
   windows of 100 TB of text 0.0014 pairs in all. Names need one hash only, as they never remove a word.
3. remove the words that windows found twice cover.

Both counts work alike: a group of rows sends each value once, to the bucket that the value says, with a mark if the group has it
more often; a bucket answers with the values found in several groups. So a value that a third of all rows have is one entry per group.
There are as many buckets as input splits or shuffle partitions; where they outnumber the values of a group, a value travels alone.

Cases: null and empty texts have no words; texts of fewer than 35 words keep all of them; repeated rows repeat each other's windows;
overlapping repeats within one text count; null and repeated ids are fine, as rows are told apart by file and place; a very long text
is a group of its own, read whole by one task (about 150 bytes a word); an empty table gives an empty result; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import FILE, ROW, located, stored, text_batches

WINDOW, LEVELS, INFORMATIVE = 35, 5, 3
GROUP_WORDS, CACHE_WORDS = 300_000, 100_000
U = np.uint64
A, B, C = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def mixed(h):
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def named(a, b):
    return mixed(a * A + mixed(b * B + C))


class Hashes(dict):
    """Words to places in two arrays of independent hashes, of 64 and of 32 bits."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.first, self.second = array("Q"), array("Q")

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self.first)
        self.first.append(xxhash.xxh3_64_intdigest(word))
        self.second.append(xxhash.xxh32_intdigest(word, 0x5BD1E995))
        return place


_hashes = Hashes()


class Group:
    """Some texts end to end: word hashes, and where each text begins."""

    def __init__(self, texts: list[list[bytes]]):
        self.begins = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        if len(_hashes) >= CACHE_WORDS:
            _hashes.forget()
        self.place = np.fromiter(map(_hashes.__getitem__, itertools.chain.from_iterable(texts)), np.int64, int(self.begins[-1]))
        self.words = np.frombuffer(_hashes.first, U)[self.place] if len(self.place) else np.zeros(0, U)
        self.edge = np.zeros(len(self.words) + 1, bool)  # no name reaches over the edge of a text
        self.edge[self.begins] = True

    def levels(self):
        """For each level: whether a name begins at each place (one more place at the end); and the names of the last level."""
        n = len(self.words)
        starts, names = np.arange(n), self.words
        yield np.ones(n + 1, bool), names
        new = np.concatenate(([True], names[1:] != names[:-1])) | self.edge[:n] if n else np.zeros(0, bool)
        at = np.flatnonzero(new)
        length = np.diff(np.append(at, n)).astype(U)
        starts, names = starts[at], np.where(length > 1, named(names[at], length + U(1 << 40)), names[at])
        yield self.boundaries(starts), names
        for level in range(LEVELS):
            right = (mixed(names + U((int(A) * (level + 1)) % 2**64)) & U(1)).astype(bool)
            pair = np.zeros(len(names), bool)
            if len(names) > 1:
                pair[:-1] = ~right[:-1] & right[1:] & ~self.edge[starts[1:]]
            second = np.concatenate(([False], pair[:-1])) if len(names) else pair
            first = np.flatnonzero(~second)
            names = np.where(pair[first], named(names[first], names[np.minimum(first + 1, len(names) - 1)]), names[first])
            starts = starts[first]
            yield self.boundaries(starts), names

    def boundaries(self, starts):
        out = np.zeros(len(self.words) + 1, bool)
        out[starts] = True
        out[-1] = True
        return out

    def symbols(self):
        """Names of the last level, their starts and lengths in words."""
        *_, (bounds, names) = self.levels()
        starts = np.flatnonzero(bounds)
        return names, starts[:-1], np.diff(starts)

    def windows(self) -> np.ndarray:
        """Starts of the windows, which lie in one text each."""
        n = np.diff(self.begins)
        return np.concatenate([np.arange(b, b + k - WINDOW + 1) for b, k in zip(self.begins[:-1], n, strict=True) if k >= WINDOW] or [np.zeros(0, np.int64)])

    def candidates(self, shared: np.ndarray) -> np.ndarray:
        """Starts of windows without an informative name in the interior that is not shared (a sorted array)."""
        at = self.windows()
        left, right, below, names = at, at + WINDOW, None, None
        for bounds, names in self.levels():
            if below is not None:
                after, before = following(below), preceding(below)
                up, down = following(bounds), preceding(bounds)
                left = up[np.minimum(after[np.minimum(left + 1, len(bounds) - 1)], len(bounds) - 1)]
                right = down[np.maximum(before[np.maximum(right - 1, 0)], 0)]
            below = bounds
        starts = np.flatnonzero(below)
        bad = (np.diff(starts) >= INFORMATIVE) & ~is_in(names, shared)
        total = np.zeros(len(below) + 1, np.int32)
        np.add.at(total, starts[:-1] + 1, bad.astype(np.int32))
        total = np.cumsum(total)  # at a boundary: bad names that begin before it
        return at[(left >= right) | (total[np.maximum(left, right)] == total[left])]

    def fingerprints(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the windows that begin at the places, from the words' first hashes and, in 32 bits, from their second ones."""

        def of(words):
            h = {1: words}
            for k in (1, 2, 4, 8, 16):
                h[2 * k] = named(h[k][: len(h[k]) - k], h[k][k:])
            return named(h[32][at], named(h[2][at + 32], h[1][at + 34]))

        return of(self.words), (of(np.frombuffer(_hashes.second, U)[self.place]) >> U(32)).astype(np.uint32)


def following(bounds: np.ndarray) -> np.ndarray:
    """The first boundary at or after each place."""
    n = len(bounds)
    return np.minimum.accumulate(np.where(bounds, np.arange(n), n - 1)[::-1])[::-1]


def preceding(bounds: np.ndarray) -> np.ndarray:
    return np.maximum.accumulate(np.where(bounds, np.arange(len(bounds)), 0))


def is_in(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def grouped(batches):
    """(files, rows, word lists, extra blobs) of about GROUP_WORDS words at a time."""
    files, rows, texts, extra, size = [], [], [], [], 0
    for batch in batches:
        more = batch.column("extra") if "extra" in batch.schema.names else [None] * batch.num_rows
        for f, r, t, x in zip(batch.column(FILE).to_pylist(), batch.column(ROW).to_pylist(), batch.column("text"), more, strict=True):
            words = words_of(t.as_py())
            if len(words) >= WINDOW:
                files.append(f)
                rows.append(r)
                texts.append(words)
                extra.append(x.as_py() if x is not None else None)
                size += len(words)
            if size >= GROUP_WORDS:
                yield files, rows, texts, extra
                files, rows, texts, extra, size = [], [], [], [], 0
    if texts:
        yield files, rows, texts, extra


SENT = "bucket long, `group` long, value binary, check binary, place binary, many binary, begins binary, files array<string>, rows array<long>"


BACK = ["group", "value", "place", "begins", "files", "rows"]


def to_send(group: int, buckets: int, begins, files, rows, value, check, place):
    """A group's rows: to each bucket its values once, and one to itself with what it knows to be repeated already."""
    order = np.lexsort((place, check, value))
    value, check, place = value[order], check[order], place[order]
    new = np.concatenate(([True], (value[1:] != value[:-1]) | (check[1:] != check[:-1]))) if len(value) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    many = np.diff(np.append(head, len(value))) > 1
    known = np.repeat(many, np.diff(np.append(head, len(value)))) if len(value) else new
    empty = b""
    out = [(-1 - group, group, value[known].tobytes(), empty, place[known].astype(np.uint32).tobytes(), empty, begins.astype(np.uint32).tobytes(), files, rows)]
    value, check, place = value[head], check[head], place[head]
    to = (mixed(value) % U(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    there, first = np.unique(to[order], return_index=True)  # buckets that get a value: with many buckets, few of them
    for b, i in zip(there.tolist(), np.split(order, first[1:]), strict=True) if len(there) else ():
        out.append((b, group, value[i].tobytes(), check[i].tobytes(), place[i].astype(np.uint32).tobytes(), np.packbits(many[i]).tobytes(), None, None, None))
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64()))
    names = ["bucket", "group", "value", "check", "place", "many", "begins", "files", "rows"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def answer(table: pa.Table) -> pa.Table:
    """A bucket's values that several groups have or one has many times, sent back to the groups that have them once.

    What a group keeps for itself (buckets below 0) goes through as it is.
    """
    if table.column("bucket")[0].as_py() < 0:
        return table.select(BACK)
    groups, values, places = table.column("group").to_pylist(), table.column("value").to_pylist(), table.column("place").to_pylist()
    size = [len(v) // 8 for v in values]
    value = np.frombuffer(b"".join(values), U)
    check = np.frombuffer(b"".join(table.column("check").to_pylist()), np.uint32)
    many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(table.column("many").to_pylist(), size, strict=True)]).astype(bool)
    order = np.lexsort((check, value))
    v, c = value[order], check[order]
    same = (v[1:] == v[:-1]) & (c[1:] == c[:-1])
    hit = np.zeros(len(v), bool)
    hit[1:] |= same
    hit[:-1] |= same
    back = np.zeros(len(v), bool)
    back[order] = hit
    back &= ~many  # such groups know
    ends = np.cumsum([0, *size])
    out = []
    for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        keep = back[a:b]
        if keep.any():
            out.append((groups[i], value[a:b][keep].tobytes(), np.frombuffer(places[i], np.uint32)[keep].tobytes()))
    cols = list(zip(*out, strict=True)) if out else [[], [], []]
    n = len(cols[0])
    own = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())]
    return pa.table([*own, pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(pa.string())), pa.nulls(n, pa.list_(pa.int64()))], names=BACK)


def by_text(with_value: bool):
    """Function for all rows of a group: for each text with repeated values the values, sorted, or else their places in the text."""

    def run(table: pa.Table) -> pa.Table:
        begins = next(b for b in table.column("begins").to_pylist() if b is not None)
        files = next(f for f in table.column("files").to_pylist() if f is not None)
        rows = next(r for r in table.column("rows").to_pylist() if r is not None)
        begins = np.frombuffer(begins, np.uint32).astype(np.int64)
        value = np.frombuffer(b"".join(table.column("value").to_pylist()), U)
        place = np.frombuffer(b"".join(table.column("place").to_pylist()), np.uint32).astype(np.int64)
        order = np.argsort(place, kind="stable")
        value, place = value[order], place[order]
        cuts = np.searchsorted(place, begins)
        out = []
        for i in range(len(begins) - 1):
            a, b = cuts[i], cuts[i + 1]
            if b > a:
                out.append((files[i], rows[i], np.unique(value[a:b]).tobytes() if with_value else (place[a:b] - begins[i]).astype(np.uint32).tobytes()))
        cols = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.table({FILE: pa.array(cols[0], pa.string()), ROW: pa.array(cols[1], pa.int64()), "extra": pa.array(cols[2], pa.binary())})

    return run


def repeated(sent: DataFrame, with_value: bool) -> DataFrame:
    """(file, row, extra) of the texts that have values which occur more than once in all that was sent."""
    answers = sent.groupBy("bucket").applyInArrow(answer, "`group` long, value binary, place binary, begins binary, files array<string>, rows array<long>")
    return answers.groupBy("group").applyInArrow(by_text(with_value), f"{FILE} string, {ROW} long, extra binary")


def send_names(docs: DataFrame, buckets: int) -> DataFrame:
    def run(batches):
        part = TaskContext.get().partitionId() << 32
        for k, (files, rows, texts, _) in enumerate(grouped(batches)):
            g = Group(texts)
            names, starts, length = g.symbols()
            keep = length >= INFORMATIVE
            yield to_send(part + k, buckets, g.begins, files, rows, names[keep], np.zeros(int(keep.sum()), np.uint32), starts[keep])

    return docs.mapInArrow(run, SENT)


def send_windows(docs: DataFrame, buckets: int) -> DataFrame:
    """docs with ``extra``: the shared names of each text."""

    def run(batches):
        part = TaskContext.get().partitionId() << 32
        for k, (files, rows, texts, extra) in enumerate(grouped(batches)):
            g = Group(texts)
            shared = np.unique(np.frombuffer(b"".join(x for x in extra if x), U))
            at = g.candidates(shared)
            value, check = g.fingerprints(at) if len(at) else (np.zeros(0, U), np.zeros(0, np.uint32))
            yield to_send(part + k, buckets, g.begins, files, rows, value, check, at)

    return docs.mapInArrow(run, SENT)


def covered(starts: np.ndarray, n: int) -> np.ndarray:
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + WINDOW, -1)
    return np.cumsum(steps[:n]) > 0


def cut(docs: DataFrame, kind: str, with_text: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = []
            for text, x in zip(batch.column("text"), batch.column("extra"), strict=True):
                words = words_of(text.as_py())
                n, removed = len(words), 0
                if (blob := x.as_py()) is not None:
                    gone = covered(np.frombuffer(blob, np.uint32).astype(np.int64), n)
                    removed = int(gone.sum())
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                kept = b" ".join(words)
                out.append((n, removed, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass") if with_text else None))
            c = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string()), pa.array(c[3], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return docs.select("doc_id", "text", "extra").mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, with_text: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256, and kept_text (null unless asked for)."""
    spark = docs.sparkSession
    rows = located(text_batches(docs)).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), FILE, ROW)
    # As many buckets as there are input splits or shuffle partitions, so a bucket doesn't grow with the table.
    buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    names = stored(repeated(send_names(rows.select(FILE, ROW, "text"), buckets), with_value=True), "repeat-shared")
    # Both joins have the same rows on their left, dealt the same way, so Spark moves the texts once and reads them twice.
    marked = rows.join(names, [FILE, ROW], "left")
    # Groups are numbered in the order of rows, which must be the same when a lost task runs again, whatever join Spark takes.
    marked = marked.select("doc_id", "text", FILE, ROW, "extra").sortWithinPartitions(FILE, ROW)
    found = repeated(send_windows(marked, buckets), with_value=False)
    return cut(rows.join(found, [FILE, ROW], "left"), dict(docs.dtypes)[id_col], with_text)


def brute_force(texts: list[str | None]) -> list[tuple[int, int, str]]:
    seen: dict[tuple, int] = {}
    lists = [words_of(t) for t in texts]
    for w in lists:
        for i in range(len(w) - WINDOW + 1):
            k = tuple(w[i : i + WINDOW])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for w in lists:
        gone = set()
        for i in range(len(w) - WINDOW + 1):
            if seen[tuple(w[i : i + WINDOW])] > 1:
                gone.update(range(i, i + WINDOW))
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out
