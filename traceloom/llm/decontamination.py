"""Benchmark decontamination with one Aho-Corasick automaton.

Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII. Every window of 10 words of a test item is looked
for (a shorter item is one window as a whole). The windows of an item overlap, so the automaton holds, of an item's words, only the
groups of five at every fifth place: any window has one in it. It reads each document once, as a string of three characters a word
from the items' vocabulary; where a group ends, up to five words on either side are compared with the item's, which finds exactly the
windows around the group. The match's offset leads back to the words and, for spans, to the characters of the original text.

The items' words (``MOST_WORDS`` at most; more is an error, not a smaller result) go to the workers as one array with its vocabulary,
and each worker builds the automaton once: at most one pattern of 15 characters for five words, about 100 MB a million words.

Cases: null texts have no words, and items without words are no patterns; a window that several items share counts for each; null
item ids count as no item id but still mark words; rows are judged one by one, so repeated rows and null ids don't matter; very long
texts are read as a whole, by one task, in time and memory proportional to their length; extra columns are ignored (``report``) or kept
(``drop_contaminated``), whatever their names; an empty benchmark leaves all documents clean, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import ddl, slices, text_batches

WINDOW, GROUP = 10, 5
MOST_WORDS = 4_000_000
PAIRS_AT_ONCE = 1 << 20
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE, UNKNOWN = 128, "\x80\x80\x80"


def words_of(text: str | None) -> list[bytes]:
    # Only ASCII bytes change, so this works on UTF-8; bytes.split would also split at 0x85 and 0xA0 in str, not in bytes.
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def code(i: int) -> str:
    """Three characters, each place with characters of its own, so that no pattern is found across words."""
    return chr(0x100 + i // (BASE * BASE)) + chr(0x200 + i // BASE % BASE) + chr(0x300 + i % BASE)


class Items:
    """The words of all items end to end, as places in the vocabulary, and where each item begins; small enough to be sent about."""

    def __init__(self, rows: Iterable[tuple], most_words: int = MOST_WORDS):
        self.key, self.names, begins, parts, vocabulary = uuid.uuid4().hex, [], [], [], {}
        n = 0
        for item, text in rows:
            words = words_of(text)
            if not words:
                continue
            self.names.append(item)
            begins.append(n)
            parts.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int32, len(words)))
            n += len(words)
            if n > most_words or len(vocabulary) > BASE**3:
                raise ValueError(f"the benchmark has more than {most_words} words; scan for it in parts")
        self.begins = np.array([*begins, n], np.int64)
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self.vocabulary = list(vocabulary)


class Matcher:
    """The automaton over the items, and the words beside each group of five."""

    def __init__(self, items: Items, size: int = WINDOW, group: int = GROUP):
        import ahocorasick

        if size != 2 * group:
            raise ValueError("a window has two groups")
        codes = [code(i) for i in range(len(items.vocabulary))]
        self.names, self.group = items.names, group
        self.code = dict(zip(items.vocabulary, codes, strict=True))
        n = len(items.names)
        # Between items there are as many words that equal none as are compared on either side.
        self.words = np.full(len(items.words) + (n + 1) * group, -1, np.int32)
        self.item = np.repeat(np.arange(n), np.diff(items.begins))
        at = np.arange(len(items.words)) + (self.item + 1) * group
        self.words[at] = items.words
        self.item_at = np.zeros(len(self.words), np.int32)
        self.item_at[at] = self.item
        patterns: dict[str, int] = {}
        self.whole: dict[int, tuple[int, list[int]]] = {}
        of, place = [], []
        for i, (a, b) in enumerate(zip(items.begins[:-1].tolist(), items.begins[1:].tolist(), strict=True)):
            own = [codes[w] for w in items.words[a:b]]
            if len(own) < size:
                k = patterns.setdefault("".join(own), len(patterns))
                self.whole.setdefault(k, (len(own), []))[1].append(i)
                continue
            for j in range(0, len(own) - group + 1, group):
                of.append(patterns.setdefault("".join(own[j : j + group]), len(patterns)))
                place.append(a + j + (i + 1) * group)
        order = np.argsort(np.array(of, np.int64), kind="stable")
        self.places = np.array(place, np.int64)[order]
        self.cuts = np.searchsorted(np.array(of, np.int64)[order], np.arange(len(patterns) + 1))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for p, k in patterns.items():
            self.automaton.add_word(p, k)
        self.empty = not patterns
        if patterns:
            self.automaton.make_automaton()

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Ranges of words [a, b) in which windows occur, and the items they come from."""
        ranges: list[tuple[int, int]] = []
        found: set[int] = set()
        if self.empty or not words:
            return ranges, set()
        get = self.code.get
        line = "".join([get(w, UNKNOWN) for w in words])
        ends, kinds = [], []
        for at, k in self.automaton.iter(line):
            end = (at + 1) // 3
            if k in self.whole:
                n, own = self.whole[k]
                ranges.append((end - n, end))
                found.update(own)
            ends.append(end)
            kinds.append(k)
        if ends:
            marks = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.int64).reshape(-1, 3) - np.array([0x100, 0x200, 0x300])
            doc = np.full(len(words) + 2 * self.group, -2, np.int64)
            doc[self.group : -self.group] = np.where(marks[:, 0] < 0, -2, marks @ np.array([BASE * BASE, BASE, 1]))
            first, kind = np.array(ends) - self.group, np.array(kinds)
            n = self.cuts[kind + 1] - self.cuts[kind]
            total = np.cumsum(n)
            for lo in range(0, int(total[-1]), PAIRS_AT_ONCE):
                pair = np.arange(lo, min(lo + PAIRS_AT_ONCE, int(total[-1])))
                hit = np.searchsorted(total, pair, side="right")
                self.around(doc, first[hit], self.places[self.cuts[kind[hit]] + pair - (total[hit] - n[hit])], ranges, found)
        return ranges, {self.names[i] for i in found}

    def around(self, doc: np.ndarray, at: np.ndarray, place: np.ndarray, ranges: list, found: set) -> None:
        """Windows around groups at words ``at`` of the document, which are at ``place`` of the items."""
        reach = []
        for step, start in ((-1, -1), (1, self.group)):
            alive, n = np.ones(len(at), bool), np.zeros(len(at), np.int64)
            for j in range(self.group):
                alive &= doc[at + self.group + start + step * j] == self.words[place + start + step * j]
                n += alive
            reach.append(n)
        good = reach[0] + reach[1] >= self.group
        spans_of = np.unique(np.stack([at[good] - reach[0][good], at[good] + self.group + reach[1][good]], 1), axis=0)
        ranges.extend(map(tuple, spans_of.tolist()))
        found.update(np.unique(self.item_at[place[good]]).tolist())


_matchers: dict[str, Matcher] = {}


def matcher(items: Items) -> Matcher:
    """A worker keeps the automaton of the benchmark it had last."""
    if items.key not in _matchers:
        _matchers.clear()
        _matchers[items.key] = Matcher(items)
    return _matchers[items.key]


def mask(ranges: list[tuple[int, int]], n: int) -> np.ndarray:
    steps = np.zeros(n + 1, np.int32)
    for a, b in ranges:
        steps[a] += 1
        steps[b] -= 1
    return np.cumsum(steps[:n]) > 0


def spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Character ranges of the original text that the hit words make up, neighbours joined."""
    out: list[tuple[int, int]] = []
    last = -2
    for i, m in enumerate(WORD.finditer(text)):
        if hit[i]:
            if last == i - 1 and out:
                out[-1] = (out[-1][0], m.end())
            else:
                out.append(m.span())
            last = i
    return out


def collected(benchmark: DataFrame, item_col: str, text_col: str, most_words: int) -> Items:
    """One partition at a time comes to the driver; it ends with an error as soon as the bound is passed."""
    return Items(((r[0], r[1]) for r in benchmark.select(item_col, text_col).toLocalIterator()), most_words)


FOUND = "n_words long, hit array<struct<first:int,end:int>>, items array<string>, spans array<struct<start:int,end:int>>"


def scan(
    docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    with_spans: bool = True, most_words: int = MOST_WORDS,
) -> DataFrame:
    """The columns ``keep`` of docs, with n_words, hit (ranges of words), items (sorted ids) and spans (characters of the text)."""
    if clash := {"n_words", "hit", "items", "spans"} & set(keep):
        raise ValueError(f"rename {sorted(clash)}, which scan adds")
    shared = docs.sparkSession.sparkContext.broadcast(collected(benchmark, item_col, item_text_col, most_words))
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
    span_kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        own = matcher(shared.value)
        for batch in slices(batches):
            counts, hits, found, where = [], [], [], []
            for t in batch.column(batch.num_columns - 1):
                text = t.as_py()
                words = words_of(text)
                ranges, items = own.hits(words)
                counts.append(len(words))
                found.append(sorted(str(i) for i in items if i is not None))
                hit = mask(ranges, len(words)) if ranges else None
                edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0])))) if ranges else []
                hits.append([{"first": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)])
                where.append([{"start": a, "end": b} for a, b in spans(text, hit)] if ranges and with_spans else [])
            new = [pa.array(counts, pa.int64()), pa.array(hits, kind), pa.array(found, pa.list_(pa.string())), pa.array(where, span_kind)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=[*keep, "n_words", "hit", "items", "spans"])

    rows = text_batches(docs).select(*keep, F.col(text_col).alias("traceloom_text"))
    return rows.mapInArrow(run, f"{ddl(docs.select(*keep))}, {FOUND}")


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_words: int = MOST_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = scan(rows, benchmark, with_spans=False, most_words=most_words)
    n_hit = F.aggregate("hit", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["first"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most_words: int = MOST_WORDS) -> DataFrame:
    """docs in which no window occurs; same columns."""
    shared = docs.sparkSession.sparkContext.broadcast(collected(benchmark, item_col, item_text_col, most_words))

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        own = matcher(shared.value)
        return pa.array([not own.hits(words_of(t.as_py()))[0] for t in texts], pa.bool_())

    return text_batches(docs).filter(clean(F.col(text_col)))


def brute_force(text: str | None, items: list[tuple], size: int = WINDOW) -> tuple[int, int, list[str], str]:
    """What the report says of one text, by comparing word lists at every place."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, hit, found = WORD.findall(low), set(), set()
    for item, own in items:
        pattern = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in own or ""))
        for p in [pattern[i : i + size] for i in range(max(1, len(pattern) - size + 1))] if pattern else []:
            for i in range(len(words) - len(p) + 1):
                if words[i : i + len(p)] == p:
                    hit.update(range(i, i + len(p)))
                    found.add(str(item))
    ids = sorted(found)
    return len(words), len(hit), ids, hashlib.sha256(",".join(ids).encode()).hexdigest()
