"""Packing token sequences by vector bin packing.

Items have three sizes: tokens, segments (each item is one) and loss-bearing tokens. A bin takes, of the items that still fit, the
one whose size vector has the largest dot product with what the bin has left, each dimension in parts of its limit. Items that may
be cut (documents, of which every token bears loss) are cut where nothing fits and a worthwhile gap remains; a bin that the limit
of segments closes, and what is left over in the last bin of a task, are dealt out in lengths that are powers of two, which need no
padding. Items that may not be cut
(instruction data) and are over a limit by themselves are returned alone, marked ``oversize``.

Each task packs what it reads, in groups of bounded size, so nothing is shuffled and memory does not depend on the table. A
sequence's id is made of the task's partition and a counter. Cases: null text packs as empty (its end token only); equal, repeated
and null ids are fine, as rows are packed one by one; of items whose dot products tie the first is taken; a very long text is encoded
word by word and gives full sequences at once, so only its ids are held; an empty table gives no pieces; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import text_batches

LIMITS = (2048, 512, 2048)
#: Tokens, conversations and loss-bearing tokens of a sequence of instruction data.
CONVERSATION_LIMITS = (8192, 12, 5000)
GROUP_ITEMS, GROUP_TOKENS, MIN_CUT = 4096, 4 << 20, 16
CACHE_WORDS, LONG_WORD = 500_000, 64


#: Below U+0250 composed characters stay as they are, and lower case is the same for both languages' libraries.
OTHER = re.compile("[^\x00-\u024f]|<\\|")
LETTERS = re.compile("[a-z\u00e0-\u00f6\u00f8-\u00ff]+")
STOP = re.compile("(?<=[a-z\u00e0-\u00f6\u00f8-\u00ff])([.,]) ")


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


END = b"\xff"  # no part of UTF-8


def merge_ranks(vocab: dict[str, int], special: set[str]) -> dict[bytes, int]:
    """The vocabulary for a merger of bytes: the mark of a word's end becomes a byte, whose pairs with single bytes rank first."""
    of, ranks = byte_of(), {}
    for token, i in vocab.items():
        if token not in special:
            body = bytes(of[c] for c in token.removesuffix("</w>"))
            if len(body) == 1 or END not in body:
                ranks[body + END * token.endswith("</w>")] = i
    return ranks


class WordEncoder(dict):
    """Blank-free strings to ids as little-endian 32-bit bytes; texts are encoded by their words.

    The vocabulary's normaliser and splitter never join characters over a blank, so a text's ids are those of its words in turn; a
    full stop or comma between a letter and a blank is a token of its own. New words of letters go to a faster merger over the same
    vocabulary, which merges alike since each token is what merging its own characters gives (a test holds that); all else goes to
    the vocabulary's library.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = Tokenizer.from_file(path)
        self.library = own.encode
        special = {t.content for t in own.get_added_tokens_decoder().values()}
        self.merge = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=merge_ranks(own.get_vocab(), special), special_tokens={})._encode_single_piece

    def __missing__(self, word: str) -> bytes:
        ids = self.merge(word.encode() + END) if LETTERS.fullmatch(word) else self.library(word, add_special_tokens=False).ids
        data = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= LONG_WORD:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = data
        return data

    def split(self, text: str) -> list[str]:
        text = BLANK.sub(" ", text)
        return text.split(" ") if OTHER.search(text) else STOP.sub(r" \1 ", text.lower()).split(" ")

    def encode(self, text: str, end: int) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text))) + end.to_bytes(4, "little")


BLANK = re.compile(r"[\n\t\r]")
_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """A worker keeps its words from task to task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def fill(tokens: np.ndarray, segments: np.ndarray, loss: np.ndarray, limits=LIMITS, cut: bool = True, min_cut: int = MIN_CUT) -> Iterator[list[tuple[int, int, int]]]:
    """Bins of (item, start, length); the last one may be anything but full. Every item must fit a bin, but for those to cut."""
    cap = np.asarray(limits, float)
    size = np.stack([tokens, segments, loss]).astype(float)
    start, alive = np.zeros(len(tokens), int), np.ones(len(tokens), bool)
    todo = len(tokens)
    while todo:
        left, chosen = cap.copy(), []
        while todo:
            fits = alive & (size <= left[:, None]).all(0)
            if fits.any():
                i = int(np.where(fits, (left / cap / cap) @ size, -1).argmax())
                chosen.append((i, int(start[i]), int(size[0, i])))
                left -= size[:, i]
                alive[i] = False
                todo -= 1
            elif cut and left[0] >= min_cut and left[1] >= 1:
                i = int(np.where(alive, size[0], -1).argmax())
                gap = int(left[0])
                chosen.append((i, int(start[i]), gap))
                start[i] += gap
                size[0, i] -= gap
                size[2, i] -= gap
                break
            else:
                break
        yield chosen


def powers(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """The pieces of one bin in bins whose lengths are powers of two."""
    pieces, total = [list(p) for p in pieces], sum(p[2] for p in pieces)
    while total:
        want = 1 << (total.bit_length() - 1)
        total -= want
        out = []
        while want:
            item, start, n = pieces[0]
            take = min(n, want)
            out.append((item, start, take))
            want -= take
            pieces[0] = [item, start + take, n - take]
            if take == n:
                pieces.pop(0)
        yield out


def pack_rows(rows: Iterator[tuple[object, bytes]], first: int, limits=LIMITS) -> Iterator[list[tuple]]:
    """Lists of (id, start, length, crc32, document's tokens, sequence, offset) for rows of (id, ids as bytes); all may be cut."""
    most = limits[0]
    pool: list[tuple[object, bytes, int, int]] = []  # id, ids, tokens already in pieces, tokens of the document
    sequence, held = first, 0

    def piece(item, start, n, at):
        key, ids, _, total = item
        return (key, start, n, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + n)]), total, sequence, at)

    def close(pieces):
        nonlocal sequence
        at, out = 0, []
        for item, start, n in pieces:
            out.append(piece(item, start, n, at))
            at += n
        sequence += 1
        return out

    def packed(last: bool):
        nonlocal pool
        lengths = np.array([x[3] - x[2] for x in pool])
        bins = [[(pool[i], pool[i][2] + a, n) for i, a, n in b] for b in fill(lengths, np.ones_like(lengths), lengths, limits)] if pool else []
        tail = bins.pop() if bins and sum(p[2] for p in bins[-1]) < most - MIN_CUT else []
        # A bin that the limit of segments closed is dealt out in powers of two as well.
        out = [r for b in bins for c in ([b] if sum(p[2] for p in b) >= most - MIN_CUT else powers(b)) for r in close(c)]
        if last:
            out += [r for b in powers(tail) for r in close(b)]
            pool = []
        else:  # what didn't fill a bin waits for the next group
            pool = [(x[0], x[1], a, x[3]) for x, a, n in tail if a + n == x[3]]
            out += [r for x in [t for t in tail if t[1] + t[2] != t[0][3]] for r in close([x])]
        return out

    for key, ids in rows:
        n = len(ids) // 4
        item, whole = (key, ids, n - n % most, n), []
        for a in range(0, item[2], most):
            whole += close([(item, a, most)])
        if whole:
            yield whole
        if n % most:
            pool.append(item)
            held += n
        if len(pool) >= GROUP_ITEMS or held >= GROUP_TOKENS:
            yield packed(last=False)
            held = sum(len(x[1]) // 4 for x in pool)
    yield packed(last=True)


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limits=LIMITS, end: int = 1) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. path: a tokenizers .json file."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        id_type = None

        def rows():
            nonlocal id_type
            for batch in batches:
                id_type = batch.column(id_col).type
                own = encoder(path)
                for key, text in zip(batch.column(id_col).to_pylist(), batch.column(text_col), strict=True):
                    yield key, own.encode(text.as_py() or "", end)

        for out in pack_rows(rows(), TaskContext.get().partitionId() << 33, limits):
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["doc_id", *(x.split()[0] for x in PIECES.split(", "))])

    return text_batches(docs).select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, {PIECES}")


def pack_examples(examples: DataFrame, id_col: str, tokens_col: str, loss_col: str, limits=LIMITS) -> DataFrame:
    """Whole examples of given sizes in bins under all three limits: id, sequence_id, offset, oversize. Nulls count as 0."""
    kind = dict(examples.dtypes)[id_col]

    def run(batches):
        sequence = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP_ITEMS):
                part = batch.slice(at, GROUP_ITEMS)
                keys = part.column(id_col).to_pylist()
                tokens, loss = (np.array([x or 0 for x in part.column(c).to_pylist()], np.int64) for c in (tokens_col, loss_col))
                over = (tokens > limits[0]) | (loss > limits[2])
                out = []
                for i in np.flatnonzero(over):
                    out.append((keys[i], sequence, 0, True))
                    sequence += 1
                fit = np.flatnonzero(~over)
                for b in fill(tokens[fit], np.ones(len(fit)), loss[fit], limits, cut=False):
                    offset = 0
                    for i, _, n in b:
                        out.append((keys[fit[i]], sequence, offset, False))
                        offset += n
                    sequence += 1
                if out:
                    c = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], part.column(id_col).type), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.bool_())], names=[id_col, "sequence_id", "offset", "oversize"])

    return examples.select(id_col, tokens_col, loss_col).mapInArrow(run, f"`{id_col}` {kind}, sequence_id long, offset long, oversize boolean")


def conversation_sizes(turns: DataFrame, path: str, conv_col: str = "conv_id", role_col: str = "role", text_col: str = "text", bearer: str = "assistant", end: int = 1) -> DataFrame:
    """conv_id, tokens, loss of each conversation: a turn has its text's tokens and an end token; those of the bearer's turns bear loss. Null text is empty."""
    kind = dict(turns.dtypes)[conv_col]

    def run(batches):
        for batch in batches:
            own = encoder(path)
            n = [len(own.encode(t.as_py() or "", end)) // 4 for t in batch.column(2)]
            loss = [k if r == bearer else 0 for k, r in zip(n, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(loss, pa.int64())], names=["conv_id", "tokens", "loss"])

    sized = text_batches(turns).select(conv_col, role_col, text_col).mapInArrow(run, f"conv_id {kind}, tokens long, loss long")
    return sized.groupBy("conv_id").agg(F.sum("tokens").alias("tokens"), F.sum("loss").alias("loss"))


def pack_conversations(turns: DataFrame, path: str, limits=CONVERSATION_LIMITS, conv_col: str = "conv_id") -> DataFrame:
    """Whole conversations in sequences under limits on tokens, conversations and loss-bearing tokens: conv_id, tokens, loss, sequence_id, offset, oversize.

    Turns without a conversation id are one conversation. Only sizes are moved. Conversations are packed in the order of their ids within each
    task, so that a task that runs again packs alike.
    """
    sizes = conversation_sizes(turns, path, conv_col)
    dealt = sizes.repartition(F.col("conv_id")).sortWithinPartitions("conv_id")
    placed = pack_examples(dealt, "conv_id", "tokens", "loss", limits)
    return placed.join(sizes, placed["conv_id"].eqNullSafe(sizes["conv_id"])).select(placed["conv_id"], "tokens", "loss", "sequence_id", "offset", "oversize")
