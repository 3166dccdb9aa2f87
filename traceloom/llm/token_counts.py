"""Token counts by a compiled finite-state transducer.

A byte-fallback BPE vocabulary becomes a deterministic transducer over characters. A sequence of tokens is the encoding of its text
exactly if each two neighbours are the encoding of theirs; so the last token of every prefix is the only one that agrees with the
token before it, and a state needs to hold no more than the piece beginnings that end here, each with the token before it and its
count. A transition is annotated with the number of tokens by which the count changes. States are compiled as texts reach them.

Pieces have blanks at their front only, so a blank after another character leads to one state whatever came before, and so does a
character that is part of no longer piece. A chunk's map of states is therefore its head (before the first such place), a count, and
its tail (after the last); two maps compose by running tail and head from the synchronised state, which is associative. A text of more
than ``CHUNK`` characters is cut into chunks, which are rows of their own and are dealt to tasks; their maps are composed by a tree of
aggregations, ``FANOUT`` neighbours at a time, so no task reads the text. Paths between two such places are kept as one transition (a word).

Cases: null text counts as empty, with 0 tokens; rows are counted one by one, so null and repeated ids are fine; special strings
are ordinary text; a text without a place that synchronises is composed by joining its chunks, in one task; extra columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import counted, slices, text_batches

CHUNK, FANOUT = 1 << 17, 32
LIMIT = 4096
CACHE_WORDS, CACHE_STATES, LONG_WORD = 400_000, 250_000, 64
STOPS = frozenset(".,;:!?")
BLANK = "▁"
WORDS = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")


class Transducer:
    """states[i]: the beginnings that end here, as (piece beginning, token before, count before less the count here)."""

    def __init__(self, pieces: dict[str, float]):
        if any(BLANK in p.lstrip(BLANK) for p in pieces):
            raise ValueError("a piece has a blank behind another character")
        self.score = pieces
        self.starts = {p[:i] for p in pieces for i in range(1, len(p))}
        self.single = {c for p in pieces if len(p) > 1 for c in p}
        self.root = (("", None, 0),)
        self.whole: dict[str, bool] = {}
        self.forget()

    def forget(self) -> None:
        """Drops what was compiled, which is compiled again as it is needed."""
        self.ids: dict[tuple, int] = {self.root: 0}
        self.states: list[tuple] = [self.root]
        self.steps: list[dict[str, tuple[int, int]]] = [{}]
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, tuple[int, int]] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging, best score and then leftmost first."""
        out = list(text)
        while True:
            best = max(((s, -i) for i in range(len(out) - 1) if (s := self.score.get(out[i] + out[i + 1])) is not None), default=None)
            if best is None:
                return out
            i = -best[1]
            out[i : i + 2] = [out[i] + out[i + 1]]

    def weight(self, token: str) -> int:
        return 1 if token in self.score else len(token.encode("utf-8", "surrogatepass"))

    def agree(self, a: str | None, b: str) -> bool:
        if a is None:
            return True
        if (a, b) not in self.pairs:
            self.pairs[a, b] = self.merged(a + b) == [a, b]
        return self.pairs[a, b]

    def complete(self, p: str) -> bool:
        """Whether merging its characters gives the piece."""
        if len(p) == 1:
            return True
        if p not in self.whole:
            self.whole[p] = self.merged(p) == [p]
        return self.whole[p]

    def compile(self, state: int, c: str) -> tuple[int, int] | None:
        """Next state and tokens gained; None where no or more than one token agrees (runs of equal scores)."""
        found, live = [], []
        for start, before, count in self.states[state]:
            p = start + c
            if (p in self.score or len(p) == 1) and self.complete(p) and self.agree(before, p):
                found.append((p, count + self.weight(p)))
            if p in self.starts:
                live.append((p, before, count))
        if len(found) != 1:
            return None
        last, gain = found[0]
        after = (("", last, 0), *((p, before, count - gain) for p, before, count in live))
        if after not in self.ids:
            self.ids[after] = len(self.states)
            self.states.append(after)
            self.steps.append({})
        return self.ids[after], gain

    def run(self, word: str, state: int = 0, total: int = 0) -> tuple[int, int]:
        """The state behind the word and its tokens, from a state and tokens before; state -1 where no transition is known."""
        steps = self.steps
        for c in word:
            step = steps[state].get(c)
            if step is None:
                step = self.compile(state, c)
                if step is None:
                    return -1, 0
                steps[state][c] = step
            state, gain = step
            total += gain
        return state, total

    def word(self, word: str) -> int:
        """Tokens of the text between two synchronised places; the path of its stem is kept as one transition."""
        stem, end = (word[:-1], word[-1]) if word[-1:] in STOPS else (word, "")
        found = self.words.get(stem)
        if found is None:
            found = self.run(stem)
            if len(stem) <= LONG_WORD:
                if len(self.words) >= CACHE_WORDS:
                    self.words.clear()
                self.words[stem] = found
        if end and found[0] >= 0:
            found = self.run(end, *found)
        n = found[1] if found[0] >= 0 else sum(map(self.weight, self.merged(word)))
        if len(self.states) > CACHE_STATES:
            self.forget()
        return n

    def line(self, text: str) -> int:
        """Tokens of a text with blanks for spaces and without line ends."""
        if BLANK * 2 in text or not text:
            return sum(map(self.word, WORDS.findall(text)))
        first, *rest = text.split(BLANK)
        return (self.word(first) if first else 0) + sum(map(self.word, [BLANK + w for w in rest]))

    def body(self, text: str) -> int:
        if "\n" in self.single:
            return self.line(text)
        lines = text.split("\n")  # a character of no longer piece: a token (or its bytes) of its own, and a synchronised place
        return sum(map(self.line, lines)) + (len(lines) - 1) * self.weight("\n")

    def chunk(self, text: str) -> tuple[str, int, str] | str:
        """The map of a chunk: head, tokens, tail; the text itself if it has no synchronised place."""
        places = [m.start() + 1 for m in re.finditer(f"[^{BLANK}]{BLANK}", text)]
        if not places:
            return text
        return text[: places[0]], self.body(text[places[0] : places[-1]]), text[places[-1] :]

    def compose(self, a, b):
        """The map of chunk a and then b; it may not matter in which order three are composed."""
        if isinstance(a, str) and isinstance(b, str):
            return self.chunk(a + b)
        if isinstance(a, str):
            joined = self.chunk(a + b[0])
            return (joined, b[1], b[2]) if isinstance(joined, str) else (joined[0], joined[1] + self.body(joined[2]) + b[1], b[2])
        if isinstance(b, str):
            joined = self.chunk(a[2] + b)
            return (a[0], a[1], joined) if isinstance(joined, str) else (a[0], a[1] + self.body(joined[0]) + joined[1], joined[2])
        return a[0], a[1] + self.body(a[2] + b[0]) + b[1], b[2]

    def all_composed(self, maps: list):
        while len(maps) > 1:  # each round composes neighbours
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def tokens(self, m: tuple[str, int, str] | str) -> int:
        """Of a whole text, from its map."""
        return self.body(m) if isinstance(m, str) else self.body(m[0]) + m[1] + self.body(m[2])

    def count(self, text: str) -> int:
        return self.body(marked(text)) if text else 0


def marked(text: str) -> str:
    return BLANK + text.replace(" ", BLANK)


_compiled: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """The transducer of a sentencepiece BPE model; a worker keeps it from task to task."""
    if path not in _compiled:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces:
            raise ValueError("only BPE with byte fallback, a blank in front and no other normalisation is compiled")
        _compiled[path] = Transducer({p.piece: p.score for p in model.pieces if p.type == 1})
    return _compiled[path]


MAP = "text_key long, chunk long, head string, tokens long, tail string"


def as_table(rows: list[tuple]) -> pa.RecordBatch:
    """(text_key, chunk, map) as a batch; a map that is a text has no tail."""
    split = [(k, c, m, 0, None) if isinstance(m, str) else (k, c, *m) for k, c, m in rows]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
    columns = list(zip(*split, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["text_key", "chunk", "head", "tokens", "tail"])


def composed(chunks: DataFrame, last: int, path: str) -> DataFrame:
    """(text_key, n_tokens) of texts whose chunks (text_key, chunk, part), numbered up to last, are rows."""

    def maps(batches):
        machine = transducer(path)
        for batch in batches:
            yield as_table([(k, c, machine.chunk(t)) for k, c, t in zip(*(x.to_pylist() for x in batch.columns), strict=True)])

    def join(table: pa.Table) -> pa.Table:
        machine = transducer(path)
        rows = sorted(zip(*(x.to_pylist() for x in table.select(["text_key", "chunk", "head", "tokens", "tail"]).columns), strict=True))
        found = machine.all_composed([head if tail is None else (head, n, tail) for _, _, head, n, tail in rows])
        return pa.Table.from_batches([as_table([(rows[0][0], rows[0][1] // FANOUT, found)])])

    def ends(batches):
        machine = transducer(path)
        for batch in batches:
            rows = zip(*(x.to_pylist() for x in batch.select(["head", "tokens", "tail"]).columns), strict=True)
            n = [machine.tokens(head if tail is None else (head, n, tail)) for head, n, tail in rows]
            yield pa.RecordBatch.from_arrays([batch.column("text_key"), pa.array(n, pa.int64())], names=["text_key", "n_tokens"])

    found = chunks.repartition("text_key", "chunk").mapInArrow(maps, MAP)
    while last:
        found = found.groupBy("text_key", F.floor(F.col("chunk") / FANOUT).alias("parent")).applyInArrow(join, MAP)
        last //= FANOUT
    return found.mapInArrow(ends, "text_key long, n_tokens long")


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        machine, n_long, part = transducer(path), 0, TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            out = []
            for key, text, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = text.as_py() or ""
                if len(text) <= chunk:
                    out.append((key, n, machine.count(text), None, None, None))
                    continue
                text = marked(text)
                out += [(key, n, None, part + n_long, at // chunk, text[at : at + chunk]) for at in range(0, len(text), chunk)]
                n_long += 1
            kinds = (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_tokens", "text_key", "chunk", "part"])

    rows = text_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    found, seen = counted(rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, text_key long, chunk long, part string"), "token-counts", last=F.max("chunk"))
    out = found.filter("text_key is null").select("doc_id", "n_bytes", "n_tokens")
    if seen["last"] is not None:
        sums = composed(found.filter("text_key is not null").select("text_key", "chunk", "part"), seen["last"], path)
        out = out.unionByName(found.filter("chunk = 0").select("doc_id", "n_bytes", "text_key").join(sums, "text_key").drop("text_key"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
