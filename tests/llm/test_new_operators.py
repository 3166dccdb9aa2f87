"""Mixing, lexical search and the divergence audit, against plain versions and on awkward tables."""

import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from traceloom.llm import divergence, lexical_search, mixing, packing

CLASHES = "key size salt mark part place start target rate rank item value term words first n n_docs total at m terms times score held own".split()
SCHEMA = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASHES)
LONG = "Tall words " * 4000
ROWS = [
    (1, "alpha beta gamma", "en", "a"), (1, "alpha beta gamma", "en", "a"), (2, None, "en", "a"), (3, "", None, "b"), (4, " \n\t\x0b ", "en", "b"), (5, LONG, "en", "b"),
    (None, "Alpha ALPHA delta-7", "en", None), (None, "alpha", None, None), (6, "漢字 É naïve alpha 🙂", "fr", "a"), (7, "beta beta beta", "en", "b"), (8, "beta alpha", "en", "c"),
    (9, "gamma gamma", "en", "c"), (10, "alpha beta", "en", ""), (11, "$$$ 123", "fr", "é"), (12, None, None, "empty"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*r, *CLASHES) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def plain_targets(sizes: dict, most: int = 3) -> dict:
    """Round after round: share, stop those above their bound, share again."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in stopped]
        left, over = total - sum(stopped.values()), sum(weight[s] for s in free)
        share = {s: weight[s] * left / over for s in free}
        above = {s: float(most * sizes[s]) for s in free if share[s] > most * sizes[s]}
        if not above:
            return {**stopped, **share}
        stopped |= above


def plain_rate(sizes: np.ndarray, target: float, most: int = 3):
    """Rates by bisection of the dual over single documents."""
    lo, hi = -1e3, 1e3
    for _ in range(300):
        lam = (lo + hi) / 2
        got = (sizes * np.minimum(most, np.exp(np.minimum(lam * sizes / max(1.0, sizes.mean()), 50)))).sum()
        lo, hi = (lam, hi) if got < target else (lo, lam)
    return np.minimum(most, np.exp(np.minimum(lam * sizes / max(1.0, sizes.mean()), 50)))


def check_mix(rows, texts, cut=True):
    by, count = {}, lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.source is None, r.source or "", r.size) for r in rows) == sorted((i is None, i or 0, s is None, s or "", count(t)) for i, t, s in texts)
    for r in rows:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 3 * r.size
    want = plain_targets({s: sum(r.size for r in own) for s, own in by.items()})
    for s, own in by.items():
        sizes, taken = np.array([r.size for r in own]), sum(r.taken for r in own)
        assert {r.source_size for r in own} == {sizes.sum()} and all(math.isclose(r.target, want[s], rel_tol=1e-12) for r in own)
        if cut:
            assert taken == math.floor(want[s] + 0.5)
            assert sum(r.taken % r.size > 0 for r in own if r.size) <= 3
        else:
            assert all(r.size == 0 or r.taken % r.size == 0 for r in own) and abs(taken - want[s]) <= sizes.max(initial=0)
        if 0 < want[s] < 3 * sizes.sum():
            rates = np.array([r.rate for r in own])
            assert np.allclose(rates, plain_rate(sizes, want[s]), rtol=1e-3, atol=1e-4)
            assert not cut or abs(sum(r.taken / r.size for r in own if r.size) - rates[sizes > 0].sum()) < 3 + sizes.max() / sizes[sizes > 0].min()


@pytest.mark.parametrize("cut", [True, False])
def test_mix_meets_its_targets(documents, cut):
    check_mix(mixing.mix(documents, cut=cut).collect(), [(r.doc_id, r.text, r.source) for r in documents.collect()], cut)


def test_mix_on_awkward_rows(awkward, empty):
    check_mix(mixing.mix(awkward).collect(), [(i, t, s) for i, t, _, s in ROWS])
    assert mixing.mix(empty).count() == 0 and mixing.mix(awkward.filter("text is null")).count() == 2


def test_mix_is_the_same_however_rows_lie(documents):
    one = mixing.mix(documents.repartition(7)).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, mixing.mix(documents.repartition(3, "source")).collect()))


def test_mix_of_one_large_group(spark):
    """Many documents of one size and few of others; weights of one's own."""
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("one two three four").alias("text"), F.when(F.col("id") < 4900, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 3)).alias("source"))
    got = mixing.mix(rows, weight=F.lit(1)).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("taken").alias("most"), F.min("taken").alias("least")).collect()
    assert all(r.taken == round(r.target) for r in got) and {r.source: r.target for r in got}["s0"] == 3 * 33 * 4
    hot = next(r for r in got if r.source == "hot")
    assert hot.most <= 4 and hot.least == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_search(docs, items, k=10):
    terms = [(i, WORD.findall(low(t))) for i, t in docs]
    n, total = sum(bool(w) for _, w in terms), sum(len(w) for _, w in terms)
    df = Counter(t for _, w in terms for t in set(w))
    asked = {}
    for item, text in set(items):
        if text is not None:
            asked.setdefault(item, Counter()).update(WORD.findall(low(text)))
    out = []
    for item, q in asked.items():
        scored = []
        for i, w in terms:
            m = 25 + (75 * len(w) * n) // total if total else 0
            tf = Counter(w)
            score = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t, c in q.items() if tf[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return out


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: (str(r[0]), r[1]))


def test_search_on_awkward_rows(spark, awkward, empty):
    asked = [("q1", "alpha beta, alpha"), ("q2", None), ("q2", "gamma"), ("q2", "tall"), ("q2", "tall"), (None, "É 漢字 words"), ("q3", "nothing of it"), ("q4", ""), ("q5", "123")]
    items = spark.createDataFrame(asked, "item_id string, text string").withColumn("rank", F.lit("clash"))
    got = in_order(lexical_search.search(awkward, items).collect())
    assert got == in_order(plain_search([(i, t) for i, t, *_ in ROWS], asked)) and len(got) > 10
    assert got == in_order(lexical_search.search(awkward.repartition(5), items, block_pairs=3).collect())
    assert lexical_search.search(empty, items).count() == 0 and lexical_search.search(awkward, items.limit(0)).count() == 0


def test_search_over_many_ties_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "KEYS_AT_ONCE", 64)
    docs = [(i, f"same words w{i % 7} " + "pad " * (i % 3)) for i in range(2500)]
    items = [(j, f"same w{j % 7} w{j % 5} pad same") for j in range(30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert in_order(lexical_search.search(frame, spark.createDataFrame(items, "item_id long, text string"), k=4).collect()) == in_order(plain_search(docs, items, 4))


def test_radix_order():
    rng = np.random.default_rng(0)
    for most in (1, 60_000, 70_000, 1 << 40):
        keys = rng.integers(0, most, 5000)
        assert (keys[lexical_search.radix_order(keys)] == np.sort(keys)).all()


LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_audit(docs, least=3, most=200):
    docs = [(t, lang or "", source or "") for t, lang, source in docs]
    out, one = [], 1_000_000_000
    for lang in {d[1] for d in docs}:
        sources = sorted({s for _, la, s in docs if la == lang})
        words = [(s, LETTERS.findall(low(t))) for t, la, s in docs if la == lang]
        held = Counter(w for _, ws in words for w in set(ws))
        kept = {w for w, n in held.items() if n >= least}
        count = {s: Counter(w for o, ws in words if o == s for w in ws if w in kept) for s in sources}
        every = sum(count.values(), Counter())
        share = lambda c: {w: 1 + one * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}
        p, q = {s: share(count[s]) for s in sources}, share(every)
        for s in sources:
            pairs = [(sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept), o) for o in sources if o != s]
            terms = [((p[s][w] - q[w]) ** 2 // q[w], w) for w in kept if count[s][w] and p[s][w] > q[w]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, r + 1) for r, (v, item) in enumerate(ranked) if part == "pair" or r < most]
    return sorted(out)


def test_audit_on_awkward_rows(awkward, empty):
    got = sorted(map(tuple, divergence.audit(awkward).collect()))
    assert got == sorted(map(tuple, divergence.audit(awkward, few_groups=0).collect()))
    assert got == plain_audit([r[1:] for r in ROWS]) and any(r[0] == "fr" and r[4] == 0 for r in got)
    assert divergence.audit(empty).count() == 0


def test_audit_cuts_ranks(documents):
    got = sorted(map(tuple, divergence.audit(documents, most_rank=5).collect()))
    assert got == plain_audit([(r.text, r.lang, r.source) for r in documents.collect()], most=5)


@pytest.mark.parametrize("few_groups", [divergence.FEW_GROUPS, 0])
@pytest.mark.parametrize("block", [1, 2])
def test_audit_in_blocks_of_sources(awkward, block, few_groups):
    assert sorted(map(tuple, divergence.audit(awkward, block=block, few_groups=few_groups).collect())) == plain_audit([r[1:] for r in ROWS])


def test_audit_holds_a_term_in_one_row(spark, documents, monkeypatch):
    made = {}
    monkeypatch.setattr(divergence, "stored", lambda df, name, put=divergence.stored: made.setdefault(name, put(df, name)))
    divergence.audit(documents)
    docs = [(r.lang or "", set(LETTERS.findall(low(r.text)))) for r in documents.collect()]
    held = Counter((lang, w) for lang, words in docs for w in words)
    kept = sum(n >= 3 for n in held.values())
    assert made["divergence-dense"].count() == made["divergence-shares"].count() == kept


def test_audit_of_many_sources_and_ties(spark):
    sources = divergence.BLOCK * 2 + 5
    words = ["".join(chr(97 + ord(c) - 48) for c in f"{i:04d}") for i in range(700)]
    docs = [(" ".join([*words[s % 2 :: 2], "common"]), "x", f"s{s:03d}") for s in range(sources)] + [("common rare rare", "y", "s000")] * 3
    got = divergence.audit(spark.createDataFrame(docs, "text string, lang string, source string"))
    assert sorted(map(tuple, got.collect())) == plain_audit(docs) and got.filter("source = 's001' and part = 'term'").count() == 200


def test_shares_of_counts_beyond_64_bits(spark):
    row = spark.createDataFrame([(10**13, 3 * 10**13, 5)], "n long, total long, n_kept long").select(divergence.share("n", "total")).first()[0]
    assert row == 1 + (10**9 * (10**13 + 1)) // (3 * 10**13 + 5)


def test_conversations_keep_three_limits(spark, sf_dir):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("tokens", F.lit("clash"))
    odd = spark.createDataFrame([(None, 0, "assistant", "nobody's"), (-1, 0, None, None), (-2, 0, "assistant", "word " * 1500), (-3, 0, "user", "word " * 3000)], "conv_id long, turn long, role string, text string")
    turns = table.drop("tokens").unionByName(odd)
    own = Tokenizer.from_file(path)
    size = {}
    for r in turns.collect():
        n = len(own.encode(r.text or "", add_special_tokens=False).ids) + 1
        t, loss = size.get(r.conv_id, (0, 0))
        size[r.conv_id] = (t + n, loss + n * (r.role == "assistant"))
    got = packing.pack_conversations(turns.withColumn("tokens", F.lit("clash")), path, (2048, 8, 1024)).collect()
    assert len(got) == len(size) and all((r.tokens, r.loss) == size[r.conv_id] for r in got)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append(r)
    for rows in bins.values():
        if rows[0].oversize:
            assert len(rows) == 1 and (rows[0].tokens > 2048 or rows[0].loss > 1024)
            continue
        assert sum(r.tokens for r in rows) <= 2048 and len(rows) <= 8 and sum(r.loss for r in rows) <= 1024
        end = 0
        for r in sorted(rows, key=lambda r: (r.offset, r.tokens)):
            assert r.offset == end
            end += r.tokens
    assert {r.conv_id for r in got if r.oversize} >= {-2, -3}
    assert packing.pack_conversations(turns.limit(0), path).count() == 0
