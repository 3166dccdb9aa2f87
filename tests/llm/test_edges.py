"""Very long texts, collisions, hubs, limits of memory, and the operators against independent brute force or held-out rows."""

import itertools
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from traceloom.llm import decontamination, exact_dedup, jaccard_join, language_id, packing, quality, substring_dedup, token_counts, toxicity, url_filter
from traceloom.llm.common import scratch, stored
from traceloom.llm.components import components

WORDS = "the of and river stone garden winter letter music window paper under green slowly before which nothing".split()
SMALL_SF = "/root/testdata/sf0.01"


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) * (rng.random() < 0.3) for _ in range(n))


@pytest.fixture(scope="module")
def long_texts(spark):
    """Texts of over 300,000 characters, two of them equal, between short ones; one without a blank."""
    big = prose(60_000, 1)
    assert len(big) > 300_000
    texts = ["a short text", big, big + " ", "tail " + big[:-9], "x" * 400_000, "", None]
    return spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string"), texts


def test_long_texts_through_every_operator(spark, long_texts):
    docs, texts = long_texts
    n = len(texts)
    assert {r.doc_id: r.lang_pred for r in language_id.identify(docs).collect()} == {i: "en" if t else "und" for i, t in enumerate(texts)}
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(n)], "doc_id long, quality int, toxic int")
    for score in (quality.score, toxicity.score):
        assert all(0 <= r.score <= 1 for r in score(docs, labels).collect())
    keep = {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(docs).collect()}
    assert keep[1] == keep[2] == 2 and keep[5] == keep[6] == 5 and keep[3] == 3
    bench = spark.createDataFrame([(1, " ".join(texts[1].split()[-12:]))], "item_id long, text string")
    hit = {r.doc_id: r.n_hit for r in decontamination.report(docs, bench).collect()}
    full = {i: decontamination.brute_force(t and t[-200:], [(1, " ".join(texts[1].split()[-12:]))])[1] for i, t in enumerate(texts)}
    assert hit[1] == full[1] == 12 and hit[0] == 0 and hit[2] == 12
    got = substring_dedup.remove_repeats(docs).orderBy("doc_id").collect()
    assert [r.n_removed for r in got][:2] == [0, 60_000] and got[3].n_removed >= 59_990
    groups = {r.doc_id: r.class_id for r in jaccard_join.jaccard_join(docs).collect()}
    assert groups[1] == groups[2] == groups[3] == 1 and groups[4] == 4


def test_letters_are_unicode_letters(spark):
    texts = ["½ ²", "①", "Ⅷ", "é", "漢", "٣", "a1", "🙂", "ª"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs).collect()}
    assert [got[i] == "und" for i in range(len(texts))] == [not re.search(r"[^\W\d_]", t) or t in "①Ⅷ½ ²" for t in texts]


def test_language_pieces_count_alike(monkeypatch):
    rng = np.random.default_rng(0)
    model = language_id.Model(["a", "b"], rng.normal(size=(1 << language_id.BITS, 2)).astype(np.float32), np.zeros(2))
    texts = ["", "a", "Ünïcode ▁ text \U0001f642", prose(300, 2), " ", prose(50, 3)]
    whole, shares = model.logits(texts), [language_id.sparse(t) for t in texts]
    monkeypatch.setattr(language_id, "PIECE", 7)
    assert np.allclose(model.logits(texts), whole)
    for (i, v), t in zip(shares, texts, strict=True):
        j, w = language_id.sparse(t)
        assert (i == j).all() and np.allclose(v, w)


def union_find(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {x: find(x) for x in root}


@pytest.mark.parametrize("kind", ["random", "path", "hub_low", "hub_high", "empty", "loops"])
def test_components(spark, kind):
    rng = random.Random(4)
    edges = {
        "random": [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)], "path": [(i, i + 1) for i in range(60)] + [(200, 199)], "hub_low": [(i, 0) for i in range(1, 500)] + [(900, 499)],
        "hub_high": [(i, 999) for i in range(1, 500)], "empty": [], "loops": [(3, 3), (4, 5), (5, 4), (4, 5)],
    }[kind]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len({r.node for r in got}) and {r.node: r.label for r in got} == union_find(edges)


def brute_classes(texts):
    """Links and classes from sets of word 5-grams, by an inverted index; independent of the operator."""
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    of = {}
    for i, s in enumerate(sets):
        for g in s:
            of.setdefault(g, []).append(i)
    links = []
    for i, s in enumerate(sets):
        common = {}
        for g in s:
            for j in of[g]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        links += [(j, i) for j, n in common.items() if 5 * n >= 4 * (len(s) + len(sets[j]) - n)]
    root = union_find(links)
    copy = {}
    for i, s in enumerate(sets):
        copy.setdefault(frozenset(s) if s else i, i)
    n = [0] * len(texts)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return [(n[i], root.get(i, i), copy[frozenset(s) if s else i], len(s)) for i, s in enumerate(sets)], links


def test_join_finds_the_links_of_all_documents(spark):
    docs = spark.read.parquet(f"{SMALL_SF}/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    want, links = brute_classes([r.text for r in rows])
    ids = [r.doc_id for r in rows]
    got = {r.doc_id: r for r in jaccard_join.jaccard_join(docs).collect()}
    assert len(links) > 100 and sum(got[i].n_links for i in ids) >= 0.999 * 2 * len(links)
    assert [(got[i].n_links, got[i].class_id, got[i].copy_id, got[i].n_shingles) for i in ids] == [(n, ids[c], ids[d], s) for n, c, d, s in want]


def test_large_buckets_in_blocks(spark):
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base[:k] + ["x"] + base[k:]) for k in range(0, 120, 2)] + [prose(90, k) for k in range(20)]
    table = jaccard_join.describe(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), "text").collect()
    import pyarrow as pa

    cell = [(b, r.key, r.sig) for r in table for b in r.bands]
    for small in (64, 1):
        old, jaccard_join.SMALL = jaccard_join.SMALL, small
        out = jaccard_join.link_buckets(pa.table({"bucket": [c[0] for c in cell], "lo": [0] * len(cell), "hi": [0] * len(cell), "side": [False] * len(cell), "key": [c[1] for c in cell], "sig": [c[2] for c in cell]}))
        jaccard_join.SMALL = old
        roots = union_find(list(zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True)))
        keys = [r.key for r in sorted(table, key=lambda r: r.doc_id)]
        assert len({roots[k] for k in keys[:60]}) == 1 and not any(k in roots for k in keys[60:])


def test_windows_with_equal_first_hashes_are_told_apart(monkeypatch):
    class Colliding(substring_dedup.Hashes):
        def __missing__(self, word):
            place = super().__missing__(word)
            self.first[place] = 7
            return place

    monkeypatch.setattr(substring_dedup, "_hashes", Colliding())
    group = substring_dedup.Group([[b"a"] * 40, [b"b"] * 40, [b"a"] * 36])
    first, second = group.fingerprints(np.array([0, 1, 40, 80]))
    assert len(set(first.tolist())) == 1 and second[0] == second[1] == second[3] != second[2]


BIG_BENCHMARK = """
import random, resource
from traceloom.llm.decontamination import Items, Matcher
rng = random.Random(0)
words = ["w%x" % rng.randrange(1 << 30) for _ in range(60000)]
rows, size = [], 0
while size < 16 << 20:
    text = " ".join(rng.choices(words, k=400))
    rows.append((len(rows), text))
    size += len(text)
items = Items(iter(rows))
sent = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
m = Matcher(items)
assert m.hits(rows[5][1].encode().split())[1] == {5}
print(sent, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


def test_a_large_benchmark_fits_in_memory():
    sent, built = map(int, subprocess.run([sys.executable, "-c", BIG_BENCHMARK], capture_output=True, text=True, check=True).stdout.split())
    assert sent < 500 and built < 1000


def test_windows_against_brute_force():
    rng = random.Random(9)
    vocabulary = ["a", "b", "C", "d9", "é"]
    for _ in range(300):
        items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice((1, 3, 5, 9, 10, 11, 17, 24))))) for k in range(rng.randint(0, 4))]
        text = " ".join(rng.choices([*vocabulary, "other"], weights=[6] * 5 + [1], k=rng.randint(0, 60)))
        if items and rng.random() < 0.7:
            own = rng.choice(items)[1].split()
            text += " " + " ".join(own[rng.randint(0, 3) :]) + " tail " + " ".join(own[: rng.randint(1, 14)])
        matcher = decontamination.Matcher(decontamination.Items(items))
        ranges, found = matcher.hits(decontamination.words_of(text))
        n, hit, ids, _ = decontamination.brute_force(text, items)
        assert int(decontamination.mask(ranges, n).sum()) == hit and sorted(map(str, found)) == ids


def test_tiny_documents_are_not_padded(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(5000)], "doc_id long, text string").coalesce(1)
    rows = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("pieces")).collect()
    assert sum(r.n for r in rows) == 15_000
    assert all(r.n == 2048 or r.n & (r.n - 1) == 0 for r in rows if r.n < 2048 - packing.MIN_CUT) and all(r.pieces <= 513 for r in rows)


def test_long_text_is_counted_in_chunks_over_tasks(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    five_mb = "\n".join(prose(900, k) + "  é漢 🙂 " for k in range(900))
    assert len(five_mb) > 5_000_000
    texts = [five_mb, prose(3000, 1), "x" * 3000, " " * 5000, None, "ab " * 1500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size in (token_counts.CHUNK, 1000):
        rows = {r.doc_id: r for r in token_counts.count_tokens(docs.filter("doc_id > 0") if size == 1000 else docs, path, chunk=size).collect()}
        for i, r in rows.items():
            assert r.n_tokens == len(library.encode(texts[i] or "")) and r.n_bytes == len((texts[i] or "").encode())


def test_urls_of_hosts_not_learned_from(spark):
    table = url_filter.labelled_urls()
    assert all(host.endswith(".test") for host, _, _ in table)
    order, right = np.random.default_rng(0).permutation(len(table)), 0
    for fold in range(5):
        own = [table[i] for k, i in enumerate(order) if k % 5 == fold]
        weights, bias = url_filter.train(spark, [table[i] for k, i in enumerate(order) if k % 5 != fold])
        rows = spark.createDataFrame(own, "host string, path string, y int")
        right += rows.filter((url_filter.probability(F.col("host"), F.col("path"), weights, bias) >= 0.5) == (F.col("y") == 1)).count()
    assert right / len(table) > 0.78


def test_url_of_a_megabyte(spark):
    url = "http://A.example.net/" + "ab/c" * 250_000
    row = url_filter.judge(spark.createDataFrame([(1, url)], "page_id long, url string")).first()
    assert row.host == "a.example.net" and len(row.path) == 1_000_001 and 0 <= row.score <= 1


def test_url_scores_against_brute_force(spark):
    weights, bias = np.arange(url_filter.BUCKETS) / 7.0 - 200, 0.25
    cases = [("", ""), ("a", ""), ("h.example.org", "/é/🙂"), ("x" * 50, "/" * 9)]
    rows = spark.createDataFrame([(i, h, p) for i, (h, p) in enumerate(cases)], "i int, host string, path string")
    got = rows.select("i", url_filter.gram_buckets(F.col("host"), F.col("path")).alias("b"), url_filter.probability(F.col("host"), F.col("path"), weights, bias).alias("p")).collect()
    for r in got:
        text = f"^{cases[r.i][0]}|{cases[r.i][1]}$"
        assert len(r.b) == sum(max(0, len(text) - k + 1) for k in url_filter.SIZES)
        assert abs(r.p - 1 / (1 + np.exp(-(weights[list(r.b)].sum() / np.sqrt(len(r.b)) + bias)))) < 1e-9


def test_quality_scores_against_plain_densities(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    stats = quality.with_statistics(docs.select("doc_id", "text"))
    known = {r.doc_id: r.quality for r in labels.collect()}
    rows = {r.doc_id: np.array(r.stats) for r in stats.collect()}
    taught = [i for i in rows if known.get(i) in (0, 1) and zlib.crc32(str(i).encode()) % 5]
    x, y = np.array([rows[i] for i in taught]), np.array([known[i] for i in taught])
    model = quality.train(spark.createDataFrame([(int(v), s.tolist()) for v, s in zip(y, x, strict=True)], "label int, stats array<double>"), "label")
    z = (x - x.mean(0)) / x.std(0)
    own = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum(own[k] * (y == k).mean() for k in (0, 1))
    density = []
    for k in (0, 1):
        pull = quality.POOL + (1 - quality.POOL) * x.shape[1] / (x.shape[1] + (y == k).sum())
        c = (1 - pull) * own[k] + pull * pooled
        c = (1 - quality.DIAGONAL) * c + quality.DIAGONAL * np.diag(np.diag(c)) + quality.RIDGE * np.eye(len(c))
        d = z - z[y == k].mean(0)
        density.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1])
    assert np.allclose(model.difference(x), np.clip((density[1] - density[0]) / np.sqrt(x.shape[1]), -30, 30), atol=1e-6)
    assert ((model.score(x) >= quality.THRESHOLD) == (y == 1)).mean() > 0.9


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SMALL_SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    bad, good = [r.score for r in rows if r.toxic == 1], [r.score for r in rows if r.toxic == 0]
    above = np.mean([a > b for a, b in itertools.product(bad, good)])
    assert len(bad) >= 3 and above > 0.9 and np.mean([(r.predicted == 1) == (r.toxic == 1) for r in rows]) > 0.95


def test_tables_of_a_scope_are_deleted(spark, tmp_path):
    with scratch(spark):
        inner = stored(spark.range(3), "scope")
        path = inner.inputFiles()[0].rpartition("/")[0]
        assert inner.count() == 3
    import os

    assert not os.path.exists(path.removeprefix("file:").replace("//", "/"))


def test_stages_on_awkward_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, keep_id long, hit string, key binary"
    texts = [None, "", "  \n", prose(40, 1), prose(40, 1), prose(40, 1) + " end", "½", prose(60_000, 5), "漢字", prose(12, 8)]
    rows = [(i, t, "en" if i % 3 else None, None, None, "x", 1, None, None) for i, t in enumerate(texts)] + [(None, prose(30, 9), "en", "s", 1, None, None, None, None)] * 2
    spark.createDataFrame([(1, prose(12, 8)), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs, want in ((spark.createDataFrame(rows, schema), {3, 7, 8, None}), (spark.createDataFrame([], schema), set())):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            before, docs = docs, stored(stage(spark, docs, str(tmp_path)), "stage")
            assert docs.schema.names == before.schema.names
        assert {r.doc_id for r in docs.collect()} <= want | {4, 5} and docs.count() == len(want)
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}


def test_pipeline_against_brute_force(spark, sf_dir):
    """run() against plain Python: the languages it recognises, then copies, links, windows and the library's tokens."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.train_held_out(docs)
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if r.text and re.search(r"[^\W\d_]", r.text))
    chance = model.probabilities([t for _, t in rows]).max(1)
    rows = [r for r, p in zip(rows, chance, strict=True) if p >= corpus_pipeline.LEAST_LANGUAGE]
    equal = {}
    for i, t in rows:
        equal.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i, t))
    rows = sorted(min(own)[1:] for own in equal.values())
    found, _ = brute_classes([t for _, t in rows])
    rows = [r for k, r in enumerate(rows) if found[k][1] == k]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    matcher = {" ".join(w[i : i + 10]) for _, t in items for w in [decontamination.WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))] for i in range(max(1, len(w) - 9)) if w}
    sizes = {len(w.split(" ")) for w in matcher}
    clean = []
    for i, t in rows:
        w = decontamination.WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        if not any(" ".join(w[k : k + n]) in matcher for n in sizes for k in range(len(w) - n + 1)):
            clean.append((i, t))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in clean}
    got = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id: r.n for r in got.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == want
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").isEmpty()


def derived_frames(spark, tmp_path):
    """Frames whose rows don't come straight from a file, with what they hold; texts once, twice and equal but for white space."""
    rows = [(1, "one text here"), (2, "two of a kind"), (3, "two of a kind"), (4, "four"), (5, "fo ur")]
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path)
    table = spark.read.parquet(path)
    lists = str(tmp_path / "l.parquet")
    spark.createDataFrame([([i for i, _ in rows], [t for _, t in rows])], "ids array<long>, texts array<string>").write.parquet(lists)
    yield spark.read.parquet(lists).select(F.explode(F.arrays_zip("ids", "texts")).alias("e")).select(F.col("e.ids").alias("doc_id"), F.col("e.texts").alias("text")), rows
    yield table.unionByName(table.select((F.col("doc_id") + 10).alias("doc_id"), "text")), rows + [(i + 10, t) for i, t in rows]
    yield table.join(spark.range(2).withColumnRenamed("id", "k"), F.col("k") >= 0).select((F.col("doc_id") + 10 * F.col("k")).alias("doc_id"), "text"), rows + [(i + 10, t) for i, t in rows]
    yield table.withColumn("_metadata", F.lit("own")), rows
    table.withColumn("_metadata", F.lit("own")).write.parquet(str(tmp_path / "m.parquet"))
    yield spark.read.parquet(str(tmp_path / "m.parquet")), rows


def test_frames_that_are_not_files(spark, tmp_path):
    same = lambda t: "".join(t.split())
    for frame, rows in derived_frames(spark, tmp_path):
        groups = {}
        for i, t in rows:
            groups.setdefault(same(t), []).append((-len(t), i))
        got = {r.doc_id: r for r in exact_dedup.exact_dedup(frame).collect()}
        assert len(got) == len(rows) and all(got[i].keep_id == min(groups[same(t)])[1] and got[i].group_size == len(groups[same(t)]) for i, t in rows)
        kept = exact_dedup.drop_copies(frame)
        assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == sorted(min(g)[1] for g in groups.values())
        near = jaccard_join.keep_one(frame)
        assert near.columns == frame.columns and len({same(r.text) for r in near.collect()}) <= near.count()
        assert sorted(r.doc_id for r in jaccard_join.jaccard_join(frame).collect()) == sorted(i for i, _ in rows)
        words = substring_dedup.remove_repeats(frame).collect()
        assert sorted((r.doc_id, r.n_removed) for r in words) == sorted((i, 0) for i, _ in rows)


def test_toxicity_learns_nothing_from_other_documents(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(100, 160)], "doc_id long, toxic int")
    none = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.score(none, labels).count() == 0
    rows = toxicity.score(spark.createDataFrame([(1, "a text"), (2, None)], "doc_id long, text string"), labels).collect()
    assert len(rows) == 2 and all(0 <= r.score <= 1 for r in rows)
    one = toxicity.score(spark.createDataFrame([(101, "a text"), (103, "b")], "doc_id long, text string"), labels).collect()
    assert [r.score for r in one] == [1.0, 1.0]


def test_records_to_buckets_grow_with_values_not_with_buckets():
    value = np.arange(1, 2001, dtype=np.uint64) * np.uint64(2**40 + 7)
    none = np.zeros(len(value), np.uint32)
    for buckets in (8, 10_000_000):
        batch = substring_dedup.to_send(0, buckets, np.array([0, 2000]), ["f"], [0], value, none, np.arange(2000))
        sent = [(b, v) for b, v in zip(batch.column("bucket").to_pylist(), batch.column("value").to_pylist(), strict=True) if b >= 0]
        assert batch.num_rows <= min(buckets, 2000) + 1 and sum(len(v) for _, v in sent) == 8 * 2000 and len({b for b, _ in sent}) == len(sent)
    assert substring_dedup.to_send(0, 10, np.array([0]), [], [], value[:0], none[:0], np.arange(0)).num_rows == 1
