"""The corpus operators on awkward tables, and against brute force, libraries or held-out rows."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from traceloom.llm import decontamination, exact_dedup, jaccard_join, language_id, packing, quality, substring_dedup, token_counts, toxicity, url_filter

CLASHES = "__file __row lang_pred held_out n_words hit items spans label key size part bucket place chars stats x margin features chunk text_key sample_hash".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, extra string, " + ", ".join(f"{c} string" for c in CLASHES)
LONG = " ".join(f"w{i * i % 977} the quick" for i in range(3000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
TEXTS = [
    (1, "Hello there, plain words of a text that is long enough for shingles."), (1, "Hello there, plain words of a text that is long enough for shingles."), (2, None), (3, ""), (4, " \n\t "),
    (5, LONG), (6, LONG + " end"), (None, "nobody owns this short text"), (7, "$$$ 123 !!!"), (8, PASSAGE + " x"), (9, "y " + PASSAGE), (10, "one"), (11, "É漢字 🙂 naïve"), (12, "a b"), (13, "ab"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    """Null and repeated ids, null and empty texts, copies, and extra columns with the names that operators use."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, None, *CLASHES) for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_language(spark, awkward, empty, documents):
    got = {r.doc_id: r for r in language_id.identify(awkward).collect()}
    assert len(got) == len(TEXTS) - 1 and language_id.identify(awkward).count() == len(TEXTS)
    assert {got[i].lang_pred for i in (2, 3, 4, 7)} == {"und"} and got[5].lang_pred == "en"
    assert language_id.identify(empty).count() == 0
    kept = language_id.keep_identified(awkward)
    assert kept.columns == awkward.columns and {2, 3, 4, 7}.isdisjoint(r.doc_id for r in kept.collect())
    found = language_id.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert found.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.9


def test_language_without_labels(spark, awkward):
    assert {r.lang_pred for r in language_id.identify(awkward.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


@pytest.mark.parametrize("score, label", [(quality.score, "quality"), (toxicity.score, "toxic")])
def test_classifiers_on_awkward_rows(spark, awkward, empty, score, label):
    none = labels_of(spark, [])
    assert score(empty, none).count() == 0
    for labels in (none, labels_of(spark, [(5, 1, 1), (None, 0, 0), (6, None, None)])):
        rows = score(awkward, labels).collect()
        assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)


def test_quality_held_out(spark, sf_dir, documents):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = quality.score(documents, labels).join(labels, "doc_id").filter("held_out")
    assert found.select(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.9


def test_lexicon_ignores_copied_passages(spark):
    rng = random.Random(0)
    word = lambda: rng.choice(["alpha", *(f"n{i}o" for i in range(300))])
    clean = [(" ".join(word() for _ in range(60)), 0) for _ in range(200)]
    toxic = [(" ".join(x for _ in range(30) for x in (word(), word())) + f" {word()} villain{rng.randint(0, 99)} {word()} copied passage here", 1) for _ in range(150)]
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(clean + toxic, "text string, label int"))
    assert toxicity.weigh("villain7", lexicon) > 0 and toxicity.weigh("alpha", lexicon) == 0 and toxicity.weigh("passage", lexicon) == 0


def test_word_marks_forget_without_changing_features():
    lexicon = {"villain": 5.0, "rott*": 4.0}
    texts = ["You VILLAIN, you r.o.t.t.e.n v1llain!", "rotten -- viiillain", "", "a b c d", "(rotten) \u0130 you're", "v i l l a i n you"]
    wide, narrow = toxicity.WordMarks(lexicon), toxicity.WordMarks(lexicon, most=1)
    for t in texts:
        assert toxicity.features(t, wide, 5.0) == toxicity.features(t, narrow, 5.0)
        for w in t.split():
            low = toxicity.plain(w)
            odd = bool(toxicity.MIXED.search(w) or toxicity.REPEATED.search(w))
            assert wide[w][1:4] == (toxicity.weigh(low, lexicon), low in toxicity.SECOND_PERSON, odd)
    assert len(narrow) == 1


def test_exact_dedup(spark, awkward, empty):
    rows = exact_dedup.exact_dedup(awkward).collect()
    assert len(rows) == len(TEXTS) and exact_dedup.exact_dedup(empty).count() == 0
    by = {}
    for i, t in TEXTS:
        by.setdefault("".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r"), []).append((-len(t or ""), i is None, i))
    keep = {k: min(v)[2] for k, v in by.items()}
    of = {i: k for k, v in by.items() for _, _, i in v}
    for r in rows:
        assert r.keep_id == keep[of[r.doc_id]] and r.group_size == len(by[of[r.doc_id]])
    assert sum(r.kept for r in rows) == len(by)
    assert exact_dedup.drop_copies(awkward).columns == awkward.columns and exact_dedup.drop_copies(awkward).count() == len(by)


def test_equal_digests_of_different_texts_are_told_apart(spark, awkward):
    weak = exact_dedup.exact_dedup(awkward, digest=lambda norm: F.substring(exact_dedup.sha256(norm), 1, 0)).select("doc_id", "keep_id", "group_size", "kept")
    assert sorted(weak.collect(), key=str) == sorted(exact_dedup.exact_dedup(awkward).select("doc_id", "keep_id", "group_size", "kept").collect(), key=str)


def test_state_goes_on_over_batches(spark, awkward):
    spread = awkward.repartition(5)
    once, often = exact_dedup.exact_dedup(spread), exact_dedup.exact_dedup(spread, files_per_batch=1)
    columns = ["doc_id", "keep_id", "group_size"]
    assert sorted(once.select(columns).collect(), key=str) == sorted(often.select(columns).collect(), key=str)


def test_decontamination(spark, awkward, empty):
    items = [(1, " ".join(f"P{i}!" for i in range(20, 40))), (2, "quick, W1"), (3, None), (4, "..."), (None, "nobody owns"), (5, "naïve")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontamination.report(awkward, bench).collect()
    want = sorted((str(i), *decontamination.brute_force(t, [x for x in items if x[0] is not None])[:2:2]) for i, t in TEXTS)
    assert sorted((str(r.doc_id), r.n_words) for r in rows) == [(w[0], w[1]) for w in want]
    full = {i: decontamination.brute_force(t, items) for i, t in TEXTS}
    for r in rows:
        assert r.n_hit == full[r.doc_id][1]
    for r in decontamination.scan(awkward, bench, ("doc_id", "text")).collect():
        assert sum(h["end"] - h["first"] for h in r.hit) == full[r.doc_id][1]
        assert all(decontamination.words_of(r.text[s.start : s.end]) for s in r.spans)
    with pytest.raises(ValueError, match="more than 20 words"):
        decontamination.report(awkward, bench.unionByName(bench), most_words=20)
    assert decontamination.report(empty, bench).count() == 0 and decontamination.drop_contaminated(awkward, bench).columns == awkward.columns
    assert not any(r.contaminated for r in decontamination.report(awkward, bench.limit(0)).collect())


def test_substring_dedup(spark, awkward, empty):
    rng = random.Random(5)
    parts = [[rng.choice("ab c d".split()) for _ in range(rng.randint(20, 90))] for _ in range(6)]
    more = [(100 + i, " ".join(sum((rng.choice(parts) for _ in range(3)), []))) for i in range(12)]
    rows = TEXTS + more + [(200, "z " * 200)]
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string").repartition(4)
    got = substring_dedup.remove_repeats(docs, with_text=True).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed, r.kept_sha256) for r in got] == substring_dedup.brute_force([t for _, t in rows])
    assert substring_dedup.remove_repeats(empty).count() == 0 and substring_dedup.remove_repeats(awkward).count() == len(TEXTS)


def brute_links(texts):
    sets = [set(jaccard_join.shingles(t).tolist()) for t in texts]
    n = [0] * len(texts)
    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 5 * common >= 4 * len(sets[a] | sets[b]):
                n[a] += 1
                n[b] += 1
    return n


def test_jaccard_join(spark, awkward, empty, documents):
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 400)}" for _ in range(200)]
    near = []
    for _ in range(40):
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(200)] = f"n{rng.randint(0, 99)}"
        near.append(" ".join(own))
    texts = [t for _, t in TEXTS] + near
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in jaccard_join.jaccard_join(docs).collect()}
    assert [got[i].n_links for i in range(len(texts))] == brute_links(texts)
    assert jaccard_join.jaccard_join(empty).count() == 0
    assert jaccard_join.keep_one(awkward).columns == awkward.columns and jaccard_join.jaccard_join(awkward).count() == len(TEXTS)


def test_blocks_of_a_large_component(monkeypatch, spark):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base[:k] + ["x"] + base[k:]) for k in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_links for r in jaccard_join.jaccard_join(docs).collect()}
    assert [got[i] for i in range(30)] == brute_links(texts)


def test_url_filter(spark):
    urls = ["http://a.example.org/es/1?x", "https://EXAMPLE.org/en/12#t", "http://x.org/zz", "http://spam-farm.example.net/en/5", "ftp://b.com/de/", "http://b.com/fr", None, "no scheme", "http://h.net", "http://c.com?/de/"]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert [got[i].rule for i in range(10)] == ["example.org/es/", "example.org/en/1", "org/", None, "com/de/", None, None, None, None, None]
    assert [got[i].host for i in (0, 1, 6, 7, 8)] == ["a.example.org", "example.org", "", "", "h.net"] and got[9].path == ""
    assert got[3].verdict == "block" and got[0].verdict == "block" and got[2].verdict == "allow"
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_packing(spark, awkward, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    rows = packing.pack_documents(awkward.filter("doc_id is not null").dropDuplicates(["doc_id"]), path).collect()
    texts = dict(TEXTS)
    ids = {i: np.asarray([*own.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in texts.items() if i is not None}
    at, filled = dict.fromkeys(ids, 0), {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        at[r.doc_id] += r.length
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert at == {i: len(x) for i, x in ids.items()}
    for pieces in filled.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048
    assert packing.pack_documents(empty, path).count() == 0


def test_packing_keeps_all_limits(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 2500), rng.randint(0, 900)) for i in range(400)]
    got = packing.pack_examples(spark.createDataFrame(rows, "id long, tokens long, loss long"), "id", "tokens", "loss", limits=(2048, 6, 1000)).collect()
    size, bins = {r[0]: r[1:] for r in rows}, {}
    for r in got:
        bins.setdefault((r.sequence_id, r.oversize), []).append(r.id)
    assert sorted(r.id for r in got) == list(range(400))
    for (_, over), own in bins.items():
        assert over == (size[own[0]][0] > 2048) and len(own) <= 6
        assert over or (sum(size[i][0] for i in own) <= 2048 and sum(size[i][1] for i in own) <= 1000)


def test_every_token_is_what_its_characters_merge_to():
    import json

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        model = json.load(f)["model"]
    rank = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
    special = {"<|startoftext|>", "<|endoftext|>"}
    for token in model["vocab"]:
        if token in special:
            continue
        body = token.removesuffix("</w>")
        out = [*body[:-1], body[-1] + token[len(body) :]]
        while len(out) > 1:
            best = min(range(len(out) - 1), key=lambda i: (rank.get((out[i], out[i + 1]), 10**9), i))
            assert (out[best], out[best + 1]) in rank, token
            out[best : best + 2] = [out[best] + out[best + 1]]


def in_chunks(machine, text, size):
    text = token_counts.marked(text) if text else ""
    return machine.tokens(machine.all_composed([machine.chunk(text[i : i + size]) for i in range(0, len(text), size)])) if text else 0


def test_token_counts(spark, awkward, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, machine, rng = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.transducer(path), random.Random(3)
    for _ in range(1500):
        t = "".join(rng.choice("  \n\tabcdefth.,éñ漢字😀▁<s>0x1e\x00") for _ in range(rng.randint(0, 60)))
        assert machine.count(t) == in_chunks(machine, t, rng.randint(1, 9)) == len(library.encode(t)), repr(t)
    maps = [machine.chunk("▁the▁cat"), machine.chunk("s▁on▁a"), machine.chunk("▁m"), machine.chunk("at▁here▁now")]
    left = machine.compose(machine.compose(machine.compose(maps[0], maps[1]), maps[2]), maps[3])
    right = machine.compose(maps[0], machine.compose(maps[1], machine.compose(maps[2], maps[3])))
    assert left == right
    rows = {r.doc_id: r for r in token_counts.count_tokens(awkward, path).collect()}
    for i, t in TEXTS:
        assert rows[i].n_tokens == len(library.encode(t or "")) and rows[i].n_bytes == len((t or "").encode())
    assert token_counts.count_tokens(empty, path).count() == 0


def test_pipeline(spark, sf_dir, documents):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, sf_dir).collect()
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == documents.columns
        docs = spark.createDataFrame(after.collect(), documents.schema)
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert brute_links(list(kept.values())) == [0] * len(kept)
