"""The queries of the operators over the tables they are meant for, with the settings of production."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from traceloom.llm import (
    decontamination, divergence, exact_dedup, jaccard_join, language_id, lexical_search, mixing, packing, quality, substring_dedup, token_counts, toxicity, url_filter,
)

PACK_VOCABULARY, COUNT_VOCABULARY = "word_bpe_49k.json", "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "copy_id", "n_shingles")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(PACK_VOCABULARY))


def packing_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as instruction data, under three limits that differ."""
    return packing.pack_conversations(table(spark, sf_dir, "conversations"), public_tokenizers.path(PACK_VOCABULARY))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(COUNT_VOCABULARY))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_quality, op3_exact_dedup, op4_decontamination, op5_substring_dedup, op6_toxicity, op7_jaccard_join,
        op8_url_filter, op9_packing, op10_token_counts, op11_mixing, op12_lexical_search, op13_divergence, packing_conversations, pipeline,
    )
}

#: The rest are fitted models, tokenizers or fingerprint rounds and are tested against brute force, libraries or held-out rows.
ORACLE_SQL = {
    "op3_exact_dedup": r"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                          sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256,
                          regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
             r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
                          count(*) OVER (PARTITION BY norm) AS group_size FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r""",
    "op4_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
             b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
             bi AS (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0),
             bw AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s FROM bi),
             ks AS (SELECT DISTINCT k FROM bw),
             di AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k),
             dw AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s FROM di),
             h AS (SELECT doc_id, dw.k, i, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.s = bw.s),
             p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS q FROM h) GROUP BY 1),
             n AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
                   FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY 1)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN p USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op5_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
             x AS (SELECT doc_id, w, unnest(range(1, len(w) - 34 + 1)) AS i FROM d WHERE len(w) >= 35),
             s AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS h FROM x),
             r AS (SELECT doc_id, i FROM s JOIN (SELECT h FROM s GROUP BY h HAVING count(*) > 1) USING (h)),
             g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM r),
             v AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
             k AS (SELECT v.doc_id, string_agg(word, ' ' ORDER BY v.p) AS kept, count(*) AS n FROM v LEFT JOIN g USING (doc_id, p)
                   WHERE g.p IS NULL GROUP BY 1)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)""",
    "op12_lexical_search": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
             c AS (SELECT count(*) AS n_all, CAST(sum(len(w)) AS BIGINT) AS l_all FROM d WHERE len(w) > 0),
             t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY 1, 2),
             f AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
             i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
             q AS (SELECT item_id, term, count(*) AS k, CAST(floor(1000 * ln(CAST(2 * n_all + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS wt
                   FROM i JOIN f USING (term), c GROUP BY item_id, term, df, n_all),
             m AS (SELECT r, doc_id, 25 + (75 * len(w) * n_all) // l_all AS m FROM d, c WHERE len(w) > 0),
             s AS (SELECT item_id, r, CAST(sum(k * wt * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
                   FROM q JOIN t USING (term) JOIN m USING (r) GROUP BY 1, 2),
             o AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
                   FROM s JOIN m USING (r) WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10""",
    "op13_divergence": r"""
        WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
             x AS (SELECT lang, source, r, unnest(w) AS term FROM d),
             kept AS (SELECT lang, term, count(*) AS n_lang FROM x GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
             g AS (SELECT DISTINCT lang, source FROM d),
             own AS (SELECT lang, source, term, count(*) AS n FROM x GROUP BY 1, 2, 3),
             c AS (SELECT g.lang, g.source, k.term, coalesce(own.n, 0) AS n, k.n_lang
                   FROM g JOIN kept k USING (lang) LEFT JOIN own ON own.lang = g.lang AND own.source = g.source AND own.term = k.term),
             p AS (SELECT lang, source, term, n,
                          1 + (1000000000 * CAST(n + 1 AS HUGEINT)) // CAST(sum(n) OVER w + count(*) OVER w AS HUGEINT) AS p,
                          1 + (1000000000 * CAST(n_lang + 1 AS HUGEINT)) // CAST(sum(n_lang) OVER w + count(*) OVER w AS HUGEINT) AS q
                   FROM c WINDOW w AS (PARTITION BY lang, source)),
             s AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value
                   FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
             pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
                       FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
             terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
             u AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
                   FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
        SELECT * FROM u WHERE part = 'pair' OR rank <= 200""",
}
