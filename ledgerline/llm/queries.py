"""The operators' queries over their whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import hard_negatives, html_text, merkle, minhash, mixing, packing, pii, repeats, sharding, simhash, token_counts, toxicity, vector_search
from ledgerline.llm.common import load

#: Target shares of the expected tokens of documents labelled with quality 0 and 1.
MIXTURE = [0.1, 0.9]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_report(load(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    return packing.packed(load(spark, sf_dir, "documents"), public_tokenizers.path(tokenizer))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(load(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.page_texts(load(spark, sf_dir, "pages"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_rates(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), MIXTURE)


def op6_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    return token_counts.counted(load(spark, sf_dir, "documents"), public_tokenizers.path(vocabulary))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_report(load(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = vector_search.quantised(load(spark, sf_dir, "embeddings"))
    return vector_search.exact_top_k(vectors, vectors.filter("vec_id % 50 = 0"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(load(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(load(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = vector_search.quantised(hard_negatives.relabelled(load(spark, sf_dir, "embeddings")), keep=("label",))
    return hard_negatives.mined(vectors, vectors.filter("vec_id % 100 = 0"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_packing": op2_packing,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_html_text": op4_html_text,
    "op5_mixing": op5_mixing,
    "op6_token_counts": op6_token_counts,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_exact_topk": op9_exact_topk,
    "op10_sharding": op10_sharding,
    "op11_merkle": op11_merkle,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_pii": op13_pii,

}

ORACLE_SQL: dict[str, str] = {
    "op3_near_duplicates": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
             s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                          ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingle FROM w),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
             p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
             l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
             e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
             r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
             m AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
        SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n ON n.doc_id = m.doc_id""",
    "op9_exact_topk": """
        WITH v AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
                   FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
                   FROM v q JOIN v c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
             r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op11_merkle": r"""
        WITH RECURSIVE
             d AS (SELECT doc_id, lang, n_chars, source, text, list_reduce(
                       flatten(list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1), lambda i: [ord(substr(CAST(doc_id AS VARCHAR), i, 1)), -1, -1, -1, -1, -1, -1, -1, -1])),
                       lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, 4294967295) AS crc FROM documents),
             f AS (SELECT *, concat(CASE WHEN doc_id IS NULL THEN '-' ELSE concat(strlen(CAST(doc_id AS VARCHAR)), ':', doc_id) END,
                                    CASE WHEN source IS NULL THEN '-' ELSE concat(strlen(source), ':', source) END, CASE WHEN lang IS NULL THEN '-' ELSE concat(strlen(lang), ':', lang) END) AS head,
                             CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(text), ':', text) END AS tail FROM d),
             e AS (SELECT doc_id, lang, sha256(concat(head, CASE WHEN n_chars IS NULL THEN '-' ELSE concat(strlen(CAST(n_chars AS VARCHAR)), ':', n_chars) END, tail)) AS leaf,
                          CASE WHEN n_chars IS NOT NULL AND xor(crc, 4294967295) % 7 = 0 THEN sha256(concat(head, strlen(CAST(n_chars + 1 AS VARCHAR)), ':', n_chars + 1, tail)) END AS changed FROM f),
             i AS (SELECT doc_id, coalesce(lang, chr(0)) AS lang, leaf, coalesce(changed, leaf) AS start, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM e),
             l AS (SELECT lang, 0 AS level, idx, leaf AS node, n FROM i
                   UNION ALL SELECT lang, level + 1, idx // 2, sha256(string_agg(node, '' ORDER BY idx)), (n + 1) // 2 FROM l WHERE n > 1 GROUP BY lang, level, idx // 2, n),
             s AS (SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang) - 1 AS idx, count(*) OVER () AS n FROM l WHERE n = 1),
             t AS (SELECT 0 AS level, idx, subroot AS node, n FROM s
                   UNION ALL SELECT level + 1, idx // 2, sha256(string_agg(node, '' ORDER BY idx)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY level, idx // 2, n),
             p AS (SELECT doc_id, lang, leaf, start AS node, idx, n, 0 AS level, '' AS proof FROM i
                   UNION ALL SELECT p.doc_id, p.lang, p.leaf, CASE WHEN p.idx % 2 = 1 THEN sha256(concat(o.node, p.node)) ELSE sha256(concat(p.node, coalesce(o.node, ''))) END,
                                    p.idx // 2, (p.n + 1) // 2, p.level + 1, concat(p.proof, coalesce(o.node, ''))
                   FROM p LEFT JOIN l o ON o.lang = p.lang AND o.level = p.level AND o.idx = CASE WHEN p.idx % 2 = 1 THEN p.idx - 1 ELSE p.idx + 1 END WHERE p.n > 1),
             q AS (SELECT p.doc_id, p.leaf, s.subroot, p.node, s.idx, s.n, 0 AS level, p.proof FROM p JOIN s ON s.lang = p.lang WHERE p.n = 1
                   UNION ALL SELECT q.doc_id, q.leaf, q.subroot, CASE WHEN q.idx % 2 = 1 THEN sha256(concat(o.node, q.node)) ELSE sha256(concat(q.node, coalesce(o.node, ''))) END,
                                    q.idx // 2, (q.n + 1) // 2, q.level + 1, concat(q.proof, coalesce(o.node, ''))
                   FROM q LEFT JOIN t o ON o.level = q.level AND o.idx = CASE WHEN q.idx % 2 = 1 THEN q.idx - 1 ELSE q.idx + 1 END WHERE q.n > 1)
        SELECT doc_id, leaf, subroot, r.node AS root, sha256(proof) AS proof_sha256, q.node AS folded_root, q.node = r.node AS verified
        FROM q, (SELECT node FROM t WHERE n = 1) r WHERE q.n = 1""",
    "op12_hard_negatives": """
        WITH v AS (SELECT DISTINCT CAST(vec_id AS BIGINT) AS vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
                   FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
                   FROM v a JOIN v c ON len(a.v) = len(c.v) AND a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
             p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
                   QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
               vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
        QUALIFY rank <= 5""",
}
