"""The corpus operators applied to their whole tables, with production settings."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import (
    bpe,
    compression,
    html_text,
    merkle,
    negatives,
    pii,
    pivots,
    prefix_tree,
    raking,
    risk_rules,
    sharding,
    simhash,
    toxicity,
)

#: Where the vocabulary of the public model lies on every machine.
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op2_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_subsequence_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_dom_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def op5_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk_rules.apply_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raking.sampled_documents(_table(spark, sf_dir, "documents"))


def op7_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_tree.join_components(_table(spark, sf_dir, "documents"))


def op8_candidate_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pii.find_spans(docs, pii.trained_model(docs))


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digest(_table(spark, sf_dir, "documents"), PIECE_MODEL)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_documents(_table(spark, sf_dir, "documents"))


def op11_merkle_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_documents(_table(spark, sf_dir, "documents"))


def op12_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.nearest(_table(spark, sf_dir, "embeddings"))


def op13_secondary_sort_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mined_embeddings(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_rendezvous_sharding": op1_rendezvous_sharding,
    "op2_compression_quality": op2_compression_quality,
    "op3_subsequence_toxicity": op3_subsequence_toxicity,
    "op4_dom_trees": op4_dom_trees,
    "op5_risk_controlled_rules": op5_risk_controlled_rules,
    "op6_raked_mixture": op6_raked_mixture,
    "op7_prefix_tree_join": op7_prefix_tree_join,
    "op8_candidate_boosting": op8_candidate_boosting,
    "op9_piece_codec": op9_piece_codec,
    "op10_simhash": op10_simhash,
    "op11_merkle_rollup": op11_merkle_rollup,
    "op12_pivot_search": op12_pivot_search,
    "op13_secondary_sort_negatives": op13_secondary_sort_negatives,
}

#: Twins in SQL where SQL can tell the rows. The other operators hash, learn or encode in ways that
#: DuckDB has no functions for; tests hold those against brute force. The twin of op11 works crc32 out
#: bit by bit; those of op12 and op13 score all pairs of queries and rows.
ORACLE: dict[str, str] = {
    "op6_raked_mixture": """
        WITH RECURSIVE words AS (
            SELECT doc_id, coalesce(source, 'none') AS source, coalesce(lang, 'none') AS lang,
                CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table'
                     WHEN regexp_matches(coalesce(text, ''), '###|\\*\\*\\*|\\$\\$\\$|%%%|&&&') THEN 'marked'
                     WHEN contains(coalesce(text, ''), 'License') THEN 'licence'
                     WHEN contains(coalesce(text, ''), '@') THEN 'contact'
                     ELSE 'prose' END AS topic,
                len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens
            FROM documents
        ), cells AS (
            SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM words
            GROUP BY ALL HAVING sum(n_tokens) > 0
        ), sources AS (
            SELECT source, pow(sum(tokens), 0.7) / sum(pow(sum(tokens), 0.7)) OVER () AS share FROM cells GROUP BY source
        ), langs AS (
            -- Languages without a named share keep their own share of tokens, the named ones share out the rest.
            SELECT lang, want / sum(want) OVER () AS share FROM (
                SELECT lang, CASE WHEN named IS NULL THEN own ELSE named / sum(named) OVER ()
                    * (1 - coalesce(sum(CASE WHEN named IS NULL THEN own END) OVER (), 0)) END AS want
                FROM (SELECT lang, sum(tokens) / sum(sum(tokens)) OVER () AS own,
                        CASE lang WHEN 'en' THEN 0.6 WHEN 'de' THEN 0.15 WHEN 'fr' THEN 0.15 WHEN 'es' THEN 0.1 END::DOUBLE AS named
                    FROM cells GROUP BY lang))
        ), topics AS (
            SELECT topic, pow(sum(tokens), 0.95) / sum(pow(sum(tokens), 0.95)) OVER () AS share FROM cells GROUP BY topic
        ), raked AS (
            SELECT 0 AS step, source, lang, topic, tokens, s.share AS s, l.share AS l, t.share AS t, tokens AS weight
            FROM cells JOIN sources s USING (source) JOIN langs l USING (lang) JOIN topics t USING (topic)
            UNION ALL
            SELECT step + 1, source, lang, topic, tokens, s, l, t,
                CASE step % 3
                    WHEN 0 THEN weight * s / sum(weight) OVER (PARTITION BY source)
                    WHEN 1 THEN weight * l / sum(weight) OVER (PARTITION BY lang)
                    ELSE weight * t / sum(weight) OVER (PARTITION BY topic) END
            FROM raked WHERE step < 90
        ), chances AS (
            SELECT source, lang, topic, tokens, greatest(round((weight / tokens) / max(weight / tokens) OVER (), 9), 1 / 4294967296.0::DOUBLE) AS p
            FROM raked WHERE step = 90
        ), judged AS (
            SELECT words.*, CASE WHEN n_tokens > 0 THEN p
                ELSE coalesce((SELECT round(sum(p * tokens) / sum(tokens), 9) FROM chances), 1) END AS probability,
                ('0x' || md5(coalesce(doc_id::VARCHAR, 'null'))[1:8])::BIGINT / 4294967296.0::DOUBLE AS draw
            FROM words LEFT JOIN chances USING (source, lang, topic)
        )
        SELECT doc_id, source, lang, topic, n_tokens, probability FROM judged WHERE draw < probability
    """,
    "op11_merkle_rollup": """
        WITH RECURSIVE told AS (
            SELECT doc_id, lang, text, source, n_chars,
                coalesce(list_reduce(
                    list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                    lambda crc, byte: list_reduce(
                        list_concat([xor(crc, byte)], list_transform(range(8), lambda i: i::BIGINT)),
                        lambda r, i: xor(r >> 1, 3988292384 * (r & 1)))), 0) AS crc
            FROM documents
        ), fields AS (
            SELECT doc_id, lang, doc_id IS NOT NULL AND xor(crc, 4294967295) % 3 = 0 AS hit,
                coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-')
                    || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
                    || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
                coalesce(strlen(text) || ':' || text, '-') AS tail,
                coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS low
            FROM told
        ), leaves AS (
            SELECT doc_id, lang, sha256(head || tail) AS leaf,
                CASE WHEN hit THEN sha256(head || low) ELSE sha256(head || tail) END AS changed,
                row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, sha256(head || tail)) - 1 AS rank,
                count(*) OVER (PARTITION BY lang) AS n
            FROM fields
        ), nodes AS (
            SELECT lang, 0 AS level, rank AS place, n, leaf AS hash FROM leaves
            UNION ALL
            SELECT lang, level + 1, place // 8, (max(n) + 7) // 8, sha256(string_agg(hash, '' ORDER BY place))
            FROM nodes WHERE n > 1 GROUP BY lang, level, place // 8
        ), tops AS (
            SELECT lang, hash AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank, count(*) OVER () AS n
            FROM nodes WHERE n = 1
        ), crown AS (
            SELECT 0 AS level, rank AS place, n, subroot AS hash FROM tops
            UNION ALL
            SELECT level + 1, place // 8, (max(n) + 7) // 8, sha256(string_agg(hash, '' ORDER BY place))
            FROM crown WHERE n > 1 GROUP BY level, place // 8
        ), steps AS (
            SELECT l.doc_id, l.lang, l.rank, s.level, coalesce(string_agg(s.hash, '' ORDER BY s.place) FILTER (s.place < l.rank // (8 ** s.level)::BIGINT), '') AS lft,
                coalesce(string_agg(s.hash, '' ORDER BY s.place) FILTER (s.place > l.rank // (8 ** s.level)::BIGINT), '') AS rgt
            FROM leaves l JOIN nodes s ON l.lang IS NOT DISTINCT FROM s.lang AND s.n > 1
                AND s.place // 8 = l.rank // (8 ** (s.level + 1))::BIGINT
            GROUP BY ALL
        ), upper_steps AS (
            SELECT t.lang, s.level, coalesce(string_agg(s.hash, '' ORDER BY s.place) FILTER (s.place < t.rank // (8 ** s.level)::BIGINT), '') AS lft,
                coalesce(string_agg(s.hash, '' ORDER BY s.place) FILTER (s.place > t.rank // (8 ** s.level)::BIGINT), '') AS rgt
            FROM tops t JOIN crown s ON s.n > 1 AND s.place // 8 = t.rank // (8 ** (s.level + 1))::BIGINT
            GROUP BY ALL
        ), paths AS (
            SELECT lang, rank, list({'lft': lft, 'rgt': rgt} ORDER BY level) AS path FROM steps GROUP BY ALL
        ), upper_paths AS (
            SELECT lang, list({'lft': lft, 'rgt': rgt} ORDER BY level) AS path FROM upper_steps GROUP BY ALL
        ), proven AS (
            SELECT l.doc_id, l.leaf, l.changed, t.subroot, (SELECT hash FROM crown WHERE n = 1) AS root,
                list_concat(coalesce(p.path, []), coalesce(u.path, [])) AS path
            FROM leaves l JOIN tops t ON l.lang IS NOT DISTINCT FROM t.lang
            LEFT JOIN paths p ON l.lang IS NOT DISTINCT FROM p.lang AND l.rank = p.rank
            LEFT JOIN upper_paths u ON l.lang IS NOT DISTINCT FROM u.lang
        ), refolded AS (
            SELECT doc_id, leaf, subroot, root, sha256(list_reduce(list_concat([''], list_transform(path, lambda s: s.lft || s.rgt)), lambda a, b: a || b)) AS proof_sha256,
                list_reduce(list_concat([{'lft': changed, 'rgt': ''}], path),
                    lambda a, s: {'lft': sha256(s.lft || a.lft || s.rgt), 'rgt': ''}).lft AS folded_root
            FROM proven
        )
        SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM refolded
    """,
    "op12_pivot_search": """
        WITH vectors AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM vectors q JOIN vectors c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
        )
        SELECT query_id, row_number() OVER best::INTEGER AS rank, vec_id, score FROM scored
        WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER best <= 5
    """,
    "op13_secondary_sort_negatives": """
        WITH vectors AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike, list_inner_product(a.v, c.v)::BIGINT AS score
            FROM vectors a JOIN vectors c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)
        ), positives AS (
            SELECT anchor_id, vec_id, score FROM scored WHERE alike
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER first::INTEGER AS rank,
            n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.alike
            AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
        WINDOW first AS (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)
        QUALIFY row_number() OVER first <= 5
    """,
}
