"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumapair.llm import exact_dedup, language, licenses, mixing, negatives, packing, pages, sharding, simhash, urls, vectors, viterbi, whitening
from lumapair.session import ship, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = language.train(docs, ~held_out)
    return language.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "proportions")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return pages.main_texts(table(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    vocabulary = viterbi.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    return viterbi.token_counts(table(spark, sf_dir, "documents"), vocabulary)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return out.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.train(spark, docs))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: (verdict, host, start of the path)
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES).withColumn("hits", F.array_join("hits", ","))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return negatives.mine(rows, F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Query] = {
    "op1_language": op1_language,
    "op2_html": op2_html,
    "op3_token_counts": op3_token_counts,
    "op4_sharding": op4_sharding,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_licenses": op6_licenses,
    "op7_packing": op7_packing,
    "op8_simhash": op8_simhash,
    "op9_vectors": op9_vectors,
    "op10_mixing": op10_mixing,
    "op11_urls": op11_urls,
    "op12_whitening": op12_whitening,
    "op13_negatives": op13_negatives,
}

_STRICT, _SOFT = (str([t for t, w in urls.VOCABULARY.items() if (w >= urls.LIMIT) == strict]) for strict in (True, False))

ORACLE_SQL: dict[str, str] = {
    "op5_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
             g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
        FROM n JOIN g ON n.t = g.t
    """,
    "op10_mixing": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
             s AS (SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size)::BIGINT AS cap,
                          ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM d GROUP BY source),
             k AS (SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS k FROM s),
             l AS (SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER e, 0)) / ((SELECT sum(w) FROM s) - coalesce(sum(w) OVER e, 0)) AS level
                   FROM k WINDOW e AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
             c AS (SELECT min_by(level, k) AS common FROM l WHERE cap > level * w),
             t AS (SELECT source, source_size, least(cap, coalesce((SELECT common FROM c) * w, cap)) AS target,
                          ('0x' || left(md5('mix-1' || coalesce(':' || source, '')), 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM l),
             p AS (SELECT doc_id, size, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
                          row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id) - 1 AS place
                   FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target, (floor((place + 1) * rate + u) - floor(place * rate + u))::BIGINT * size AS taken FROM p
    """,
    "op11_urls": rf"""
        WITH u AS (SELECT page_id, lower(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')) AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
             h AS (SELECT *, list_sort(list_filter(list_concat({_STRICT}, {_SOFT}), lambda t: regexp_matches(lower(host || path), '(^|[^a-z0-9])' || t || '([^a-z0-9]|$)'))) AS hits FROM u),
             r AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) AS v(verdict, r_host, r_path)),
             f AS (SELECT page_id, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(verdict, length(r_host || r_path)) AS verdict
                   FROM u JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY page_id),
             w AS (SELECT *, (2 * len(list_intersect(hits, {_STRICT})) + len(list_intersect(hits, {_SOFT})))::BIGINT AS weight FROM h)
        SELECT w.page_id, host, path, rule, coalesce(verdict, CASE WHEN weight >= 2 THEN 'block' ELSE 'allow' END) AS verdict, array_to_string(hits, ',') AS hits, weight FROM w LEFT JOIN f ON w.page_id = f.page_id
    """,
    "op13_negatives": r"""
        WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
                   FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT a.vec_id AS anchor_id, a.label = e.label AS same, e.vec_id, list_dot_product(a.x, e.x)::BIGINT AS score FROM e a JOIN e ON a.vec_id % 100 = 0 AND a.vec_id <> e.vec_id),
             p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score QUALIFY rank <= 5
    """,
}
