"""Register of the text queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from usagelens.llm import (align, crf, decontaminate, jaccard, langid, lbl, licences, merkle, mixing, pii, simhash, urlfilter,
                           variants)
from usagelens.llm.common import held_out, table, trained_on


def op1_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op2_pii_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_all(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[pii.count_kind(F.col("base"), k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)],
                        F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256"),
                        pii.spans_text(F.col("spans")).alias("spans"))


def op3_language_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.languages(docs, docs.where(trained_on(F.col("doc_id"), 3, 1)))
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score", "rejected")


def op4_mix_waterfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = mixing.mix(table(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH rows AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents
), sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place
    FROM rows GROUP BY source
), asked AS (
    SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap FROM sources
), ordered AS (
    SELECT *, sum(cap) OVER w - cap AS cap_before, sum(weight) OVER w - weight AS weight_before,
           sum(source_size) OVER () AS total, sum(weight) OVER () AS weights
    FROM asked WINDOW w AS (ORDER BY CAST(cap AS DOUBLE) / weight, place ROWS UNBOUNDED PRECEDING)
), filled AS (
    SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * max(
        (1.5 * CAST(total AS DOUBLE) - CAST(cap_before AS DOUBLE)) / CAST(weights - weight_before AS DOUBLE)) OVER ()) AS target
    FROM ordered
), dealt AS (
    SELECT doc_id, size, source_size, target,
           CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole,
           CAST(sum(size) OVER (PARTITION BY rows.source ORDER BY md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'none')), doc_id
                                ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS before
    FROM rows JOIN filled ON rows.source IS NOT DISTINCT FROM filled.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(whole * size + greatest(0, least(size,
       floor(target - whole * source_size) - before)) AS BIGINT) AS taken
FROM dealt
"""


def op5_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(table(spark, sf_dir, "documents"))


def op7_lbl_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lbl.score(table(spark, sf_dir, "documents"), trained_on(F.col("doc_id"), 7, 2))
    return scored.select("doc_id", held_out(F.col("doc_id"), 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")


def op8_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(trained_on(F.col("doc_id"), 4, 2))
    scored = crf.score(table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")


def op9_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


OP9_SQL = r"""
WITH urls AS (
    SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
), rules(action, rule_host, rule_path) AS (
    VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), numbered AS (
    SELECT *, row_number() OVER () AS n FROM urls
), fitting AS (
    SELECT n, action, rule_host || rule_path AS rule,
           row_number() OVER (PARTITION BY n ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS place
    FROM numbered JOIN rules ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM numbered LEFT JOIN (SELECT * FROM fitting WHERE place = 1) USING (n)
"""


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op11_fragment_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"))


def op12_trie_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(table(spark, sf_dir, "documents"))


def op13_jaccard_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = {query.__name__: query for query in (
        op1_simhash_vptree, op2_pii_sanitise, op3_language_centroid, op4_mix_waterfill,
        op5_spaced_seed_decontamination, op6_merkle_fingerprint, op7_lbl_score, op8_crf_quality, op9_bloom_cascade, op10_licence_scan,
        op11_fragment_alignment, op12_trie_variants, op13_jaccard_orders)}
    return named | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op4_mix_waterfill": OP4_SQL, "op9_bloom_cascade": OP9_SQL}
