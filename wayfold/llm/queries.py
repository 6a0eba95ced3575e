"""The registered queries of this subpackage, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayfold.llm.chat import rotate_perspectives
from wayfold.llm.decontaminate import decontaminate
from wayfold.llm.near_dedup import DedupParams, near_duplicates
from wayfold.llm.pieces import encode_pieces
from wayfold.llm.quality_classifier import quality_scores
from wayfold.llm.quality_rules import quality_rules
from wayfold.llm.secrets import secret_scan
from wayfold.llm.sharding import balanced_shards
from wayfold.llm.tables import table
from wayfold.llm.toxicity import toxicity
from wayfold.llm.urls import url_filter


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), DedupParams(shingle=2))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"))


def op6_balanced_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op10_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_sentencepiece_sampling": op3_sentencepiece_sampling,
    "op4_toxicity": op4_toxicity,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_balanced_sharding": op6_balanced_sharding,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_url_filter": op8_url_filter,
    "op9_secret_scan": op9_secret_scan,
    "op10_perspective_rotation": op10_perspective_rotation,
}

_NEAR_DEDUP_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []
                      WHEN len(w) = 1 THEN [w[1]]
                      ELSE list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) END AS s
  FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (SELECT a, b FROM pairs WHERE 100 * i >= 80 * (na + nb - i)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
), least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least.component_id, s.doc_id = least.component_id AS kept
FROM s JOIN least ON s.doc_id = least.doc_id
"""

_DECONTAMINATION_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), il AS (SELECT item_id, w, least(10, len(w)) AS n FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS x FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM il)),
dp AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d CROSS JOIN (SELECT DISTINCT n FROM iw) WHERE len(w) >= n),
dw AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS x FROM dp),
hit AS (SELECT dw.doc_id, dw.s, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.x = iw.x),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id LEFT JOIN named ON d.doc_id = named.doc_id
"""

_ROTATION_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role AS speaker, replace(coalesce(text, ''), '<|im_', '<| im_') AS body
  FROM conversations WHERE conv_id IS NOT NULL
), p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker IS DISTINCT FROM 'system'),
h AS (
  SELECT t.conv_id, perspective, turn, speaker, body, speaker IS NOT DISTINCT FROM perspective AS own,
    CASE WHEN speaker IS NOT DISTINCT FROM perspective THEN '<|im_start|>assistant' || chr(10)
         WHEN speaker = 'system' THEN '<|im_start|>system' || chr(10)
         WHEN speaker IS NULL THEN '<|im_start|>user' || chr(10)
         ELSE '<|im_start|>user name=' || replace(replace(replace(speaker, chr(13), ' '), chr(10), ' '), '<|im_', '<| im_') || chr(10) END AS head
  FROM t JOIN p ON t.conv_id = p.conv_id
)
SELECT conv_id, perspective, turn, speaker, head || body || '<|im_end|>' || chr(10) AS rendered, CAST(length(head) AS BIGINT) AS mask_start,
  CAST(length(head) + CASE WHEN own THEN length(body) + 10 ELSE 0 END AS BIGINT) AS mask_end
FROM h
"""

ORACLE_SQL: dict[str, str] = {
    "op5_minhash_near_dedup": _NEAR_DEDUP_SQL,
    "op7_benchmark_decontamination": _DECONTAMINATION_SQL,
    "op10_perspective_rotation": _ROTATION_SQL,
}
