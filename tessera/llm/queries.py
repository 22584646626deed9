"""Queries of the training-data operators, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import copies, groups, lookalike, looks_sql, nearcopy, packing, sentences, tokens
from tessera.plans.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return groups.found(table(spark, sf, "evidence"), table(spark, sf, "near_duplicates"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return copies.found(table(spark, sf, "evidence"))


def p2_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    return copies.collapsed(table(spark, sf, "evidence"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.found(table(spark, sf, "evidence"))


def p5_text(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.normalised(table(spark, sf, "evidence"))


def p5_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.confusable_tokens(table(spark, sf, "evidence"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return nearcopy.found(table(spark, sf, "evidence"))


def p6_classes(spark: SparkSession, sf: str) -> DataFrame:
    return nearcopy.classes(table(spark, sf, "evidence"))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.ids(table(spark, sf, "documents"))


def p8_packed(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed(table(spark, sf, "documents"), table(spark, sf, "pack_limits"))


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill(p8_packed(spark, sf), table(spark, sf, "pack_limits"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentence_units(table(spark, sf, "documents"))


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found,
        "p2_found": p2_found,
        "p2_collapsed": p2_collapsed,
        "p5_found": p5_found,
        "p5_text": p5_text,
        "p5_tokens": p5_tokens,
        "p6_found": p6_found,
        "p6_classes": p6_classes,
        "p7_ids": p7_ids,
        "p8_packed": p8_packed,
        "p8_fill": p8_fill,
        "p9_found": p9_found,
    }


_P1 = """
WITH RECURSIVE
ids AS (SELECT DISTINCT evidence_id AS id FROM evidence WHERE evidence_id IS NOT NULL),
last AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY loaded_at DESC, status DESC) AS r FROM near_duplicates WHERE pair_id IS NOT NULL),
raw AS (
  SELECT evidence_a AS a, evidence_b AS b FROM last WHERE r = 1 AND status IN ('candidate', 'confirmed_duplicate')
  UNION SELECT evidence_id, canonical_evidence_id FROM evidence),
link AS (
  SELECT a, b FROM raw WHERE a <> b AND a IN (SELECT id FROM ids) AND b IN (SELECT id FROM ids)
  UNION SELECT b, a FROM raw WHERE a <> b AND a IN (SELECT id FROM ids) AND b IN (SELECT id FROM ids)),
reach(id, other) AS (
  SELECT a, a FROM link
  UNION SELECT reach.id, link.b FROM reach JOIN link ON link.a = reach.other)
SELECT id AS evidence_id, min(other) AS group_id FROM reach GROUP BY id
"""

_KEYS = r"""
stmt AS (
  SELECT evidence_id, min(created_at) AS created_at, any_value(block_type) AS block_type,
         replace(replace(lower(any_value(text)), 'ß', 'ss'), 'ς', 'σ') AS t
  FROM evidence
  WHERE evidence_id IS NOT NULL AND text IS NOT NULL
    AND block_type IN ('paragraph', 'list_item', 'table', 'danger', 'warning', 'caution', 'notice', 'note', 'caption')
  GROUP BY evidence_id),
parts AS (
  SELECT evidence_id, created_at, block_type,
         CASE WHEN block_type = 'table' THEN regexp_split_to_array(t, '[;|\r\n]') ELSE [t] END AS p FROM stmt),
bare AS (
  SELECT evidence_id, created_at, block_type, list_transform(p, lambda x: regexp_replace(
    regexp_replace(regexp_replace(
      regexp_replace(regexp_replace(regexp_replace(regexp_replace(x,
        '(\p{N})\.(\p{N})', '\1' || chr(57345) || '\2', 'g'), '(\p{N})\.(\p{N})', '\1' || chr(57345) || '\2', 'g'),
        '(\p{N}),(\p{N})', '\1' || chr(57346) || '\2', 'g'), '(\p{N}),(\p{N})', '\1' || chr(57346) || '\2', 'g'),
      '(^|[^\p{L}\p{M}\p{N}])[-−](\p{N})', '\1' || chr(57347) || '\2', 'g'),
      '(^|[^\p{L}\p{M}\p{N}])[-−](\p{N})', '\1' || chr(57347) || '\2', 'g'),
    '[^\p{L}\p{M}\p{N}\x{E001}-\x{E003}]', '', 'g')) AS p FROM parts),
keys AS (
  SELECT evidence_id, created_at, CASE WHEN block_type = 'table' THEN 'T' ELSE 'S' END
         || array_to_string(list_sort(list_filter(p, lambda x: x <> '')), chr(1)) AS key FROM bare),
groups AS (
  SELECT key, count(*) AS n, min(evidence_id) AS group_id, arg_min(evidence_id, (created_at, evidence_id)) AS earliest_id
  FROM keys WHERE length(key) > 1 GROUP BY key)
"""

_P2 = f"WITH {_KEYS} SELECT evidence_id, group_id FROM keys JOIN groups USING (key) WHERE n > 1"
_P2_COLLAPSED = f"WITH {_KEYS} SELECT group_id, earliest_id, n AS copies FROM groups"


def oracle_sql() -> dict[str, str]:
    return {"p1_found": _P1, "p2_found": _P2, "p2_collapsed": _P2_COLLAPSED, "p5_found": looks_sql.P5, "p6_found": looks_sql.p6(_KEYS)}
