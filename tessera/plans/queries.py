"""Queries of the core operators, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import quantities, references
from tessera.plans import analysis_queries, register_queries, units_sql  # noqa: F401  (registers its queries)
from tessera.plans import view_queries  # noqa: F401  (after those it counts)
from tessera.plans.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return references.found(table(spark, sf, "sources"), table(spark, sf, "evidence"), table(spark, sf, "near_duplicates"))


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    return references.report(table(spark, sf, "sources"), table(spark, sf, "evidence"), table(spark, sf, "near_duplicates"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return quantities.found(table(spark, sf, "quantities"), table(spark, sf, "evidence"), table(spark, sf, "canonical_units"))


def queries() -> dict[str, Query]:
    return {
        "p3_found": p3_found,
        "p3_report": p3_report,
        "p4_found": p4_found,
    } | register_queries.QUERIES


_ORPHANS = """
ev AS (SELECT evidence_id AS id, arg_max(status, (loaded_at, status)) = 'superseded' AS gone, min(created_at) AS born
       FROM evidence WHERE evidence_id IS NOT NULL GROUP BY 1),
src AS (SELECT source_id AS id, arg_max(present, (loaded_at, present)) = 0 AS gone, min(first_seen_at) AS born
        FROM sources WHERE source_id IS NOT NULL GROUP BY 1),
refs AS (
  SELECT 'near_duplicates' AS ref_table, 'evidence_a' AS ref_field, pair_id AS ref_id, max(evidence_a) AS key, min(created_at) AS made
  FROM near_duplicates WHERE pair_id IS NOT NULL AND evidence_a <> '' GROUP BY pair_id
  UNION ALL SELECT 'near_duplicates', 'evidence_b', pair_id, max(evidence_b), min(created_at)
  FROM near_duplicates WHERE pair_id IS NOT NULL AND evidence_b <> '' GROUP BY pair_id
  UNION ALL SELECT 'evidence', 'canonical_evidence_id', evidence_id, max(canonical_evidence_id), min(created_at)
  FROM evidence WHERE evidence_id IS NOT NULL AND canonical_evidence_id <> '' GROUP BY evidence_id
  UNION ALL SELECT 'sources', 'duplicate_of', source_id, max(duplicate_of), min(first_seen_at)
  FROM sources WHERE source_id IS NOT NULL AND duplicate_of <> '' GROUP BY source_id),
met AS (
  SELECT r.*, t.id, t.gone, t.born FROM refs r LEFT JOIN ev t ON t.id = r.key WHERE ref_table <> 'sources'
  UNION ALL SELECT r.*, t.id, t.gone, t.born FROM refs r LEFT JOIN src t ON t.id = r.key WHERE ref_table = 'sources'),
found AS (
  SELECT ref_table, ref_field, ref_id, strftime(made, '%Y-%m') AS period,
         CASE WHEN id IS NULL THEN 'missing' WHEN gone THEN 'deleted' WHEN born > made THEN 'late' END AS state FROM met)
"""

_P3 = f"WITH {_ORPHANS} SELECT * FROM found WHERE state IS NOT NULL"
_P3_REPORT = f"""WITH {_ORPHANS} SELECT ref_table, ref_field, period, state, count(*) AS orphans FROM found
WHERE state IS NOT NULL GROUP BY ref_table, ref_field, period, state"""


def oracle_sql() -> dict[str, str]:
    return {"p3_found": _P3, "p3_report": _P3_REPORT, "p4_found": units_sql.statement()} | register_queries.SQL
