"""Small awkward tables: nulls everywhere, repeated rows, columns whose names clash with the operators' own."""

from __future__ import annotations

import datetime as dt

EVIDENCE = ("evidence_id string, source_id string, block_type string, text string, status string, canonical_evidence_id string, display_text string, "
            "created_at timestamp, loaded_at timestamp")
NEAR = "pair_id string, evidence_a string, evidence_b string, status string, created_at timestamp, loaded_at timestamp"
SOURCES = "source_id string, duplicate_of string, present int, first_seen_at timestamp, loaded_at timestamp"
QUANTITIES = ("quantity_id string, evidence_id string, raw_text string, value_text string, value double, value_min double, value_max double, unit_raw string, "
              "parameter string, flags array<string>, char_end int, alternate_of string, canonical_unit string, canonical_value double")
#: Names the operators use inside.
CLASHING = ("key", "n", "id", "u", "v", "a", "b", "bag", "copy", "look", "looks", "stored", "root", "vertex", "least", "quarter", "_b", "at", "refs", "form", "number", "tokens", "block", "turn", "fill", "ids", "code")


def day(n: int) -> dt.datetime:
    return dt.datetime(2025, 1, 1) + dt.timedelta(days=n)


def rows(spark, schema: str, *items: dict):
    names = [x.strip().split(" ")[0] for x in schema.split(", ")]
    return spark.createDataFrame([tuple(i.get(k) for k in names) for i in items], schema)


def evidence(spark, *items: dict):
    base = {"block_type": "paragraph", "created_at": day(0), "loaded_at": day(1), "status": "active"}
    return rows(spark, EVIDENCE, *[base | i for i in items])


def near(spark, *items: dict):
    return rows(spark, NEAR, *[{"status": "candidate", "created_at": day(0), "loaded_at": day(1)} | i for i in items])


def sources(spark, *items: dict):
    return rows(spark, SOURCES, *[{"present": 1, "first_seen_at": day(0), "loaded_at": day(1)} | i for i in items])


def quantities(spark, *items: dict):
    return rows(spark, QUANTITIES, *[{"evidence_id": "E", "flags": [], "char_end": 9} | i for i in items])


def clashing(df):
    """The same rows with columns of names the operators use."""
    from pyspark.sql import functions as F

    have = set(df.columns)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING if c not in have])


def nulls(df):
    """The same rows, and twice a row of nulls."""
    empty = df.sparkSession.createDataFrame([tuple(None for _ in df.columns)] * 2, df.schema)
    return df.unionByName(empty)
