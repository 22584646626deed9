"""Exact duplicates in their context, and guards against merging near duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.operators.records import lookup_skewed
from tessera.operators.register import numbered_over_pages
from tessera.operators.standing import ADMONITIONS, DEDUPE, SAFETY
from tessera.plans.workspace import Workspace

# Patterns of what two statements must have in common to be merged.
NEGATION = "(?iU)\\b(not|never|no|don't|do not|must not|shall not|without|nicht|kein|niemals)\\b"
SIGNAL_WORDS = "\\b(DANGER|WARNING|CAUTION|NOTICE|NOTE|IMPORTANT|GEFAHR|WARNUNG|VORSICHT|ACHTUNG|HINWEIS)\\b"
PART = "\\b[A-Z]{1,4}-?\\d{3,}[A-Z0-9\\-]*\\b|\\b\\d{3,}-\\d{2,}[A-Z0-9\\-]*\\b"
STEP = "(?i)^\\s*(?:step\\s*)?\\(?(\\d{1,3})[.)]"
UNIT = ("(?iU)(?<=\\d)\\s*(n·?m|nm|ft-?lbs?|in-?lbs?|bar|psi|kpa|mpa|°c|°f|mm|cm|m|in|l|ml|kg|g|lbs?|"
        "h|hrs?|hours?|min|s|rpm|v|a|kw|w|hz|%)\\b")


def applicability_key(equipment: str, model: str) -> Column:
    """Equipment and models as sets."""
    return F.concat_ws("|", F.coalesce(F.array_join(t.several(F.col(equipment)), ";"), F.lit("")), F.coalesce(F.array_join(t.several(F.col(model)), ";"), F.lit("")))


def keyed(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Active statements with the hash of their text, topic, applicability and the rank of their source.

    ``sources`` (one row per source) goes through an ordinary join; where it is small, Spark broadcasts it."""
    rank = sources.select("source_id", (F.coalesce(F.col("is_repaired").cast("int"), F.lit(0)) * 2 + F.when(F.col("extraction_status") == "complete", 0).otherwise(1)).alias("rank"))
    rows = evidence.where((F.col("status") == "active") & F.col("block_type").isin(*DEDUPE)).select(
        "evidence_id", "source_id", "page_no", "seq", "block_type", t.norm_hash(F.col("text")).alias("hash"), t.topic(F.col("section_heading")).alias("topic"),
        applicability_key("equipment", "model").alias("applies"))
    return rows.join(rank, "source_id", "left").withColumn("rank", F.coalesce("rank", F.lit(3)))


def exact_groups(rows: DataFrame) -> DataFrame:
    """(evidence_id, canonical_id, role, members): groups of the same text, topic and applicability.

    The n-th occurrence of a safety statement in a source only groups with n-th occurrences, so none of a
    source's own repetitions are merged.
    The canonical one is of the best source, then first in the register: an aggregation, not a window, as a
    text may have very many copies."""
    same = ["hash", "topic", "applies"]
    safety = numbered_over_pages(rows.where(F.col("block_type").isin(*SAFETY)), *same)
    all_rows = rows.where(~F.col("block_type").isin(*SAFETY)).withColumn("nth", F.lit(0).cast("bigint")).unionByName(safety)
    # One key per group; groups that hold a large part of all rows are looked up through a bounded broadcast.
    held = Workspace(rows.sparkSession, "duplicates").save(
        all_rows.withColumn("group", F.sha2(F.concat_ws("\u0001", *same, F.col("nth").cast("string")), 256)).select("group", "rank", "source_id", "page_no", "seq", "evidence_id"), "groups")
    best = held.groupBy("group").agg(F.min(F.struct("rank", "source_id", "page_no", "seq", "evidence_id")).alias("best"), F.count(F.lit(1)).alias("members")).where("members > 1")
    met = lookup_skewed(held.select("group", "evidence_id"), best.select("group", F.col("best.evidence_id").alias("canonical_id"), "members"), "group", F.col("members"), held.count())
    return met.select("evidence_id", "canonical_id", F.when(F.col("evidence_id") == F.col("canonical_id"), "canonical").otherwise("exact_duplicate").alias("role"), "members")


def _bag(text: Column, pattern: str, group: int = 1) -> Column:
    return F.array_sort(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.lower(x)))


def _set(text: Column, pattern: str, group: int = 0) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))))


def guards(a: str, b: str) -> Column:
    """Why the statements in the structs ``a`` and ``b`` may not be merged: an array of reasons, in fixed order."""
    x, y = (lambda n: F.col(f"{a}.{n}")), (lambda n: F.col(f"{b}.{n}"))
    none = lambda c: F.coalesce(c, F.lit(""))
    calm = lambda c: F.coalesce(c.isin(*ADMONITIONS), F.lit(False))
    step = lambda c: F.regexp_extract(c, STEP, 1)
    reasons = [
        ("numbers_differ", x("numbers") != y("numbers")),
        ("units_differ", _bag(x("text"), UNIT) != _bag(y("text"), UNIT)),
        ("warning_or_signal_word_differs", (calm(x("block_type")) != calm(y("block_type"))) | (_set(x("text"), SIGNAL_WORDS) != _set(y("text"), SIGNAL_WORDS))
         | ~x("safety_level").eqNullSafe(y("safety_level"))),
        ("negation_differs", _bag(x("text"), NEGATION) != _bag(y("text"), NEGATION)),
        ("applicability_differs", (x("applies") != y("applies")) | (none(x("component")) != none(y("component")))),
        ("revision_differs", (x("source_id") != y("source_id")) & (none(x("revision")) != none(y("revision")))),
        ("procedure_step_differs", step(x("text")) != step(y("text"))),
        ("part_numbers_differ", _set(x("text"), PART) != _set(y("text"), PART)),
        ("block_type_differs", x("block_type") != y("block_type")),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in reasons]))


def guarded_pairs(pairs: DataFrame, evidence: DataFrame) -> DataFrame:
    """(pair_id, evidence_a, evidence_b, flags): registered pairs of two existing statements and their guards."""
    fields = ["text", "block_type", "safety_level", "component", "source_id", "revision", "applies", "numbers"]
    side = evidence.where(F.col("text").isNotNull()).select(
        "evidence_id", "text", "block_type", "safety_level", "component", "source_id", "revision", applicability_key("equipment", "model").alias("applies"),
        t.numeric_tokens(F.col("text")).alias("numbers")).select("evidence_id", F.struct(*fields).alias("s"))
    both = (pairs.join(side.select(F.col("evidence_id").alias("evidence_a"), F.col("s").alias("a")), "evidence_a")
            .join(side.select(F.col("evidence_id").alias("evidence_b"), F.col("s").alias("b")), "evidence_b"))
    return both.select("pair_id", "evidence_a", "evidence_b", guards("a", "b").alias("flags"))
