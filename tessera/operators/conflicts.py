"""Statements that contradict each other across sources, found by keyed aggregates.

Values are held against each other within a key (parameter, qualifier, subject, applicability) by their least and
greatest bounds, so no pairs are made within a group: two intervals of a group fail to overlap exactly if the
greatest lower bound lies above the least upper bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.operators.standing import SAFETY

# What is compared, and how closely.
COMPARED = ("torque", "pressure", "temperature", "interval", "length", "volume", "mass", "force", "flow", "power")
RELATIVE, ABSOLUTE, DUAL = 0.005, 1e-9, 0.03
# Words that say nothing of what a value is of, and words for the same thing.
STOPWORDS = ("the", "a", "an", "of", "to", "and", "or", "for", "with", "on", "in", "at", "by", "from", "is", "are", "be", "must", "shall", "should", "may", "can", "all", "any", "each", "this", "that",
             "these", "its", "check", "set", "tighten", "torque", "value", "setting", "approx", "approximately", "not", "exceed", "every", "after", "before", "hours", "hour", "using", "use", "replace",
             "change", "inspect", "adjust", "clean", "lubricate", "allow", "ensure", "make", "keep", "until", "then", "also", "only", "ca", "about", "below", "above", "up", "least", "than", "more",
             "less", "first", "time")
SYNONYMS = {"max": "maximum", "min": "minimum", "temp": "temperature", "press": "pressure", "screws": "bolts", "screw": "bolt", "bolts": "bolt"}
# Headers of part numbers and descriptions, and part numbers in running text.
NUMBER_HEADER = "(?i)\\b(?:part *(?:no|number|#)|p/n|pn|order *(?:no|number)|art(?:icle)?\\.? *no|item *no)\\b"
NAME_HEADER = "(?i)\\b(?:description|designation|name|bezeichnung|part name)\\b"
#: Guards of a pair that make a difference between safety statements.
TELLING = ("numbers_differ", "negation_differs", "warning_or_signal_word_differs", "units_differ")


def subject(text: Column) -> Column:
    """What a clause is about: its telling words, in one form each, in order, once."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z-]+"), F.lit(0))
    alike = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    same = lambda w: F.coalesce(alike[w], w)
    bare = F.filter(F.transform(words, lambda w: F.regexp_replace(w, "-+$", "")), lambda w: ~w.isin(*STOPWORDS))
    plural = lambda w: (F.length(w) > 4) & w.endswith("s") & ~w.rlike("(?:ss|us|is)$")
    single = F.transform(F.transform(bare, same), lambda w: F.when(plural(w), F.substring(w, 1, 1_000_000).substr(F.lit(1), F.length(w) - 1)).otherwise(w))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(single, same), lambda w: ~w.isin(*STOPWORDS)))), " ")


def clause_before(text: Column, at: Column) -> Column:
    """The text from the last end of a clause up to a place."""
    return F.regexp_extract(text.substr(F.lit(1), at), "(?s)^(?:.*(?:\\. |; |\\n|, ))?(.*)$", 1)


def stated_values(quantities: DataFrame, evidence: DataFrame) -> DataFrame:
    """Comparable values with their subject: active statements that stand for themselves, no restatements."""
    asked = quantities.where(F.col("parameter").isin(*COMPARED) & F.col("canonical_value").isNotNull() & F.col("alternate_of").isNull() & F.col("char_start").isNotNull())
    held = evidence.where((F.col("status") == "active") & (F.col("dup_role").isNull() | (F.col("dup_role") == "canonical"))).select(
        "evidence_id", "source_id", "text", "section_heading", F.coalesce(F.array_join(t.several(F.col("model")), ";"), F.lit("")).alias("models"))
    rows = asked.join(held, "evidence_id")
    about = subject(clause_before(F.col("text"), F.col("char_start")))
    fallback = subject(F.concat_ws(" ", clause_before(F.col("text"), F.col("char_start")), "section_heading"))
    return rows.select("quantity_id", "evidence_id", "source_id", "parameter", "models", "canonical_unit",
                       F.when(F.col("qualifier").isin("max", "min"), F.col("qualifier")).otherwise("nominal").alias("qualifier"),
                       F.when(about.contains(" "), about).otherwise(fallback).alias("subject"), "canonical_value")


def quantity_conflicts(values: DataFrame) -> DataFrame:
    """Groups of values of one thing that do not agree: how many, in how many statements, and from what to what."""
    span = values.where("subject <> ''").groupBy("parameter", "qualifier", "subject", "models", "canonical_unit").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("evidence_id").alias("statements"), F.min("canonical_value").alias("low"), F.max("canonical_value").alias("high"))
    tolerance = F.greatest(F.lit(ABSOLUTE), RELATIVE * F.greatest(F.abs("low"), F.abs("high")))
    return span.where((F.col("statements") > 1) & (F.col("low") + tolerance < F.col("high"))).select(
        "parameter", "qualifier", "subject", "models", "canonical_unit", "n", "statements", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def dual_unit_conflicts(quantities: DataFrame) -> DataFrame:
    """Restatements that differ from what they restate by more than three in a hundred."""
    first = quantities.select(F.col("quantity_id").alias("alternate_of"), F.col("canonical_value").alias("first"), F.col("canonical_unit").alias("unit"))
    met = quantities.where(F.col("canonical_value").isNotNull()).join(first.where("first IS NOT NULL AND first <> 0"), "alternate_of").where(F.col("unit") == F.col("canonical_unit"))
    off = F.abs(F.col("first") - F.col("canonical_value")) / F.abs("first")
    return met.where(off > DUAL).select("quantity_id", "alternate_of", F.round(off, 6).alias("off"))


def table_parts(evidence: DataFrame) -> DataFrame:
    """(evidence_id, part_number, description) from tables whose header names both columns."""
    head = F.col("table_cells")[0]
    place = lambda p: F.array_position(F.transform(head, lambda c: F.coalesce(c, F.lit("")).rlike(p)), True).cast("int")
    rows = evidence.where(F.size("table_cells") > 1).select("evidence_id", place(NUMBER_HEADER).alias("i"), place(NAME_HEADER).alias("j"), F.explode(F.slice("table_cells", 2, 100_000)).alias("row"))
    cell = lambda k: F.trim(F.try_element_at("row", F.col(k)))
    return rows.where("i > 0 AND j > 0").select("evidence_id", cell("i").alias("part_number"), cell("j").alias("description")).where("part_number <> '' AND description <> ''")


def inline_parts(evidence: DataFrame) -> DataFrame:
    """(evidence_id, part_number) of part numbers in running text."""
    found = F.regexp_extract_all("text", F.lit("(?i)\\b(?:P/N|PN|part *(?:no\\.?|number)|order *no\\.?) *[:#]? *([A-Z0-9][A-Z0-9./-]{2,})"), F.lit(1))
    return evidence.where((F.col("block_type") != "table") & F.col("text").isNotNull()).select("evidence_id", F.explode(found).alias("p")).select(
        "evidence_id", F.regexp_replace("p", "[.,;)]+$", "").alias("part_number"))


def part_conflicts(parts: DataFrame) -> DataFrame:
    """Descriptions, in normalised form, with more than one part number."""
    named = parts.select("evidence_id", t.normalised(F.col("description")).alias("name"), F.upper("part_number").alias("number"))
    return named.groupBy("name").agg(F.countDistinct("number").alias("numbers"), F.countDistinct("evidence_id").alias("statements"), F.min("number").alias("first_number"), F.max("number").alias("last_number")).where(
        "numbers > 1 AND statements > 1")


def procedures(evidence: DataFrame) -> DataFrame:
    """Steps and warnings under each topic of each source."""
    rows = evidence.where((F.col("status") == "active") & F.col("block_type").isin("list_item", *SAFETY) & F.col("section_heading").isNotNull()).select(
        "source_id", t.topic(F.col("section_heading")).alias("topic"), "block_type", "page_no")
    return rows.where("topic <> ''").groupBy("source_id", "topic").agg(F.count_if(F.col("block_type") == "list_item").alias("steps"), F.count_if(F.col("block_type") != "list_item").alias("warnings"),
                                                                       F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"))


def procedure_conflicts(assembled: DataFrame) -> DataFrame:
    """Topics whose sources have different numbers of steps."""
    return assembled.where("steps >= 2").groupBy("topic").agg(F.count(F.lit(1)).alias("sources"), F.min("steps").alias("fewest"), F.max("steps").alias("most")).where("fewest < most")


def missing_warnings(evidence: DataFrame) -> DataFrame:
    """Warnings under a topic that some but not all sources of the topic with steps have; equal in normalised form."""
    rows = evidence.where((F.col("status") == "active") & F.col("block_type").isin("list_item", *SAFETY) & F.col("section_heading").isNotNull()).select(
        "source_id", t.topic(F.col("section_heading")).alias("topic"), (F.col("block_type") == "list_item").alias("step"), t.norm_hash(F.col("text")).alias("hash"))
    with_steps = rows.where("topic <> '' AND step").select("source_id", "topic").distinct()
    sources = with_steps.groupBy("topic").agg(F.count(F.lit(1)).alias("sources"))
    held = rows.where("topic <> '' AND NOT step").join(with_steps, ["source_id", "topic"], "left_semi").groupBy("topic", "hash").agg(F.countDistinct("source_id").alias("having"))
    return held.join(sources, "topic").where("having < sources").select("topic", "hash", "having", "sources")


def safety_conflicts(near: DataFrame, evidence: DataFrame) -> DataFrame:
    """Candidate pairs with a safety statement whose guards tell of a real difference."""
    side = lambda e, c: evidence.where(F.col("status") == "active").select(F.col("evidence_id").alias(e), F.col("block_type").alias(c))
    met = near.where(F.col("status").isin("candidate", "not_duplicate")).join(side("evidence_a", "ta"), "evidence_a").join(side("evidence_b", "tb"), "evidence_b")
    told = F.array_sort(F.array_intersect("guard_flags", F.array(*[F.lit(x) for x in TELLING])))
    return met.where((F.col("ta").isin(*SAFETY) | F.col("tb").isin(*SAFETY)) & (F.size(told) > 0)).select("pair_id", "evidence_a", "evidence_b", F.array_join(told, ";").alias("told"))


def families(sources: DataFrame) -> DataFrame:
    """Document numbers that several sources bear, with their revisions."""
    return sources.where("doc_number <> ''").groupBy("doc_number").agg(F.count(F.lit(1)).alias("sources"), F.countDistinct("revision").alias("revisions"), F.min("source_id").alias("first_source")).where("sources > 1")


def fingerprint(kind: Column | str, parameter: Column, ids: Column) -> Column:
    """The identity of a conflict: its kind, parameter and the statements in it, in order."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.sha2(F.concat_ws("|", kind, F.coalesce(parameter, F.lit("None")), F.array_join(F.array_sort(F.array_distinct(ids)), "|")), 256)
