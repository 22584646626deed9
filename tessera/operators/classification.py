"""Chapters and components of statements by weighted rules.

Rules are data: word lists and patterns of a chapter become columns, so a classification is one projection
without any join.  Words are matched whole, in any case, with any white space between their parts and with
simple plurals.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Chapter:
    name: str
    headings: tuple[str, ...] = ()
    words: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    blocks: tuple[str, ...] = ()


# Weights of what speaks for a chapter, the least score, and the lead below which a second chapter makes it ambiguous.
SECTION, OWN_HEADING, WORD, WORDS_AT_MOST, PATTERN, BLOCK, LEAST, LEAD = 4.0, 5.0, 1.0, 4.0, 2.0, 3.0, 2.0, 0.5
# Chapters with the words of their headings and statements.
CHAPTERS = (
    Chapter("scope", ("scope", "introduction", "applicability", "purpose", "about this manual", "overview", "general information"),
            ("this manual", "this bulletin", "applies to", "intended for", "purpose of this")),
    Chapter("safety", ("safety", "safety instructions", "safety precautions", "hazards", "lockout", "personal protective equipment"),
            ("lock out", "lockout", "tag out", "tagout", "personal protective", "PPE", "injury", "hazard", "safety glasses", "protective gloves"), (), ("danger", "warning", "caution")),
    Chapter("specifications", ("specifications", "technical data", "technical specifications", "rated data", "performance data", "dimensions"),
            ("rated", "nominal", "maximum operating", "capacity", "motor power", "power supply", "weight")),
    Chapter("components", ("components", "system description", "description", "design and function", "construction", "functional description"),
            ("consists of", "is mounted", "is located", "comprises")),
    Chapter("preventive_maintenance", ("preventive maintenance", "preventative maintenance", "routine maintenance", "periodic maintenance", "lubrication", "servicing", "lubrication points"),
            ("lubricate", "grease", "oil change", "replace the filter", "operating hours")),
    Chapter("inspections", ("inspection", "inspections", "checks", "checklist", "visual check", "weekly inspections", "daily checks"),
            ("inspect", "check for", "visually", "examine", "leaks", "cracks", "wear")),
    Chapter("procedures", ("procedure", "procedures", "maintenance procedures", "removal", "installation", "replacing", "replacement", "adjustment", "disassembly", "assembly", "work instructions"),
            ("remove", "install", "tighten", "loosen", "disconnect", "reconnect", "refit"), ("(?im)^[ \\t]*(?:step[ \\t]*)?[0-9]{1,2}[.)][ \\t]+[A-Z]",)),
    Chapter("troubleshooting", ("troubleshooting", "fault finding", "faults", "diagnosis", "error codes", "malfunctions"),
            ("cause", "remedy", "symptom", "fault", "possible cause", "corrective action", "too low", "too high", "noise")),
    Chapter("repairs", ("repair", "repairs", "overhaul", "rebuild", "refurbishment"), ("overhaul", "rebuild", "worn parts", "machining")),
    Chapter("schedules", ("maintenance schedule", "service schedule", "maintenance intervals", "service intervals", "maintenance plan"),
            ("daily", "weekly", "monthly", "annually", "yearly", "interval"), ("(?i)\\bevery +[0-9][0-9,.]* *(?:operating +)?(?:hours|h|days|weeks|months|years)\\b",)),
    Chapter("parts", ("spare parts", "parts list", "replacement parts", "parts catalogue", "bill of materials"), ("part no", "part number", "P/N", "order no", "qty"),
            ("(?i)\\b(?:P/N|PN|Part *No\\.?) *[:#]? *[A-Z0-9][A-Z0-9\\-.]{2,}",)),
    Chapter("tools", ("tools", "special tools", "consumables", "equipment required", "materials required", "lubricants"),
            ("torque wrench", "spanner", "screwdriver", "feeler gauge", "sealant", "thread locker")),
    Chapter("diagrams", ("diagram", "diagrams", "drawing", "drawings", "schematic", "illustrations", "hydraulic circuit", "wiring"), (),
            ("(?im)^(?:fig(?:ure)?\\.?|diagram|illustration|drawing) *[0-9]+",), ("figure", "caption")),
    Chapter("revision_references", ("revision history", "revisions", "change record", "references", "related documents", "document history"),
            ("initial release", "supersedes", "reference document", "change notice"), ("(?i)\\bdocument +no\\.? *[:#]? *[^ ]+",)),
)
# Components and the words that name them.
COMPONENTS = {"Hydraulic pump": ("hydraulic pump", "pump"), "Pump coupling": ("pump coupling", "coupling"), "Hydraulic filter": ("filter element", "hydraulic filter", "oil filter"),
              "Main cylinder": ("main cylinder",), "Accumulator": ("accumulator",), "Guide rails": ("guide rail",), "Lubrication system": ("lubrication", "grease")}


def word_pattern(words: tuple[str, ...]) -> str:
    """Any of the words, longest first."""
    parts = [re.sub(r"([.()/*+?])", r"\\\1", w).replace(" ", "[ \\t\\n]+") + ("(?:s|es)?" if w[-1].isalpha() else "") for w in sorted(words, key=lambda w: (-len(w), w))]
    return "(?i)\\b(?:" + "|".join(parts) + ")\\b"


def scores(text: Column, block: Column, heading: Column, chapters: tuple[Chapter, ...] = CHAPTERS) -> Column:
    """array of struct(score, name), in the order of the chapters."""
    named = [F.coalesce(heading.rlike(word_pattern(c.headings)), F.lit(False)) if c.headings else F.lit(False) for c in chapters]
    context = named[0]
    for n in named[1:]:
        context = context | n
    out = []
    for c, hit in zip(chapters, named):
        score = F.when(hit, SECTION).otherwise(0.0)
        if c.headings:
            score = score + F.when((block == "heading") & text.rlike(word_pattern(c.headings)), OWN_HEADING).otherwise(0.0)
        if c.words:
            found = F.size(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(word_pattern(c.words)), F.lit(0)), F.lower)))
            score = score + F.least(F.lit(WORDS_AT_MOST), found * WORD)
        for p in c.patterns:
            score = score + F.when(text.rlike(p), PATTERN).otherwise(0.0)
        if c.blocks:
            score = score + F.when(block.isin(*c.blocks) & ~context, BLOCK).otherwise(0.0)
        out.append(F.struct(score.alias("score"), F.lit(c.name).alias("name")))
    return F.array(*out)


def chapters_of(evidence: DataFrame, chapters: tuple[Chapter, ...] = CHAPTERS) -> DataFrame:
    """(evidence_id, chapter, score, outcome): the best chapter, ``unclassified`` below the least score, and whether
    another is about as good."""
    rows = evidence.where(F.col("text").isNotNull()).select("evidence_id", scores(F.col("text"), F.coalesce("block_type", F.lit("")), F.col("section_heading"), chapters).alias("s"))
    # Earlier chapters win ties: places count down.
    placed = F.transform("s", lambda x, i: F.struct(x["score"].alias("score"), (-i).alias("place"), x["name"].alias("name")))
    best = rows.select("evidence_id", F.reverse(F.array_sort(placed)).alias("s")).select("evidence_id", F.col("s")[0].alias("a"), F.col("s")[1].alias("b"))
    low = F.col("a.score") < LEAST
    return best.select("evidence_id", F.when(low, "unclassified").otherwise(F.col("a.name")).alias("chapter"), F.col("a.score").alias("score"),
                       F.when(low, "unclassified").when((F.col("b.score") > 0) & (F.col("a.score") - F.col("b.score") < LEAD), "ambiguous").otherwise("classified").alias("outcome"))


def components_of(evidence: DataFrame, components: dict[str, tuple[str, ...]] = COMPONENTS) -> DataFrame:
    """(evidence_id, component, hits): components named in statements, with how often."""
    hits = F.array(*[F.struct(F.lit(name).alias("component"), F.regexp_count("text", F.lit(word_pattern((*words, name)))).cast("bigint").alias("hits")) for name, words in components.items()])
    return evidence.where(F.col("text").isNotNull()).select("evidence_id", F.explode(F.filter(hits, lambda x: x["hits"] > 0)).alias("c")).select("evidence_id", "c.component", "c.hits")


#: What a model's name looks like in running text.
MODEL = "\\b[A-Z]{2,3}-[0-9]{1,4}\\b"


def applicability(evidence: DataFrame, sources: DataFrame, known: DataFrame, pattern: str = MODEL) -> DataFrame:
    """(evidence_id, models, origin): models named in the text or its heading and known to the register, else the source's.

    ``known`` (model) are the register's models, matched by an ordinary join on what the texts name."""
    named = evidence.where(F.col("text").isNotNull()).select("evidence_id", "source_id", F.explode_outer(F.array_distinct(
        F.regexp_extract_all(F.concat_ws("\n", "section_heading", "text"), F.lit(pattern), F.lit(0)))).alias("model"))
    met = named.join(known.select("model", F.lit(True).alias("is_known")), "model", "left").groupBy("evidence_id", "source_id").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("is_known"), F.col("model")))), "; ").alias("own"))
    return met.join(sources.select("source_id", F.col("model").alias("source_model")), "source_id", "left").select(
        "evidence_id", F.when(F.col("own") != "", F.col("own")).otherwise(F.col("source_model")).alias("models"), F.when(F.col("own") != "", "text").otherwise("source").alias("origin"))
