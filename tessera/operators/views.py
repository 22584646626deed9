"""Views of the register: kinds, labels, plans, completeness, and what a change brings with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.operators.standing import ADMONITIONS

LONG = "bigint"


def kind(block: Column) -> Column:
    """What a block is in a report."""
    return (F.when(block.isin(*ADMONITIONS), "safety").when(block == "table", "table").when(block == "list_item", "step").when(block == "caption", "caption")
            .when(block == "heading", "heading").when(block == "header_footer", "furniture").otherwise("text"))


def applicability_label(equipment: Column, model: Column) -> Column:
    """Equipment and model, or that neither is stated."""
    label = F.concat_ws(" / ", F.nullif(equipment, F.lit("")), F.nullif(model, F.lit("")))
    return F.when(label == "", "Applicability not stated").otherwise(label)


def citation(evidence_id: Column, path: Column, revision: Column, page: Column) -> Column:
    """EV... (file Rev X p.N)."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.concat(evidence_id, F.lit(" ("), name, F.when(revision != "", F.concat(F.lit(" Rev "), revision)).otherwise(""), F.lit(" p."), page.cast("string"), F.lit(")"))


def cited(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    held = sources.where("rel_path IS NOT NULL").select("source_id", "rel_path", "revision")
    return evidence.where("page_no IS NOT NULL").join(held, "source_id").select("evidence_id", citation(F.col("evidence_id"), F.col("rel_path"), F.col("revision"), F.col("page_no")).alias("label"))


def extraction_plan(sources: DataFrame, evidence: DataFrame) -> DataFrame:
    """What to do with each source: extract, resume or skip, by its state and the last page that is there."""
    reached = evidence.groupBy("source_id").agg(F.max("page_no").alias("reached"))
    rows = sources.join(reached, "source_id", "left")
    action = (F.when((F.col("present") != 1) | F.col("present").isNull(), "skip_missing").when(F.col("status") == "duplicate", "skip_duplicate")
              .when(F.col("extraction_status").isin("complete", "complete_with_errors"), "skip_done").when(F.col("reached") < F.col("page_count"), "resume").otherwise("extract"))
    return rows.select("source_id", action.alias("action"), F.coalesce("reached", F.lit(0)).cast(LONG).alias("reached"))


def completeness(sources: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per present source: pages that should be there, are there, lie within and beyond the page count."""
    pages = evidence.where("page_no IS NOT NULL").select("source_id", "page_no").distinct()
    held = sources.where((F.col("present") == 1) & (F.col("page_count") >= 1)).select("source_id", "page_count")
    return held.join(pages, "source_id", "left").groupBy("source_id", "page_count").agg(
        F.count("page_no").alias("found"), F.count_if(F.col("page_no").between(1, F.col("page_count"))).alias("within"), F.count_if(F.col("page_no") > F.col("page_count")).alias("beyond"))


def lost_signal_words(evidence: DataFrame) -> DataFrame:
    """Reviewed wordings that dropped a signal word of their text."""
    words = "\\b(?:DANGER|GEFAHR|WARNING|WARNUNG|CAUTION|VORSICHT|NOTICE|IMPORTANT|ACHTUNG|NOTE|HINWEIS)\\b"
    find = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(words), F.lit(0)))
    lost = F.array_sort(F.array_except(find("text"), find("display_text")))
    return evidence.where("display_text <> '' AND text IS NOT NULL").select("evidence_id", lost.alias("l")).where(F.size("l") > 0).select("evidence_id", F.array_join("l", ";").alias("lost"))


def superseded_with(evidence: DataFrame, near: DataFrame, quantities: DataFrame) -> DataFrame:
    """(kind, id): what goes with superseded statements: statements that stand on them, their pairs, their values."""
    gone = evidence.where("status = 'superseded'").select("evidence_id")
    members = evidence.where("canonical_evidence_id <> ''").join(gone.withColumnRenamed("evidence_id", "canonical_evidence_id"), "canonical_evidence_id", "left_semi").select(F.lit("statement").alias("kind"), F.col("evidence_id").alias("id"))
    # Each side of a pair on its own; a pair with both is one.
    sides = near.select("pair_id", F.explode(F.array("evidence_a", "evidence_b")).alias("evidence_id")).join(gone, "evidence_id", "left_semi")
    pairs = sides.select(F.lit("pair").alias("kind"), F.col("pair_id").alias("id")).distinct()
    values = quantities.join(gone, "evidence_id", "left_semi").select(F.lit("quantity").alias("kind"), F.col("quantity_id").alias("id"))
    return members.unionByName(pairs).unionByName(values)


def value_signatures(quantities: DataFrame) -> DataFrame:
    """Per statement its printed values with their units, sorted: the identity of its numbers."""
    printed = F.concat_ws(" ", F.translate("value_text", "−", "-"), "unit_raw")
    return quantities.where("value_text IS NOT NULL AND evidence_id IS NOT NULL").groupBy("evidence_id").agg(F.array_join(F.array_sort(F.collect_list(printed)), "|").alias("signature"))


def with_open_pairs(evidence: DataFrame, near: DataFrame) -> DataFrame:
    """Active statements and how many undecided pairs they are in."""
    sides = near.where("status = 'candidate'").select(F.explode(F.array_distinct(F.array("evidence_a", "evidence_b"))).alias("evidence_id"))
    n = sides.where("evidence_id IS NOT NULL").groupBy("evidence_id").agg(F.count(F.lit(1)).alias("open"))
    return evidence.where("status = 'active'").select("evidence_id").join(n, "evidence_id").select("evidence_id", "open")


def headings(evidence: DataFrame, body: DataFrame, ratio: float = 1.15, longest: int = 120) -> DataFrame:
    """Blocks set as headings: larger than the body of their source, or bold and short, and no list item, signal
    word or caption; with the level by numbering or size."""
    rows = evidence.where("text IS NOT NULL AND font_size IS NOT NULL").join(body.select("source_id", "body_size"), "source_id").withColumn("s", F.trim("text"))
    larger, bold = F.col("font_size") >= F.col("body_size") * ratio, F.coalesce("is_bold", F.lit(False))
    number = F.regexp_extract("s", "^([0-9]{1,2}(?:\\.[0-9]{1,2}){0,4})\\.? +[^ 0-9]", 1)
    out = (~F.length("s").between(2, longest) | (F.col("s").rlike(t.LIST_ITEM) & ~bold & ~larger) | t.signal(F.col("s")).isNotNull() | F.col("s").rlike(t.CAPTION)
           | (F.col("s").rlike("[.;,]$") & (number == "") & ~larger) | ~(larger | bold) | (~larger & (F.regexp_count("s", F.lit(" +")) > 11)))
    size = F.col("font_size") / F.col("body_size")
    level = F.when(number != "", F.least(F.lit(6), F.length(number) - F.length(F.replace(number, F.lit("."))) + 1)).when(size >= 1.5, 1).when(size >= 1.25, 2).otherwise(3)
    return rows.where(~out).select("evidence_id", level.cast(LONG).alias("level"))


def joined_lines(text: Column) -> Column:
    """Hard-wrapped lines as one: a hyphen before a small letter takes no space, any other break is one."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), "-[ \\t\\r]*\\n[ \\t\\r\\n]*([a-z])", "-$1"), "[ \\t\\r]*\\n[ \\t\\r\\n]*", " ")


def file_metadata(sources: DataFrame) -> DataFrame:
    """Title, revision, date and number that a file's name states."""
    name = F.regexp_replace(F.element_at(F.split("rel_path", "/"), -1), "\\.[A-Za-z0-9]{1,5}$", "")
    words = F.translate(name, "_", " ")
    found = lambda p: F.nullif(F.regexp_extract(words, p, 1), F.lit(""))
    return sources.where("rel_path IS NOT NULL").select(
        "source_id", words.alias("title"), found("(?i)\\brev(?:ision)?[ .:-]*([A-Z]{1,2}[0-9]{0,2}|[0-9]{1,3}(?:\\.[0-9]{1,2})?)\\b").alias("revision"),
        found("\\b([0-9]{4}-[0-9]{2}-[0-9]{2})\\b").alias("date"), found("\\b(SB-[0-9]{2,4})\\b").alias("number"))


def coverage(sources: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every source that is registered or referred to: in which of both it is, and with how many blocks."""
    blocks = evidence.where("source_id IS NOT NULL").groupBy("source_id").agg(F.count(F.lit(1)).alias("blocks"))
    both = sources.select("source_id", F.lit(True).alias("registered")).join(blocks, "source_id", "full_outer")
    state = F.when(F.col("registered").isNull(), "unregistered").when(F.col("blocks").isNull(), "empty").otherwise("both")
    return both.select("source_id", state.alias("state"), F.coalesce("blocks", F.lit(0).cast(LONG)).alias("blocks"))
