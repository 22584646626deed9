"""Joins, aggregates, windows, order and set operations over the register's tables.

Each operator takes tables of one row per record (see ``standing``).  Aggregates combine before the shuffle;
where a window would gather a group of any size into one task, an aggregation or a two-level running sum
stands in its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.operators.records import lookup_skewed
from tessera.operators.standing import ADMONITIONS, effective

LONG = "bigint"


def counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- joins

def with_sources(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Statements with the file they are from."""
    return evidence.join(sources.select("source_id", "rel_path", F.col("revision").alias("source_revision")), "source_id").select(
        "evidence_id", "source_id", "rel_path", "source_revision", "page_no", "seq")


def quantities_of_statements(quantities: DataFrame, evidence: DataFrame, parameters: list[str]) -> DataFrame:
    """Stated values of active statements; restated ones are left out."""
    asked = quantities.where(F.col("parameter").isin(*parameters) & F.col("canonical_value").isNotNull() & F.col("alternate_of").isNull())
    held = evidence.where((F.col("status") == "active") & (F.col("dup_role").isNull() | (F.col("dup_role") == "canonical"))).select("evidence_id", "source_id", "page_no")
    return asked.join(held, "evidence_id").select("quantity_id", "evidence_id", "source_id", "page_no", "parameter", "canonical_value")


def pairs_with_statements(near: DataFrame, evidence: DataFrame) -> DataFrame:
    """Registered pairs with both of their statements."""
    a = evidence.select(F.col("evidence_id").alias("evidence_a"), F.col("block_type").alias("type_a"), F.col("source_id").alias("source_a"))
    b = evidence.select(F.col("evidence_id").alias("evidence_b"), F.col("block_type").alias("type_b"), F.col("source_id").alias("source_b"))
    return near.join(a, "evidence_a").join(b, "evidence_b").select("pair_id", "evidence_a", "evidence_b", "type_a", "type_b", "source_a", "source_b", "score")


def without_partner(left: DataFrame, right: DataFrame, key: str, other: str) -> DataFrame:
    """Rows of the left table whose key is nowhere in the right one; a null key has no partner."""
    return left.join(right.select(F.col(other).alias(key)), key, "left_anti")


def dangling_canonicals(evidence: DataFrame) -> DataFrame:
    """Statements whose canonical statement is not active."""
    active = evidence.where(F.col("status") == "active").select(F.col("evidence_id").alias("canonical_evidence_id"))
    return evidence.where(F.col("canonical_evidence_id") != "").join(active, "canonical_evidence_id", "left_anti").select("evidence_id", "canonical_evidence_id")


def members_of_canonicals(evidence: DataFrame) -> DataFrame:
    """(canonical, members, first, last): how many statements a canonical one stands for."""
    named = evidence.where(F.col("canonical_evidence_id") != "").groupBy("canonical_evidence_id").agg(
        F.count(F.lit(1)).alias("members"), F.min("evidence_id").alias("first_member"), F.max("evidence_id").alias("last_member"))
    return named.join(evidence.select(F.col("evidence_id").alias("canonical_evidence_id")), "canonical_evidence_id", "left_semi")


def missing_pages(sources: DataFrame, evidence: DataFrame) -> DataFrame:
    """Pages from 1 to the page count of present sources of which nothing was extracted."""
    expected = sources.where((F.col("present") == 1) & (F.col("page_count") >= 1)).select("source_id", F.explode(F.sequence(F.lit(1), F.col("page_count"))).alias("page_no"))
    return expected.join(evidence.select("source_id", "page_no").distinct(), ["source_id", "page_no"], "left_anti")


def same_file_elsewhere(sources: DataFrame, evidence: DataFrame) -> DataFrame:
    """Citations of statements in files identical to theirs: a statement of the primary with each duplicate's path."""
    copies = sources.where(F.col("duplicate_of") != "").select(F.col("duplicate_of").alias("source_id"), F.col("source_id").alias("copy_id"), F.col("rel_path").alias("copy_path"))
    return evidence.select("evidence_id", "source_id").join(copies, "source_id").select("evidence_id", "copy_id", "copy_path")


def compatible(a_equipment: Column, a_model: Column, b_equipment: Column, b_model: Column) -> Column:
    """How two applicabilities relate: different equipment or models are never compared, a missing one fits all."""
    ea, eb, ma, mb = (F.coalesce(t.several(c), F.array().cast("array<string>")) for c in (a_equipment, b_equipment, a_model, b_model))
    both = lambda x, y: (F.size(x) > 0) & (F.size(y) > 0)
    return (F.when(both(ea, eb) & ~F.arrays_overlap(ea, eb), "different_equipment").when(both(ma, mb) & F.arrays_overlap(ma, mb), "same_model")
            .when(both(ma, mb), "different_model").when((F.size(ma) > 0) | (F.size(mb) > 0), "model_unspecified_on_one_side").otherwise("model_unspecified"))


def relations_of_pairs(near: DataFrame, evidence: DataFrame) -> DataFrame:
    """Registered pairs and how the applicabilities of their statements relate."""
    a = evidence.select(F.col("evidence_id").alias("evidence_a"), F.col("equipment").alias("ea"), F.col("model").alias("ma"))
    b = evidence.select(F.col("evidence_id").alias("evidence_b"), F.col("equipment").alias("eb"), F.col("model").alias("mb"))
    return near.select("pair_id", "evidence_a", "evidence_b").join(a, "evidence_a").join(b, "evidence_b").select(
        "pair_id", compatible(F.col("ea"), F.col("ma"), F.col("eb"), F.col("mb")).alias("relation"))


def overlapping_boxes(evidence: DataFrame, share: float = 0.4) -> DataFrame:
    """Pairs of blocks on one page of which one covers more than ``share`` of the other's area.

    A page holds few blocks; pages are the join key, and boxes the residual condition."""
    area = (F.col("bbox.x1") - F.col("bbox.x0")) * (F.col("bbox.y1") - F.col("bbox.y0"))
    boxed = evidence.where(F.col("bbox").isNotNull() & (area > 0)).select("source_id", "page_no", "evidence_id", "bbox", area.alias("area"))
    a, b = boxed.alias("a"), boxed.alias("b")
    wide = F.least("a.bbox.x1", "b.bbox.x1") - F.greatest("a.bbox.x0", "b.bbox.x0")
    high = F.least("a.bbox.y1", "b.bbox.y1") - F.greatest("a.bbox.y0", "b.bbox.y0")
    met = a.join(b, (F.col("a.source_id") == F.col("b.source_id")) & (F.col("a.page_no") == F.col("b.page_no")) & (F.col("a.evidence_id") < F.col("b.evidence_id"))
                 & (wide > 0) & (high > 0) & (wide * high > share * F.least("a.area", "b.area")))
    return met.select(F.col("a.evidence_id").alias("evidence_a"), F.col("b.evidence_id").alias("evidence_b"),
                      F.round(wide * high / F.least("a.area", "b.area"), 6).alias("covered"))


def nearest_caption(evidence: DataFrame) -> DataFrame:
    """The caption nearest below or above each table of a page, by the gap between the boxes."""
    cap = evidence.where((F.col("block_type") == "caption") & F.col("bbox").isNotNull()).select("source_id", "page_no", F.col("evidence_id").alias("caption_id"), F.col("bbox").alias("c"))
    tables = evidence.where((F.col("block_type") == "table") & F.col("bbox").isNotNull()).select("source_id", "page_no", "evidence_id", "bbox")
    gap = F.greatest(F.col("c.y0") - F.col("bbox.y1"), F.col("bbox.y0") - F.col("c.y1"))
    return (tables.join(cap, ["source_id", "page_no"]).where((F.least("bbox.x1", "c.x1") > F.greatest("bbox.x0", "c.x0")) & (gap >= -2))
            .groupBy("evidence_id").agg(F.min_by("caption_id", F.struct(gap.alias("gap"), F.col("caption_id"))).alias("caption_id"), F.round(F.min(gap), 6).alias("gap")))


def lifecycle(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """(key, change): what a new detection makes of earlier ones: new, kept, reopened or stale."""
    both = before.select(key, F.col("status").alias("was")).join(now.select(key, F.lit(True).alias("seen")), key, "full_outer")
    change = (F.when(F.col("was").isNull(), "new").when(F.col("seen") & (F.col("was") == "stale"), "reopened").when(F.col("seen"), "kept")
              .when(F.col("was") == "candidate", "stale").otherwise("kept"))
    return both.select(key, change.alias("change"))


# ---------------------------------------------------------------- aggregates

def dashboard(evidence: DataFrame, sources: DataFrame, near: DataFrame) -> DataFrame:
    """Grouped counts of all registers in long form (section, value, n)."""
    part = lambda df, name, c: df.groupBy(F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("section"), "value", "n")
    parts = [part(sources, "sources", "status"), part(sources, "extraction", "extraction_status"), part(evidence, "statements", "status"),
             part(evidence, "review", "review_status"), part(evidence, "blocks", "block_type"), part(near, "near_duplicates", "status")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ocr_statistics(evidence: DataFrame) -> DataFrame:
    """Per extraction method: blocks, with a confidence, mean, least and those under 60."""
    return evidence.groupBy("extraction_method").agg(
        F.count(F.lit(1)).alias("blocks"), F.count("ocr_confidence").alias("with_confidence"), F.round(F.avg("ocr_confidence"), 6).alias("mean_confidence"),
        F.min("ocr_confidence").alias("least_confidence"), F.count_if(F.col("ocr_confidence") < 60).alias("low"))


def latest_of_each(df: DataFrame, group: str, order: str, key: str) -> DataFrame:
    """The key of the row with the greatest (order, key) in each group."""
    return df.groupBy(group).agg(F.max_by(key, F.struct(order, key)).alias(key), F.max(order).alias(order))


def extraction_outcome(evidence: DataFrame) -> DataFrame:
    """Per source: failed if every block failed, complete with errors if some are not active, else complete."""
    return evidence.groupBy("source_id").agg(F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("status") != "active").alias("not_active")).select(
        "source_id", "blocks", "not_active",
        F.when(F.col("blocks") == F.col("not_active"), "failed").when(F.col("not_active") > 0, "complete_with_errors").otherwise("complete").alias("outcome"))


def body_font(evidence: DataFrame) -> DataFrame:
    """Per source the font size, rounded to half points, in which most characters are set; the smaller of equals."""
    sized = evidence.where(F.col("font_size").isNotNull() & F.col("text").isNotNull()).groupBy("source_id", (F.round(F.col("font_size") * 2) / 2).alias("size")).agg(F.sum(F.length("text")).alias("chars"))
    return sized.groupBy("source_id").agg(F.max_by("size", F.struct("chars", -F.col("size"))).alias("body_size"), F.sum("chars").alias("chars"))


def repeated_templates(evidence: DataFrame, share: float = 0.3, least: int = 3) -> DataFrame:
    """Texts, digits aside, that stand on at least three pages and three tenths of the pages of a source."""
    shaped = evidence.where(F.col("text").isNotNull()).select("source_id", "page_no", t.template(F.col("text")).alias("template")).where("template != ''")
    pages = shaped.groupBy("source_id").agg(F.countDistinct("page_no").alias("pages"))
    found = shaped.groupBy("source_id", "template").agg(F.countDistinct("page_no").alias("on_pages"))
    return found.join(pages, "source_id").where(F.col("on_pages") >= F.greatest(F.lit(least), F.ceil(F.lit(share) * F.col("pages")))).select("source_id", "template", "on_pages", "pages")


def weighted_means(evidence: DataFrame) -> DataFrame:
    """Per source, means weighted by characters."""
    n = F.length("text")
    mean = lambda c: F.round(F.try_divide(F.sum(F.when(F.col(c).isNotNull(), F.col(c) * n)), F.sum(F.when(F.col(c).isNotNull(), n))), 6)
    return evidence.where(F.col("text") != "").groupBy("source_id").agg(mean("font_size").alias("font_size"), mean("ocr_confidence").alias("ocr_confidence"))


def page_boxes(evidence: DataFrame) -> DataFrame:
    """The box around all blocks of a page."""
    edge = {"x0": F.min, "y0": F.min, "x1": F.max, "y1": F.max}
    return evidence.where(F.col("bbox").isNotNull()).groupBy("source_id", "page_no").agg(*[f(f"bbox.{c}").alias(c) for c, f in edge.items()])


def first_seen_values(evidence: DataFrame, column: str) -> DataFrame:
    """Per source the distinct values of a column in reading order, as one string."""
    first = evidence.where(F.col(column).isNotNull()).groupBy("source_id", column).agg(F.min(F.struct("page_no", "seq", "evidence_id")).alias("at"))
    return first.groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", column))), lambda x: x[column]), "; ").alias("listed"), F.count(F.lit(1)).alias("n"))


def rolled_up(sources: DataFrame, evidence: DataFrame) -> DataFrame:
    """Worst outcome per kind of check: FAIL before WARN before PASS, SKIP where nothing was checked."""
    checks = (sources.select(F.lit("present").alias("kind"), F.when(F.col("present") == 1, 0).otherwise(2).alias("bad"))
              .unionByName(sources.select(F.lit("extracted").alias("kind"), F.when(F.col("extraction_status") == "complete", 0).when(F.col("extraction_status") == "failed", 2).otherwise(1).alias("bad")))
              .unionByName(evidence.select(F.lit("has_text").alias("kind"), F.when(F.coalesce(F.col("text"), F.lit("")) != "", 0).otherwise(1).alias("bad"))))
    kinds = sources.sparkSession.createDataFrame([("present",), ("extracted",), ("has_text",), ("signed",)], "kind string")
    worst = checks.groupBy("kind").agg(F.max("bad").alias("bad"), F.count(F.lit(1)).alias("checked"))
    name = F.when(F.col("bad").isNull(), "SKIP").when(F.col("bad") == 2, "FAIL").when(F.col("bad") == 1, "WARN").otherwise("PASS")
    return F.broadcast(kinds).join(worst, "kind", "left").select("kind", name.alias("outcome"), F.coalesce("checked", F.lit(0).cast(LONG)).alias("checked"))


def changed_numbers(evidence: DataFrame) -> DataFrame:
    """Statements whose reviewed wording has other numbers than their text, as bags."""
    both = evidence.where((F.col("display_text") != "") & F.col("text").isNotNull()).select(
        "evidence_id", t.numeric_tokens(F.col("text")).alias("stated"), t.numeric_tokens(F.col("display_text")).alias("worded"))
    return both.where(F.col("stated") != F.col("worded")).select("evidence_id", F.array_join("stated", " ").alias("stated"), F.array_join("worded", " ").alias("worded"))


# ---------------------------------------------------------------- windows

def numbered_over_pages(df: DataFrame, *keys: str) -> DataFrame:
    """Adds ``nth``, the place of each row among those of its keys in reading order.

    Rows are numbered within their page, and pages by running sums over one row per page, so that keys with any
    number of rows are spread over their pages."""
    page = [*keys, "source_id", "page_no"]
    within = Window.partitionBy(*page).orderBy("seq", "evidence_id")
    per_page = df.groupBy(*page).agg(F.count(F.lit(1)).alias("_on_page"))
    before = F.sum("_on_page").over(Window.partitionBy(*keys, "source_id").orderBy("page_no")) - F.col("_on_page")
    sums = per_page.withColumn("_before", before).drop("_on_page")
    numbered = df.withColumn("_within", F.row_number().over(within))
    return numbered.join(sums.select(*[F.col(c).alias(f"_{c}") for c in page], "_before"), [numbered[c].eqNullSafe(F.col(f"_{c}")) for c in page]).withColumn(
        "nth", (F.col("_within") + F.col("_before")).cast(LONG)).drop("_within", "_before", *[f"_{c}" for c in page])


def occurrences(evidence: DataFrame) -> DataFrame:
    """Safety statements and how often their text stood in the source before, in reading order."""
    rows = evidence.where(F.col("block_type").isin(*ADMONITIONS) & F.col("text").isNotNull()).select("evidence_id", "source_id", "page_no", "seq", F.sha2("text", 256).alias("hash"))
    return numbered_over_pages(rows, "hash").select("evidence_id", F.col("nth").alias("occurrence"))


def primary_files(sources: DataFrame) -> DataFrame:
    """Files with the same content: the first registered one, then the one nearest to the root, is the primary."""
    here = sources.where((F.col("present") == 1) & (F.col("sha256") != "")).withColumn("depth", F.length("rel_path") - F.length(F.replace(F.col("rel_path"), F.lit("/"))))
    best = here.groupBy("sha256").agg(F.min_by("source_id", F.struct("first_seen_at", "depth", "rel_path", "source_id")).alias("primary_id"), F.count(F.lit(1)).alias("files")).where("files > 1")
    return here.join(best, "sha256").select("source_id", "primary_id", (F.col("source_id") == F.col("primary_id")).alias("is_primary"))


def reading_order(evidence: DataFrame) -> DataFrame:
    """Number of each block within its page: by column, height and place."""
    w = Window.partitionBy("source_id", "page_no").orderBy(F.coalesce("column_index", F.lit(0)), F.col("bbox.y0").asc_nulls_last(), F.col("bbox.x0").asc_nulls_last(), "seq", "evidence_id")
    return evidence.where(F.col("page_no").isNotNull()).select("evidence_id", F.row_number().over(w).cast(LONG).alias("place"))


def section_paths(evidence: DataFrame) -> DataFrame:
    """Headings with the path of headings above them, as (level 1 > level 2 > ...).

    Pages are summed first: for each page the last heading of each level, carried over pages by a window of one
    row per page; within a page a second window carries on.  A source of any length is thus split by its pages."""
    head = evidence.where((F.col("block_type") == "heading") & F.col("heading_level").between(1, 6) & F.col("text").isNotNull()).select(
        "source_id", "page_no", "seq", "evidence_id", "heading_level", F.substring(t.collapse(F.col("text")), 1, 200).alias("title"))
    place = F.struct("page_no", "seq", "evidence_id")
    within = Window.partitionBy("source_id", "page_no").orderBy("seq", "evidence_id").rowsBetween(Window.unboundedPreceding, 0)
    over = Window.partitionBy("source_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    at = lambda k: F.when(F.col("heading_level") == k, F.struct(place.alias("at"), F.col("title")))
    per_page = head.groupBy("source_id", "page_no").agg(*[F.max(at(k)).alias(f"p{k}") for k in range(1, 7)])
    carried = per_page.select("source_id", "page_no", *[F.max(f"p{k}").over(over).alias(f"c{k}") for k in range(1, 7)])
    held = head.join(carried, ["source_id", "page_no"]).select("*", *[F.max(at(k)).over(within).alias(f"w{k}") for k in range(1, 7)])
    last = [F.coalesce(f"w{k}", f"c{k}") for k in range(1, 7)]
    shown = []
    for k in range(1, 7):
        # A heading stands until one of the same or a higher level comes.
        above = [F.coalesce(last[j]["at"] < last[k - 1]["at"], F.lit(True)) for j in range(k - 1)]
        stands = last[k - 1].isNotNull()
        for c in above:
            stands = stands & c
        shown.append(F.when(stands & (F.lit(k) <= F.col("heading_level")), last[k - 1]["title"]))
    return held.select("evidence_id", F.array_join(F.array_compact(F.array(*shown)), " > ").alias("path"))


def bands(evidence: DataFrame) -> DataFrame:
    """Blocks of pages in two columns: a block over the full width ends a band."""
    w = Window.partitionBy("source_id", "page_no").orderBy("seq", "evidence_id").rowsBetween(Window.unboundedPreceding, 0)
    full = (F.col("bbox.x1") - F.col("bbox.x0") > 400).cast("int")
    return evidence.where(F.col("bbox").isNotNull() & F.col("page_no").isNotNull()).select("evidence_id", F.sum(full).over(w).cast(LONG).alias("band"))


def restated(quantities: DataFrame) -> DataFrame:
    """Neighbouring values of a statement with nothing but a bracket or a slash between them: (quantity, restates)."""
    w = Window.partitionBy("evidence_id").orderBy("char_start", "char_end", "quantity_id")
    near = quantities.where(F.col("char_start").isNotNull() & F.col("char_end").isNotNull()).select(
        "quantity_id", F.lag("quantity_id").over(w).alias("restates"), (F.col("char_start") - F.lag("char_end").over(w)).alias("gap"))
    return near.where((F.col("gap") >= 0) & (F.col("gap") <= 3)).select("quantity_id", "restates", F.col("gap").cast(LONG).alias("gap"))


def label_changes(evidence: DataFrame) -> DataFrame:
    """Blocks with which the section heading of a source changes, in reading order.

    What stood last on earlier pages comes from one row per page, the rest from a window over the page."""
    page = ["source_id", "page_no"]
    rows = evidence.where(F.col("source_id").isNotNull() & F.col("page_no").isNotNull()).select("evidence_id", *page, "seq", "section_heading")
    at = F.struct("seq", "evidence_id")
    last = rows.groupBy(*page).agg(F.max_by(F.struct("section_heading"), at).alias("last"))
    before = last.select(*page, F.lag("last").over(Window.partitionBy("source_id").orderBy("page_no")).alias("before"))
    here = F.lag(F.struct("section_heading")).over(Window.partitionBy(*page).orderBy("seq", "evidence_id"))
    met = rows.withColumn("here", here).join(before, page).withColumn("was", F.coalesce("here", "before")["section_heading"])
    return met.where(~F.col("section_heading").eqNullSafe(F.col("was"))).select("evidence_id", "section_heading", "was")


# ---------------------------------------------------------------- order and top rows

def top_pairs(near: DataFrame, k: int) -> DataFrame:
    """The k candidate pairs with the highest score, both scales in percent."""
    percent = F.when(F.col("scorer") == "ratio", F.col("score") * 100).otherwise(F.col("score"))
    return near.where((F.col("status") == "candidate") & F.col("score").isNotNull()).select("pair_id", F.round(percent, 4).alias("percent")).orderBy(F.desc("percent"), "pair_id").limit(k)


def ranked_components(evidence: DataFrame) -> DataFrame:
    """Per equipment its components by number of statements, with their rank and the runner-up's distance."""
    n = evidence.where(F.col("equipment").isNotNull() & F.col("component").isNotNull()).groupBy("equipment", "component").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("equipment").orderBy(F.desc("n"), "component")
    return n.select("equipment", "component", "n", F.row_number().over(w).cast(LONG).alias("place"), (F.col("n") - F.lead("n").over(w)).alias("ahead"))


def work_list(sources: DataFrame, k: int) -> DataFrame:
    """The k sources to extract next: interrupted ones first, then new ones, by path."""
    order = F.when(F.col("extraction_status") == "partial", 0).otherwise(1)
    return sources.where((F.col("present") == 1) & F.col("extraction_status").isin("pending", "partial")).select(
        "source_id", order.cast(LONG).alias("turn"), F.lower("rel_path").alias("path")).orderBy("turn", "path", "source_id").limit(k)


# ---------------------------------------------------------------- sets

def not_in(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of the left table that are not in the right one."""
    return left.exceptAll(right).distinct()


def models_in_common(near: DataFrame, evidence: DataFrame) -> DataFrame:
    """Pairs with the models both statements apply to."""
    side = lambda e, m: evidence.select(F.col("evidence_id").alias(e), t.several(F.col("model")).alias(m))
    both = near.select("pair_id", "evidence_a", "evidence_b").join(side("evidence_a", "ma"), "evidence_a").join(side("evidence_b", "mb"), "evidence_b")
    return both.where(F.arrays_overlap("ma", "mb")).select("pair_id", F.array_join(F.array_sort(F.array_intersect("ma", "mb")), "; ").alias("models"))


def effective_texts(evidence: DataFrame) -> DataFrame:
    """What is shown of a statement, and whether that is a reviewer's wording."""
    return evidence.select("evidence_id", effective("display_text", "text").alias("shown"), (F.coalesce(F.col("display_text"), F.lit("")) != "").alias("worded"))


def hot_lookup(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Blocks with their source's model, where one source may hold a third of all blocks."""
    n = evidence.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    table = sources.select("source_id", "model").join(n, "source_id")
    total = evidence.count()
    return lookup_skewed(evidence.select("evidence_id", "source_id"), table.select("source_id", F.col("model").alias("source_model"), "n"), "source_id", F.col("n"), total).select("evidence_id", "source_model")
