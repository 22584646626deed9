"""Queries of the register's views, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.operators import classification, duplicates, extraction, register, standing, views
from tessera.plans import sql
from tessera.plans.register_queries import _KEYED, QUERIES, SQL, ev, nd, qty, query, src
from tessera.plans.session import table
from tessera.sources import intake
from tessera.streaming import deliveries

Q = sql.quoted
LONG = "bigint"
_SAFE = "('danger', 'warning', 'caution', 'notice', 'note')"


@query("prj_15_kinds", f"SELECT evidence_id, CASE WHEN block_type IN {_SAFE} THEN 'safety' WHEN block_type = 'table' THEN 'table' WHEN block_type = 'list_item' THEN 'step' WHEN block_type = 'caption' THEN 'caption' "
       "WHEN block_type = 'heading' THEN 'heading' WHEN block_type = 'header_footer' THEN 'furniture' ELSE 'text' END AS kind FROM ev")
def prj_15(s: SparkSession, d: str) -> DataFrame:
    return ev(s, d, "block_type").select("evidence_id", views.kind(F.col("block_type")).alias("kind"))


@query("prj_14_labels", "SELECT evidence_id, CASE WHEN concat_ws(' / ', nullif(equipment, ''), nullif(model, '')) = '' THEN 'Applicability not stated' ELSE concat_ws(' / ', nullif(equipment, ''), nullif(model, '')) END AS label FROM ev")
def prj_14(s: SparkSession, d: str) -> DataFrame:
    return ev(s, d, "equipment", "model").select("evidence_id", views.applicability_label(F.col("equipment"), F.col("model")).alias("label"))


@query("prj_13_citations", "SELECT evidence_id, evidence_id || ' (' || string_split(rel_path, '/')[-1] || CASE WHEN s.revision <> '' THEN ' Rev ' || s.revision ELSE '' END || ' p.' || page_no || ')' AS label FROM ev JOIN src s ON s.source_id = ev.source_id WHERE rel_path IS NOT NULL AND page_no IS NOT NULL")
def prj_13(s: SparkSession, d: str) -> DataFrame:
    return views.cited(ev(s, d, "source_id", "page_no"), src(s, d, "rel_path", "revision"))


@query("prj_03_statements", "SELECT evidence_id, source_id FROM ev WHERE status = 'active' AND (lower(text) LIKE '%valve%' OR lower(display_text) LIKE '%valve%')")
def prj_03(s: SparkSession, d: str) -> DataFrame:
    return ev(s, d, "status", "source_id", "text", "display_text").where("status = 'active' AND (lower(text) LIKE '%valve%' OR lower(display_text) LIKE '%valve%')").select("evidence_id", "source_id")


@query("prj_11_plan", """, r AS (SELECT source_id, max(page_no) AS reached FROM ev GROUP BY 1) SELECT src.source_id, CASE WHEN present IS DISTINCT FROM 1 THEN 'skip_missing' WHEN status = 'duplicate' THEN 'skip_duplicate'
 WHEN extraction_status IN ('complete', 'complete_with_errors') THEN 'skip_done' WHEN reached < page_count THEN 'resume' ELSE 'extract' END AS action, coalesce(reached, 0)::bigint AS reached FROM src LEFT JOIN r ON r.source_id = src.source_id""")
def prj_11(s: SparkSession, d: str) -> DataFrame:
    return views.extraction_plan(src(s, d, "present", "status", "extraction_status", "page_count"), ev(s, d, "source_id", "page_no"))


_BOUND = classification.word_pattern(("hydraulic pump", "lock out", "torque wrench", "spare part", "oil change"))


@query("txt_08_keywords", f", k AS (SELECT evidence_id, lower(unnest(regexp_extract_all(text, {Q(_BOUND)}))) AS word FROM ev) SELECT evidence_id, word, count(*) AS n FROM k GROUP BY 1, 2")
def txt_08(s: SparkSession, d: str) -> DataFrame:
    found = F.explode(F.regexp_extract_all("text", F.lit(_BOUND), F.lit(0)))
    return ev(s, d, "text").where("text IS NOT NULL").select("evidence_id", found.alias("w")).groupBy("evidence_id", F.lower("w").alias("word")).agg(F.count(F.lit(1)).alias("n"))


_BODY = "z AS (SELECT source_id, round(font_size * 2) / 2 AS size, sum(length(text))::bigint AS chars FROM ev WHERE font_size IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2), body AS (SELECT source_id, arg_max(size, (chars, -size)) AS body_size FROM z GROUP BY 1)"
_SIGNAL = SQL["txt_09_signal"].split("SELECT evidence_id, ", 1)[1].rsplit(" AS result", 1)[0].replace("(text,", "(s,")
_NUMBER = "regexp_extract(s, '^([0-9]{1,2}(?:\\.[0-9]{1,2}){0,4})\\.? +[^ 0-9]', 1)"
_LARGER = "(font_size >= body_size * 1.15)"


@query("txt_11_headings", f""", {_BODY}, h AS (SELECT ev.*, body_size, trim(text) AS s FROM ev JOIN body ON body.source_id = ev.source_id WHERE text IS NOT NULL AND font_size IS NOT NULL)
SELECT evidence_id, (CASE WHEN {_NUMBER} <> '' THEN least(6, length({_NUMBER}) - length(replace({_NUMBER}, '.', '')) + 1) WHEN font_size / body_size >= 1.5 THEN 1 WHEN font_size / body_size >= 1.25 THEN 2 ELSE 3 END)::bigint AS level FROM h
WHERE length(s) BETWEEN 2 AND 120 AND NOT (regexp_matches(s, {Q(t.LIST_ITEM)}) AND NOT coalesce(is_bold, false) AND NOT {_LARGER}) AND ({_SIGNAL}) IS NULL AND NOT regexp_matches(s, {Q(t.CAPTION)})
 AND NOT (regexp_matches(s, '[.;,]$') AND {_NUMBER} = '' AND NOT {_LARGER}) AND ({_LARGER} OR coalesce(is_bold, false)) AND NOT (NOT {_LARGER} AND len(regexp_extract_all(s, ' +')) > 11)""")
def txt_11(s: SparkSession, d: str) -> DataFrame:
    rows = ev(s, d, "source_id", "text", "font_size", "is_bold")
    return views.headings(rows, register.body_font(rows))


@query("txt_13_margins", "SELECT evidence_id, bbox.y1 <= 842 * 0.07 + 2 OR bbox.y0 >= 842 - 842 * 0.07 - 2 AS in_margin FROM ev WHERE bbox IS NOT NULL")
def txt_13(s: SparkSession, d: str) -> DataFrame:
    band = 842 * 0.07
    return ev(s, d, "bbox").where("bbox IS NOT NULL").select("evidence_id", ((F.col("bbox.y1") <= band + 2) | (F.col("bbox.y0") >= 842 - band - 2)).alias("in_margin"))


@query("txt_14_joined_lines", "SELECT doc_id, md5(regexp_replace(regexp_replace(trim(text), '-[ \\t\\r]*\\n[ \\t\\r\\n]*([a-z])', '-\\1', 'g'), '[ \\t\\r]*\\n[ \\t\\r\\n]*', ' ', 'g')) AS joined FROM documents WHERE text IS NOT NULL")
def txt_14(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(views.joined_lines(F.col("text"))).alias("joined"))


@query("jon_01_last_page", "SELECT s.source_id, extraction_status, r.reached FROM src s LEFT JOIN (SELECT source_id, max(page_no)::bigint AS reached FROM ev GROUP BY 1) r ON r.source_id = s.source_id")
def jon_01(s: SparkSession, d: str) -> DataFrame:
    last = ev(s, d, "source_id", "page_no").groupBy("source_id").agg(F.max("page_no").cast(LONG).alias("reached"))
    return src(s, d, "extraction_status").join(last, "source_id", "left").select("source_id", "extraction_status", "reached")


@query("jon_04_open_pairs", ", p AS (SELECT DISTINCT pair_id, unnest([evidence_a, evidence_b]) AS evidence_id FROM nd WHERE status = 'candidate') SELECT p.evidence_id, count(*) AS open FROM p JOIN ev ON ev.evidence_id = p.evidence_id WHERE ev.status = 'active' GROUP BY 1")
def jon_04(s: SparkSession, d: str) -> DataFrame:
    return views.with_open_pairs(ev(s, d, "status"), nd(s, d, "evidence_a", "evidence_b", "status"))


@query("jon_08_without_values", "SELECT evidence_id FROM ev WHERE status = 'active' AND block_type IN ('paragraph', 'list_item', 'table') AND evidence_id NOT IN (SELECT evidence_id FROM qty WHERE evidence_id IS NOT NULL)")
def jon_08(s: SparkSession, d: str) -> DataFrame:
    rows = ev(s, d, "status", "block_type").where("status = 'active' AND block_type IN ('paragraph', 'list_item', 'table')").select("evidence_id")
    return register.without_partner(rows, qty(s, d, "evidence_id"), "evidence_id", "evidence_id")


@query("jon_09_canonical_is_active", "SELECT evidence_id FROM ev WHERE canonical_evidence_id IN (SELECT evidence_id FROM ev WHERE status = 'active')")
def jon_09(s: SparkSession, d: str) -> DataFrame:
    rows = ev(s, d, "status", "canonical_evidence_id")
    active = rows.where("status = 'active'").select(F.col("evidence_id").alias("canonical_evidence_id"))
    return rows.join(active, "canonical_evidence_id", "left_semi").select("evidence_id")


@query("agg_12_group_sizes", _KEYED + """, n AS (SELECT *, CASE WHEN block_type IN ('danger', 'warning', 'caution', 'notice') THEN row_number() OVER (PARTITION BY hash, topic, applies, source_id, block_type IN ('danger', 'warning', 'caution', 'notice') ORDER BY page_no, seq, evidence_id) ELSE 0 END AS nth FROM k),
b AS (SELECT hash, topic, applies, nth, count(*) AS members FROM n GROUP BY ALL HAVING count(*) > 1) SELECT members, count(*) AS groups FROM b GROUP BY members""")
def agg_12(s: SparkSession, d: str) -> DataFrame:
    e = ev(s, d, "source_id", "page_no", "seq", "block_type", "status", "text", "section_heading", "equipment", "model")
    groups = duplicates.exact_groups(duplicates.keyed(e, src(s, d, "is_repaired", "extraction_status")))
    return groups.where("role = 'canonical'").groupBy("members").agg(F.count(F.lit(1)).alias("groups"))


@query("agg_17_changes", ", c AS (SELECT CASE WHEN status = 'stale' THEN 'stale' WHEN status = 'candidate' THEN 'open' ELSE 'decided' END AS state, scorer FROM nd) SELECT state, scorer, count(*) AS n FROM c GROUP BY 1, 2")
def agg_17(s: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("status") == "stale", "stale").when(F.col("status") == "candidate", "open").otherwise("decided")
    return nd(s, d, "status", "scorer").groupBy(state.alias("state"), "scorer").agg(F.count(F.lit(1)).alias("n"))


@query("agg_18_statistics", "SELECT count(*) AS blocks, count(*) FILTER (block_type = 'table') AS tables, count(*) FILTER (block_type IN ('danger', 'warning', 'caution', 'notice', 'note')) AS safety, count(*) FILTER (display_text <> '') AS worded, count(DISTINCT source_id) AS sources FROM ev")
def agg_18(s: SparkSession, d: str) -> DataFrame:
    return ev(s, d, "block_type", "display_text", "source_id").agg(
        F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("block_type") == "table").alias("tables"), F.count_if(F.col("block_type").isin(*standing.ADMONITIONS)).alias("safety"),
        F.count_if(F.col("display_text") != "").alias("worded"), F.countDistinct("source_id").alias("sources"))


@query("set_06_lost_signal_words", ", w AS (SELECT evidence_id, list_distinct(regexp_extract_all(text, '\\b(?:DANGER|GEFAHR|WARNING|WARNUNG|CAUTION|VORSICHT|NOTICE|IMPORTANT|ACHTUNG|NOTE|HINWEIS)\\b')) AS a, "
       "list_distinct(regexp_extract_all(display_text, '\\b(?:DANGER|GEFAHR|WARNING|WARNUNG|CAUTION|VORSICHT|NOTICE|IMPORTANT|ACHTUNG|NOTE|HINWEIS)\\b')) AS b FROM ev WHERE display_text <> '' AND text IS NOT NULL), "
       "l AS (SELECT evidence_id, list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS l FROM w) SELECT evidence_id, array_to_string(l, ';') AS lost FROM l WHERE len(l) > 0")
def set_06(s: SparkSession, d: str) -> DataFrame:
    return views.lost_signal_words(ev(s, d, "text", "display_text"))


@query("ver_02_completeness", ", p AS (SELECT DISTINCT source_id, page_no FROM ev WHERE page_no IS NOT NULL) SELECT s.source_id, page_count, count(p.page_no) AS found, count(*) FILTER (p.page_no BETWEEN 1 AND page_count) AS within, count(*) FILTER (p.page_no > page_count) AS beyond "
       "FROM src s LEFT JOIN p ON p.source_id = s.source_id WHERE present = 1 AND page_count >= 1 GROUP BY 1, 2")
def ver_02(s: SparkSession, d: str) -> DataFrame:
    return views.completeness(src(s, d, "present", "page_count"), ev(s, d, "source_id", "page_no"))


@query("inv_02_superseded_with", ", g AS (SELECT evidence_id FROM ev WHERE status = 'superseded') SELECT 'statement' AS kind, evidence_id AS id FROM ev WHERE canonical_evidence_id <> '' AND canonical_evidence_id IN (SELECT evidence_id FROM g) "
       "UNION ALL SELECT 'pair', pair_id FROM nd WHERE evidence_a IN (SELECT evidence_id FROM g) OR evidence_b IN (SELECT evidence_id FROM g) UNION ALL SELECT 'quantity', quantity_id FROM qty WHERE evidence_id IN (SELECT evidence_id FROM g)")
def inv_02(s: SparkSession, d: str) -> DataFrame:
    return views.superseded_with(ev(s, d, "status", "canonical_evidence_id"), nd(s, d, "evidence_a", "evidence_b"), qty(s, d, "evidence_id"))


@query("unt_11_signatures", "SELECT evidence_id, array_to_string(list_sort(list(concat_ws(' ', translate(value_text, '−', '-'), unit_raw))), '|') AS signature FROM qty WHERE value_text IS NOT NULL AND evidence_id IS NOT NULL GROUP BY 1")
def unt_11(s: SparkSession, d: str) -> DataFrame:
    return views.value_signatures(qty(s, d, "evidence_id", "value_text", "unit_raw"))


@query("snk_07_evidence_export", ", q AS (SELECT evidence_id, count(*) AS n FROM qty GROUP BY 1) SELECT ev.evidence_id, rel_path, page_no, seq, block_type, left(text, 200) AS text, coalesce(q.n, 0) AS quantities FROM ev JOIN src s ON s.source_id = ev.source_id LEFT JOIN q ON q.evidence_id = ev.evidence_id")
def snk_07(s: SparkSession, d: str) -> DataFrame:
    n = qty(s, d, "evidence_id").groupBy("evidence_id").agg(F.count(F.lit(1)).alias("quantities"))
    rows = ev(s, d, "source_id", "page_no", "seq", "block_type", "text").join(src(s, d, "rel_path"), "source_id").join(n, "evidence_id", "left")
    return rows.select("evidence_id", "rel_path", "page_no", "seq", "block_type", F.substring("text", 1, 200).alias("text"), F.coalesce("quantities", F.lit(0).cast(LONG)).alias("quantities"))


_NAME = "translate(regexp_replace(string_split(rel_path, '/')[-1], '\\.[A-Za-z0-9]{1,5}$', ''), '_', ' ')"
_NAMED = lambda p: f"nullif(regexp_extract({_NAME}, '{p}', 1), '')"


@query("cls_06_file_metadata", f"SELECT source_id, {_NAME} AS title, " + _NAMED("(?i)\\brev(?:ision)?[ .:-]*([A-Z]{1,2}[0-9]{0,2}|[0-9]{1,3}(?:\\.[0-9]{1,2})?)\\b") + " AS revision, "
       + _NAMED("\\b([0-9]{4}-[0-9]{2}-[0-9]{2})\\b") + " AS date, " + _NAMED("\\b(SB-[0-9]{2,4})\\b") + " AS number FROM src WHERE rel_path IS NOT NULL")
def cls_06(s: SparkSession, d: str) -> DataFrame:
    return views.file_metadata(src(s, d, "rel_path"))


@query("jon_18_coverage", ", b AS (SELECT source_id, count(*) AS blocks FROM ev WHERE source_id IS NOT NULL GROUP BY 1) SELECT coalesce(src.source_id, b.source_id) AS source_id, CASE WHEN src.source_id IS NULL THEN 'unregistered' WHEN blocks IS NULL THEN 'empty' ELSE 'both' END AS state, "
       "coalesce(blocks, 0) AS blocks FROM src FULL OUTER JOIN b ON b.source_id = src.source_id")
def jon_18(s: SparkSession, d: str) -> DataFrame:
    return views.coverage(src(s, d, "present"), ev(s, d, "source_id"))


@query("win_02_canonical", "SELECT canonical_id, max(members) AS members, count(*) AS rows_ FROM (" + SQL["dup_01_exact_groups"] + ") GROUP BY 1")
def win_02(s: SparkSession, d: str) -> DataFrame:
    e = ev(s, d, "source_id", "page_no", "seq", "block_type", "status", "text", "section_heading", "equipment", "model")
    groups = duplicates.exact_groups(duplicates.keyed(e, src(s, d, "is_repaired", "extraction_status")))
    return groups.groupBy("canonical_id").agg(F.max("members").alias("members"), F.count(F.lit(1)).alias("rows_"))


@query("jsn_01_records", "SELECT evidence_id, to_json({'evidence_id': evidence_id, 'page_no': coalesce(page_no, 0), 'seq': coalesce(seq, 0), 'source_id': coalesce(source_id, '')})::varchar AS record FROM ev")
def jsn_01(s: SparkSession, d: str) -> DataFrame:
    fields = F.struct("evidence_id", F.coalesce("page_no", F.lit(0)).alias("page_no"), F.coalesce("seq", F.lit(0)).alias("seq"), F.coalesce("source_id", F.lit("")).alias("source_id"))
    return ev(s, d, "source_id", "page_no", "seq").select("evidence_id", F.to_json(fields).alias("record"))


@query("src_10_next_ids", ", top AS (SELECT max(try_cast(regexp_extract(source_id, '([0-9]+)$', 1) AS bigint)) AS m FROM src WHERE first_seen_at < TIMESTAMP '2025-07-01') SELECT rel_path, m + row_number() OVER (ORDER BY lower(rel_path), source_id) AS next_id FROM src, top WHERE first_seen_at >= TIMESTAMP '2025-07-01' AND rel_path IS NOT NULL")
def src_10(s: SparkSession, d: str) -> DataFrame:
    rows, cut = src(s, d, "rel_path", "first_seen_at"), F.lit("2025-07-01").cast("timestamp_ntz")
    top = rows.where(F.col("first_seen_at") < cut).agg(F.max(F.regexp_extract("source_id", "([0-9]+)$", 1).try_cast(LONG))).first()[0]
    new = rows.where((F.col("first_seen_at") >= cut) & F.col("rel_path").isNotNull()).select("source_id", "rel_path", F.lower("rel_path").alias("p"))
    return intake.numbered(new, "p", "source_id", name="next_id", first=(top or 0) + 1).select("rel_path", "next_id")


@query("str_03_once", "SELECT event_type, count(*) AS n FROM (SELECT DISTINCT event_id, event_type FROM events) GROUP BY 1")
def str_03(s: SparkSession, d: str) -> DataFrame:
    return deliveries.once(s, f"{d}/events.parquet", "event_id", "1 hour").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("str_05_pair_states", "SELECT pair_id, status FROM nd")
def str_05(s: SparkSession, d: str) -> DataFrame:
    return deliveries.upserted(s, f"{d}/near_duplicates.parquet", "pair_id", ["status"]).select("pair_id", "status")


_TYPES = ("con_01_quantity_conflicts", "con_02_dual_units", "con_04_part_numbers", "con_06_procedure_lengths", "con_07_missing_warnings", "con_08_safety_pairs")


@query("con_13_types", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n[7:]}' AS type, count(*) AS n FROM ({SQL[n]})" for n in _TYPES) + ")")
def con_13(s: SparkSession, d: str) -> DataFrame:
    parts = [QUERIES[n](s, d).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n[7:]).alias("type"), "n") for n in _TYPES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _extracted(s: SparkSession, d: str) -> DataFrame:
    return extraction.extracted(ev(s, d, "text"))


@query("unt_01_extracted")
def unt_01(s: SparkSession, d: str) -> DataFrame:
    return _extracted(s, d)


@query("unt_07_by_parameter")
def unt_07(s: SparkSession, d: str) -> DataFrame:
    return _extracted(s, d).groupBy("parameter", "canonical_unit").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("canonical_value"), 6).alias("low"), F.round(F.max("canonical_value"), 6).alias("high"))


@query("unt_08_restatements")
def unt_08(s: SparkSession, d: str) -> DataFrame:
    return extraction.restatements(_extracted(s, d))
