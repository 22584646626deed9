"""Queries of the register's operators over the standing records, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.operators import duplicates, register, standing
from tessera.plans import sql
from tessera.plans.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
LONG = "bigint"


def query(name: str, statement: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if statement:
            SQL[name] = f"WITH {sql.STANDING}{statement if statement.startswith(',') else ' ' + statement}"
        return f

    return add


def ev(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return standing.evidence(table(s, d, "evidence"), *columns)


def src(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return standing.sources(table(s, d, "sources"), *columns)


def nd(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return standing.near(table(s, d, "near_duplicates"), *columns)


def qty(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return standing.quantities(table(s, d, "quantities"), *columns)


# ---------------------------------------------------------------- text functions

def _text(name: str, column: Callable, statement: str, of: str = "text") -> None:
    @query(name, f"SELECT evidence_id, {statement} AS result FROM ev WHERE {of} IS NOT NULL")
    def run(s: SparkSession, d: str) -> DataFrame:
        return ev(s, d, of).where(F.col(of).isNotNull()).select("evidence_id", column(F.col(of)).alias("result"))


_text("txt_01_normalised", t.normalised, sql.normalised("text"))
_text("txt_02_norm_hash", t.norm_hash, f"sha256({sql.normalised('text')})")
_text("txt_03_collapsed", t.collapse, sql.collapse("text"))
_text("txt_05_squashed", t.squash, f"regexp_replace(text, '{sql.SPACE}+', '', 'g')")
_text("txt_06_template", t.template, sql.collapse("regexp_replace(lower(text), '[0-9]+', '#', 'g')"))
_text("txt_07_topic", t.topic, sql.topic("section_heading"), "section_heading")
_LEVELS = "CASE upper({0}) " + " ".join(f"WHEN '{w}' THEN '{v}'" for w, v in t.SIGNALS.items()) + " END"
_WORDS = "|".join(sorted(t.SIGNALS, key=lambda w: (-len(w), w)))
_text("txt_09_signal", t.signal, "CASE WHEN regexp_extract(text, '^{0}*({1})(?:[^0-9A-Za-z_]|$)', 1) <> '' THEN {2} ELSE {3} END".format(
    sql.SPACE, _WORDS, _LEVELS.format(f"regexp_extract(text, '^{sql.SPACE}*({_WORDS})(?:[^0-9A-Za-z_]|$)', 1)"),
    _LEVELS.format(f"regexp_extract(text, '(?i)^{sql.SPACE}*({_WORDS}){sql.SPACE}*:', 1)")))
_text("txt_10_pattern_kind", t.pattern_kind, "CASE " + " ".join(
    f"WHEN regexp_matches(text, {sql.quoted(p)}) THEN '{n}'" for p, n in ((t.PAGE_NUMBER, "page_number"), (t.CAPTION, "caption"), (t.BLANK_PAGE, "blank_notice"), (t.LIST_ITEM, "list_item"))).replace(
    "\\\\", "\\") + " END")
_text("txt_18_safe_name", t.safe_name, "CASE WHEN regexp_replace(regexp_replace(text, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') = '' THEN 'file' "
      "ELSE left(regexp_replace(regexp_replace(text, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), 80) END")
_text("txt_20_escaped", t.escaped, "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')")
_text("hsh_01_sha256", lambda c: F.sha2(c, 256), "sha256(text)")
_text("snk_05_cells", lambda c: t.cell(c, 60), "(SELECT CASE WHEN length(s) > 60 THEN left(s, 45) || ' ...[truncated]' ELSE s END FROM (SELECT CASE WHEN left(p, 1) IN ('=', '+', '@', '-') THEN '''' || p ELSE p END AS s "
      "FROM (SELECT regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g') AS p)))")


@query("txt_04_numeric_tokens")
def txt_04(s: SparkSession, d: str) -> DataFrame:
    return ev(s, d, "text").where(F.col("text").isNotNull()).select("evidence_id", F.array_join(t.numeric_tokens(F.col("text")), " ").alias("result"))


@query("txt_15_quality")
def txt_15(s: SparkSession, d: str) -> DataFrame:
    q = ev(s, d, "text").select("evidence_id", "text", t.quality(F.col("text")).alias("score"))
    return q.where(F.col("text").isNotNull()).select("evidence_id", "score", ((F.length(F.trim("text")) >= 20) & (F.col("score") < 0.45)).alias("gibberish"))


@query("txt_17_table_text", "SELECT evidence_id, array_to_string(list_transform(table_cells, lambda r: array_to_string(list_transform(r, lambda c: coalesce(c, '')), ' | ')), chr(10)) AS result "
       "FROM ev WHERE table_cells IS NOT NULL")
def txt_17(s: SparkSession, d: str) -> DataFrame:
    return ev(s, d, "table_cells").where(F.col("table_cells").isNotNull()).select("evidence_id", t.table_text(F.col("table_cells")).alias("result"))


@query("txt_19_id_parts", "SELECT evidence_id, regexp_extract(evidence_id, '^EV-(.+)-P([0-9]+)-([0-9]+)-([^-]+)$', 1) AS source, "
       "try_cast(regexp_extract(evidence_id, '^EV-(.+)-P([0-9]+)-([0-9]+)-([^-]+)$', 2) AS bigint) AS page, try_cast(regexp_extract(evidence_id, '^EV-(.+)-P([0-9]+)-([0-9]+)-([^-]+)$', 3) AS bigint) AS place, "
       "regexp_extract(evidence_id, '^EV-(.+)-P([0-9]+)-([0-9]+)-([^-]+)$', 4) AS digest FROM ev")
def txt_19(s: SparkSession, d: str) -> DataFrame:
    part = lambda i: F.regexp_extract("evidence_id", "^EV-(.+)-P([0-9]+)-([0-9]+)-([^-]+)$", i)
    return ev(s, d, "status").select("evidence_id", part(1).alias("source"), part(2).try_cast(LONG).alias("page"), part(3).try_cast(LONG).alias("place"), part(4).alias("digest"))


_MONTH = "CASE left(lower(regexp_extract(s, '([A-Za-z]+)', 1)), 3) " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(t.MONTHS, 1)) + " END"
_IS_MONTH = "lower(regexp_extract(s, '([A-Za-z]+)', 1)) IN (" + ", ".join(f"'{m}'" for m in (*t.MONTHS, *t.LONG_MONTHS)) + ")"


def _iso(y: str, m: str, d: str) -> str:
    return f"coalesce(strftime(try_cast(lpad(({y})::varchar, 4, '0') || '-' || lpad(({m})::varchar, 2, '0') || '-' || lpad(({d})::varchar, 2, '0') AS date), '%Y-%m-%d'), s)"


def _bad(y: str, m: str, d: str) -> str:
    return f"try_cast(lpad(({y})::varchar, 4, '0') || '-' || lpad(({m})::varchar, 2, '0') || '-' || lpad(({d})::varchar, 2, '0') AS date) IS NULL"


_P = {k: "'" + v + "'" for k, v in {"iso": "^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})$", "num": "^([0-9]{1,2})[./]([0-9]{1,2})[./]([0-9]{4})$", "dmy": "^([0-9]{1,2}) +([A-Za-z]+)\\.? +([0-9]{4})$",
                                    "mdy": "^([A-Za-z]+)\\.? +([0-9]{1,2}),? +([0-9]{4})$", "my": "^([A-Za-z]+)\\.? +([0-9]{4})$"}.items()}
_X = lambda p, i: f"regexp_extract(s, {_P[p]}, {i})"
_N = lambda i: f"try_cast({_X('num', i)} AS int)"


@query("dat_01_dates", f""", raw AS (SELECT source_id, trim(doc_date) AS s FROM src WHERE doc_date IS NOT NULL)
SELECT source_id, CASE WHEN regexp_matches(s, {_P['iso']}) THEN {_iso(_X('iso', 1), _X('iso', 2), _X('iso', 3))}
  WHEN regexp_matches(s, {_P['num']}) AND {_N(1)} > 12 AND {_N(2)} <= 12 THEN {_iso(_X('num', 3), _N(2), _N(1))}
  WHEN regexp_matches(s, {_P['num']}) AND {_N(2)} > 12 AND {_N(1)} <= 12 THEN {_iso(_X('num', 3), _N(1), _N(2))}
  WHEN regexp_matches(s, {_P['num']}) AND contains(s, '.') THEN {_iso(_X('num', 3), _N(2), _N(1))}
  WHEN regexp_matches(s, {_P['num']}) THEN s
  WHEN regexp_matches(s, {_P['dmy']}) AND {_IS_MONTH} THEN {_iso(_X('dmy', 3), _MONTH, _X('dmy', 1))}
  WHEN regexp_matches(s, {_P['mdy']}) AND {_IS_MONTH} THEN {_iso(_X('mdy', 3), _MONTH, _X('mdy', 2))}
  WHEN regexp_matches(s, {_P['my']}) AND {_IS_MONTH} THEN {_X('my', 2)} || '-' || lpad(({_MONTH})::varchar, 2, '0') ELSE s END AS value,
 CASE WHEN regexp_matches(s, {_P['iso']}) THEN {_bad(_X('iso', 1), _X('iso', 2), _X('iso', 3))}
  WHEN regexp_matches(s, {_P['num']}) AND {_N(1)} > 12 AND {_N(2)} <= 12 THEN {_bad(_X('num', 3), _N(2), _N(1))}
  WHEN regexp_matches(s, {_P['num']}) AND {_N(2)} > 12 AND {_N(1)} <= 12 THEN {_bad(_X('num', 3), _N(1), _N(2))}
  WHEN regexp_matches(s, {_P['num']}) THEN {_N(1)} <> {_N(2)}
  WHEN regexp_matches(s, {_P['dmy']}) AND {_IS_MONTH} THEN {_bad(_X('dmy', 3), _MONTH, _X('dmy', 1))}
  WHEN regexp_matches(s, {_P['mdy']}) AND {_IS_MONTH} THEN {_bad(_X('mdy', 3), _MONTH, _X('mdy', 2))} ELSE false END AS ambiguous FROM raw""")
def dat_01(s: SparkSession, d: str) -> DataFrame:
    return src(s, d, "doc_date").where(F.col("doc_date").isNotNull()).select("source_id", t.normalised_date(F.col("doc_date")).alias("x")).select("source_id", "x.value", "x.ambiguous")


_FR = "'^(?:([0-9]+) +)?([0-9]+)/([0-9]+)$'"


@query("num_01_numbers", f""", raw AS (SELECT quantity_id, trim(translate(value_text, chr(8239) || chr(160), '')) AS s FROM qty WHERE value_text IS NOT NULL)
SELECT quantity_id, round(CASE WHEN contains(s, '/') THEN CASE WHEN regexp_matches(s, {_FR}) AND regexp_extract(s, {_FR}, 3)::double <> 0 THEN coalesce(try_cast(regexp_extract(s, {_FR}, 1) AS double), 0) + regexp_extract(s, {_FR}, 2)::double / regexp_extract(s, {_FR}, 3)::double END
  WHEN regexp_matches(s, '^[0-9]{{1,3}}(?:,[0-9]{{3}})+(?:\\.[0-9]+)?$') THEN try_cast(replace(s, ',', '') AS double)
  WHEN regexp_matches(s, '^[0-9]+,[0-9]+$') THEN try_cast(replace(s, ',', '.') AS double)
  WHEN regexp_matches(s, '^-?[0-9]*\\.?[0-9]+$|^-?[0-9]+\\.$') THEN try_cast(s AS double) END, 6) AS number FROM raw""")
def num_01(s: SparkSession, d: str) -> DataFrame:
    return qty(s, d, "value_text").where(F.col("value_text").isNotNull()).select("quantity_id", F.round(t.parsed_number(F.col("value_text")), 6).alias("number"))


@query("num_02_intervals", "SELECT quantity_id, least(coalesce(value_min, value), coalesce(value_max, value)) AS low, greatest(coalesce(value_min, value), coalesce(value_max, value)) AS high FROM qty "
       "WHERE coalesce(value_min, value) IS NOT NULL AND coalesce(value_max, value) IS NOT NULL")
def num_02(s: SparkSession, d: str) -> DataFrame:
    lo, hi = F.coalesce("value_min", "value"), F.coalesce("value_max", "value")
    return qty(s, d, "value", "value_min", "value_max").where(lo.isNotNull() & hi.isNotNull()).select("quantity_id", F.least(lo, hi).alias("low"), F.greatest(lo, hi).alias("high"))


@query("num_03_areas", "SELECT evidence_id, round(greatest(0, bbox.x1 - bbox.x0) * greatest(0, bbox.y1 - bbox.y0), 4) AS area, round((bbox.x0 + bbox.x1) / 2, 4) AS cx, round((bbox.y0 + bbox.y1) / 2, 4) AS cy FROM ev WHERE bbox IS NOT NULL")
def num_03(s: SparkSession, d: str) -> DataFrame:
    side = lambda a, b: F.greatest(F.lit(0.0), F.col(f"bbox.{b}") - F.col(f"bbox.{a}"))
    return ev(s, d, "bbox").where("bbox IS NOT NULL").select("evidence_id", F.round(side("x0", "x1") * side("y0", "y1"), 4).alias("area"),
                                                            F.round((F.col("bbox.x0") + F.col("bbox.x1")) / 2, 4).alias("cx"), F.round((F.col("bbox.y0") + F.col("bbox.y1")) / 2, 4).alias("cy"))


@query("arr_01_models", f"SELECT source_id, array_to_string({sql.several('model')}, '|') AS models, len({sql.several('model')}) AS n FROM src WHERE model IS NOT NULL")
def arr_01(s: SparkSession, d: str) -> DataFrame:
    return src(s, d, "model").where("model IS NOT NULL").select("source_id", F.array_join(t.several(F.col("model")), "|").alias("models"), F.size(t.several(F.col("model"))).cast(LONG).alias("n"))


# ---------------------------------------------------------------- joins

@query("jon_02_stated_values", "SELECT quantity_id, q.evidence_id, e.source_id, e.page_no, parameter, canonical_value FROM qty q JOIN ev e ON e.evidence_id = q.evidence_id "
       "WHERE parameter IN ('torque', 'pressure', 'temperature') AND canonical_value IS NOT NULL AND alternate_of IS NULL AND e.status = 'active' AND (dup_role IS NULL OR dup_role = 'canonical')")
def jon_02(s: SparkSession, d: str) -> DataFrame:
    return register.quantities_of_statements(qty(s, d, "evidence_id", "parameter", "canonical_value", "alternate_of"), ev(s, d, "status", "dup_role", "source_id", "page_no"), ["torque", "pressure", "temperature"])


@query("jon_03_pairs", "SELECT pair_id, evidence_a, evidence_b, a.block_type AS type_a, b.block_type AS type_b, a.source_id AS source_a, b.source_id AS source_b, score FROM nd JOIN ev a ON a.evidence_id = evidence_a JOIN ev b ON b.evidence_id = evidence_b")
def jon_03(s: SparkSession, d: str) -> DataFrame:
    return register.pairs_with_statements(nd(s, d, "evidence_a", "evidence_b", "score"), ev(s, d, "block_type", "source_id"))


@query("jon_05_citations", "SELECT evidence_id, e.source_id, rel_path, s.revision AS source_revision, page_no, seq FROM ev e JOIN src s ON s.source_id = e.source_id")
def jon_05(s: SparkSession, d: str) -> DataFrame:
    return register.with_sources(ev(s, d, "source_id", "page_no", "seq"), src(s, d, "rel_path", "revision"))


@query("jon_06_without_statement", "SELECT evidence_id, quantity_id FROM qty WHERE evidence_id IS NULL OR NOT EXISTS (SELECT 1 FROM ev WHERE ev.evidence_id = qty.evidence_id)")
def jon_06(s: SparkSession, d: str) -> DataFrame:
    return register.without_partner(qty(s, d, "evidence_id").select("evidence_id", "quantity_id"), ev(s, d, "status"), "evidence_id", "evidence_id")


@query("jon_07_dangling", "SELECT evidence_id, canonical_evidence_id FROM ev WHERE canonical_evidence_id <> '' AND canonical_evidence_id NOT IN (SELECT evidence_id FROM ev WHERE status = 'active')")
def jon_07(s: SparkSession, d: str) -> DataFrame:
    return register.dangling_canonicals(ev(s, d, "status", "canonical_evidence_id"))


@query("jon_10_members", "SELECT canonical_evidence_id, count(*) AS members, min(evidence_id) AS first_member, max(evidence_id) AS last_member FROM ev WHERE canonical_evidence_id <> '' AND canonical_evidence_id IN (SELECT evidence_id FROM ev) GROUP BY 1")
def jon_10(s: SparkSession, d: str) -> DataFrame:
    return register.members_of_canonicals(ev(s, d, "canonical_evidence_id"))


def _relation(ea: str, ma: str, eb: str, mb: str) -> str:
    l = lambda x: f"coalesce({sql.several(x)}, [])"  # noqa: E731, E741
    both = lambda x, y: f"len({l(x)}) > 0 AND len({l(y)}) > 0"
    return (f"CASE WHEN {both(ea, eb)} AND NOT list_has_any({l(ea)}, {l(eb)}) THEN 'different_equipment' WHEN {both(ma, mb)} AND list_has_any({l(ma)}, {l(mb)}) THEN 'same_model' "
            f"WHEN {both(ma, mb)} THEN 'different_model' WHEN len({l(ma)}) > 0 OR len({l(mb)}) > 0 THEN 'model_unspecified_on_one_side' ELSE 'model_unspecified' END")


@query("jon_15_relations", f"SELECT pair_id, {_relation('a.equipment', 'a.model', 'b.equipment', 'b.model')} AS relation FROM nd JOIN ev a ON a.evidence_id = evidence_a JOIN ev b ON b.evidence_id = evidence_b")
def jon_15(s: SparkSession, d: str) -> DataFrame:
    return register.relations_of_pairs(nd(s, d, "evidence_a", "evidence_b"), ev(s, d, "equipment", "model"))


@query("jon_16_overlaps", """, b AS (SELECT source_id, page_no, evidence_id, bbox, (bbox.x1 - bbox.x0) * (bbox.y1 - bbox.y0) AS area FROM ev WHERE bbox IS NOT NULL AND (bbox.x1 - bbox.x0) * (bbox.y1 - bbox.y0) > 0),
p AS (SELECT a.evidence_id AS evidence_a, b.evidence_id AS evidence_b, least(a.bbox.x1, b.bbox.x1) - greatest(a.bbox.x0, b.bbox.x0) AS w, least(a.bbox.y1, b.bbox.y1) - greatest(a.bbox.y0, b.bbox.y0) AS h, least(a.area, b.area) AS area
 FROM b a JOIN b ON a.source_id = b.source_id AND a.page_no = b.page_no AND a.evidence_id < b.evidence_id)
SELECT evidence_a, evidence_b, round(w * h / area, 6) AS covered FROM p WHERE w > 0 AND h > 0 AND w * h > 0.4 * area""")
def jon_16(s: SparkSession, d: str) -> DataFrame:
    return register.overlapping_boxes(ev(s, d, "source_id", "page_no", "bbox"))


@query("jon_16_captions", """, m AS (SELECT t.evidence_id, c.evidence_id AS caption_id, greatest(c.bbox.y0 - t.bbox.y1, t.bbox.y0 - c.bbox.y1) AS gap FROM ev t JOIN ev c ON c.source_id = t.source_id AND c.page_no = t.page_no
 WHERE t.block_type = 'table' AND c.block_type = 'caption' AND t.bbox IS NOT NULL AND c.bbox IS NOT NULL AND least(t.bbox.x1, c.bbox.x1) > greatest(t.bbox.x0, c.bbox.x0))
SELECT evidence_id, arg_min(caption_id, (gap, caption_id)) AS caption_id, round(min(gap), 6) AS gap FROM m WHERE gap >= -2 GROUP BY evidence_id""")
def jon_16b(s: SparkSession, d: str) -> DataFrame:
    return register.nearest_caption(ev(s, d, "source_id", "page_no", "bbox", "block_type"))


@query("jon_17_latest_change", "SELECT source_id, arg_max(evidence_id, (created_at, evidence_id)) AS evidence_id, epoch_us(max(created_at)) AS at FROM ev WHERE source_id IS NOT NULL AND created_at IS NOT NULL GROUP BY source_id")
def jon_17(s: SparkSession, d: str) -> DataFrame:
    rows = ev(s, d, "source_id", "created_at").where("source_id IS NOT NULL AND created_at IS NOT NULL")
    return register.latest_of_each(rows, "source_id", "created_at", "evidence_id").select("source_id", "evidence_id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"))


@query("jon_19_lifecycle", """, now AS (SELECT DISTINCT 'P' || evidence_a AS k FROM nd WHERE score >= 90 OR (score <= 1 AND score >= 0.9)), before AS (SELECT 'P' || evidence_a AS k, max(status) AS status FROM nd WHERE evidence_a IS NOT NULL GROUP BY 1)
SELECT coalesce(before.k, now.k) AS k, CASE WHEN before.status IS NULL THEN 'new' WHEN now.k IS NOT NULL AND status = 'stale' THEN 'reopened' WHEN now.k IS NOT NULL THEN 'kept' WHEN status = 'candidate' THEN 'stale' ELSE 'kept' END AS change
FROM before FULL OUTER JOIN now ON before.k = now.k WHERE coalesce(before.k, now.k) IS NOT NULL""")
def jon_19(s: SparkSession, d: str) -> DataFrame:
    pairs = nd(s, d, "evidence_a", "score", "status").withColumn("k", F.concat(F.lit("P"), "evidence_a")).where("k IS NOT NULL")
    now = pairs.where("score >= 90 OR (score <= 1 AND score >= 0.9)").select("k").distinct()
    return register.lifecycle(pairs.groupBy("k").agg(F.max("status").alias("status")), now, "k")


@query("jon_20_identical_files", "SELECT e.evidence_id, c.source_id AS copy_id, c.rel_path AS copy_path FROM ev e JOIN src c ON c.duplicate_of = e.source_id WHERE c.duplicate_of <> ''")
def jon_20(s: SparkSession, d: str) -> DataFrame:
    return register.same_file_elsewhere(src(s, d, "duplicate_of", "rel_path"), ev(s, d, "source_id"))


@query("jon_21_missing_pages", ", pages AS (SELECT source_id, unnest(generate_series(1, page_count))::int AS page_no FROM src WHERE present = 1 AND page_count >= 1) "
       "SELECT source_id, page_no FROM pages p WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.source_id = p.source_id AND ev.page_no = p.page_no)")
def jon_21(s: SparkSession, d: str) -> DataFrame:
    return register.missing_pages(src(s, d, "present", "page_count"), ev(s, d, "source_id", "page_no"))


# ---------------------------------------------------------------- aggregates

_PART = lambda t_, name, c: f"SELECT '{name}' AS section, {c}::varchar AS value, count(*) AS n FROM {t_} GROUP BY {c}"


@query("agg_01_dashboard", " UNION ALL ".join([_PART("src", "sources", "status"), _PART("src", "extraction", "extraction_status"), _PART("ev", "statements", "status"), _PART("ev", "review", "review_status"),
                                                _PART("ev", "blocks", "block_type"), _PART("nd", "near_duplicates", "status")]))
def agg_01(s: SparkSession, d: str) -> DataFrame:
    return register.dashboard(ev(s, d, "status", "review_status", "block_type"), src(s, d, "status", "extraction_status"), nd(s, d, "status"))


@query("agg_02_by_keys", "SELECT block_type, extraction_method, status, count(*) AS n FROM ev GROUP BY ALL")
def agg_02(s: SparkSession, d: str) -> DataFrame:
    return register.counts(ev(s, d, "block_type", "extraction_method", "status"), "block_type", "extraction_method", "status")


@query("agg_03_ocr", "SELECT extraction_method, count(*) AS blocks, count(ocr_confidence) AS with_confidence, round(avg(ocr_confidence), 6) AS mean_confidence, min(ocr_confidence) AS least_confidence, count(*) FILTER (ocr_confidence < 60) AS low FROM ev GROUP BY 1")
def agg_03(s: SparkSession, d: str) -> DataFrame:
    return register.ocr_statistics(ev(s, d, "extraction_method", "ocr_confidence"))


@query("agg_04_latest", "SELECT scorer, arg_max(pair_id, (created_at, pair_id)) AS pair_id, epoch_us(max(created_at)) AS at FROM nd WHERE created_at IS NOT NULL GROUP BY scorer")
def agg_04(s: SparkSession, d: str) -> DataFrame:
    rows = nd(s, d, "scorer", "created_at").where("created_at IS NOT NULL")
    return register.latest_of_each(rows, "scorer", "created_at", "pair_id").select("scorer", "pair_id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"))


@query("agg_05_outcomes", "SELECT source_id, count(*) AS blocks, count(*) FILTER (status <> 'active') AS not_active, CASE WHEN count(*) = count(*) FILTER (status <> 'active') THEN 'failed' WHEN count(*) FILTER (status <> 'active') > 0 THEN 'complete_with_errors' ELSE 'complete' END AS outcome FROM ev GROUP BY source_id")
def agg_05(s: SparkSession, d: str) -> DataFrame:
    return register.extraction_outcome(ev(s, d, "source_id", "status"))


@query("agg_06_body_font", ", z AS (SELECT source_id, round(font_size * 2) / 2 AS size, sum(length(text))::bigint AS chars FROM ev WHERE font_size IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2) "
       "SELECT source_id, arg_max(size, (chars, -size)) AS body_size, sum(chars)::bigint AS chars FROM z GROUP BY source_id")
def agg_06(s: SparkSession, d: str) -> DataFrame:
    return register.body_font(ev(s, d, "source_id", "font_size", "text"))


_SHAPE = sql.collapse("regexp_replace(lower(text), '[0-9]+', '#', 'g')")


@query("agg_07_templates", f", z AS (SELECT source_id, page_no, {_SHAPE} AS template FROM ev WHERE text IS NOT NULL), "
       "p AS (SELECT source_id, count(DISTINCT page_no) AS pages FROM z WHERE template <> '' GROUP BY 1), f AS (SELECT source_id, template, count(DISTINCT page_no) AS on_pages FROM z WHERE template <> '' GROUP BY 1, 2) "
       "SELECT f.source_id, template, on_pages, pages FROM f JOIN p ON p.source_id = f.source_id WHERE on_pages >= greatest(3, ceil(0.3 * pages))")
def agg_07(s: SparkSession, d: str) -> DataFrame:
    return register.repeated_templates(ev(s, d, "source_id", "page_no", "text"))


@query("agg_08_weighted_means", "SELECT source_id, round(sum(font_size * length(text)) FILTER (font_size IS NOT NULL) / sum(length(text)) FILTER (font_size IS NOT NULL), 6) AS font_size, "
       "round(sum(ocr_confidence * length(text)) FILTER (ocr_confidence IS NOT NULL) / sum(length(text)) FILTER (ocr_confidence IS NOT NULL), 6) AS ocr_confidence FROM ev WHERE text <> '' GROUP BY source_id")
def agg_08(s: SparkSession, d: str) -> DataFrame:
    return register.weighted_means(ev(s, d, "source_id", "font_size", "ocr_confidence", "text"))


@query("agg_09_page_boxes", "SELECT source_id, page_no, min(bbox.x0) AS x0, min(bbox.y0) AS y0, max(bbox.x1) AS x1, max(bbox.y1) AS y1 FROM ev WHERE bbox IS NOT NULL GROUP BY 1, 2")
def agg_09(s: SparkSession, d: str) -> DataFrame:
    return register.page_boxes(ev(s, d, "source_id", "page_no", "bbox"))


@query("agg_11_components", ", f AS (SELECT source_id, component, min((page_no, seq, evidence_id)) AS pos FROM ev WHERE component IS NOT NULL GROUP BY 1, 2) SELECT source_id, string_agg(component, '; ' ORDER BY pos) AS listed, count(*) AS n FROM f GROUP BY 1")
def agg_11(s: SparkSession, d: str) -> DataFrame:
    return register.first_seen_values(ev(s, d, "source_id", "component", "page_no", "seq"), "component")


@query("agg_13_roll_up", """, checks AS (SELECT 'present' AS kind, CASE WHEN present = 1 THEN 0 ELSE 2 END AS bad FROM src UNION ALL SELECT 'extracted', CASE WHEN extraction_status = 'complete' THEN 0 WHEN extraction_status = 'failed' THEN 2 ELSE 1 END FROM src
UNION ALL SELECT 'has_text', CASE WHEN coalesce(text, '') <> '' THEN 0 ELSE 1 END FROM ev), kinds AS (SELECT unnest(['present', 'extracted', 'has_text', 'signed']) AS kind)
SELECT k.kind, CASE WHEN max(bad) IS NULL THEN 'SKIP' WHEN max(bad) = 2 THEN 'FAIL' WHEN max(bad) = 1 THEN 'WARN' ELSE 'PASS' END AS outcome, count(bad) AS checked FROM kinds k LEFT JOIN checks c ON c.kind = k.kind GROUP BY k.kind""")
def agg_13(s: SparkSession, d: str) -> DataFrame:
    return register.rolled_up(src(s, d, "present", "extraction_status"), ev(s, d, "text"))


@query("agg_15_changed_numbers")
def agg_15(s: SparkSession, d: str) -> DataFrame:
    return register.changed_numbers(ev(s, d, "text", "display_text"))


@query("agg_16_review", "SELECT review_status, count(*) AS n FROM ev WHERE block_type IN ('paragraph', 'list_item', 'table', 'danger', 'warning', 'caution', 'notice', 'note', 'caption') GROUP BY 1")
def agg_16(s: SparkSession, d: str) -> DataFrame:
    return register.counts(ev(s, d, "review_status", "block_type").where(F.col("block_type").isin(*standing.DEDUPE)), "review_status")


# ---------------------------------------------------------------- windows

@query("win_01_occurrences", "SELECT evidence_id, row_number() OVER (PARTITION BY source_id, text ORDER BY page_no, seq, evidence_id) AS occurrence FROM ev WHERE block_type IN ('danger', 'warning', 'caution', 'notice', 'note') AND text IS NOT NULL")
def win_01(s: SparkSession, d: str) -> DataFrame:
    return register.occurrences(ev(s, d, "source_id", "page_no", "seq", "block_type", "text"))


@query("win_03_primary_files", """, h AS (SELECT *, length(rel_path) - length(replace(rel_path, '/', '')) AS depth FROM src WHERE present = 1 AND sha256 <> ''),
b AS (SELECT sha256, arg_min(source_id, (first_seen_at, depth, rel_path, source_id)) AS primary_id FROM h GROUP BY 1 HAVING count(*) > 1) SELECT source_id, primary_id, source_id = primary_id AS is_primary FROM h JOIN b ON b.sha256 = h.sha256""")
def win_03(s: SparkSession, d: str) -> DataFrame:
    return register.primary_files(src(s, d, "present", "sha256", "rel_path", "first_seen_at"))


@query("win_04_reading_order", "SELECT evidence_id, row_number() OVER (PARTITION BY source_id, page_no ORDER BY coalesce(column_index, 0), bbox.y0 NULLS LAST, bbox.x0 NULLS LAST, seq, evidence_id) AS place FROM ev WHERE page_no IS NOT NULL")
def win_04(s: SparkSession, d: str) -> DataFrame:
    return register.reading_order(ev(s, d, "source_id", "page_no", "seq", "column_index", "bbox"))


def _path() -> str:
    at = "(page_no, seq, evidence_id)"
    w = "OVER (PARTITION BY source_id ORDER BY page_no, seq, evidence_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    last = ", ".join(f"max(CASE WHEN heading_level = {k} THEN {at} END) {w} AS a{k}, last_value(CASE WHEN heading_level = {k} THEN title END IGNORE NULLS) {w} AS t{k}" for k in range(1, 7))
    shown = ", ".join("CASE WHEN t{0} IS NOT NULL AND {0} <= heading_level{1} THEN t{0} END".format(k, "".join(f" AND coalesce(a{j} < a{k}, true)" for j in range(1, k))) for k in range(1, 7))
    return (f", h AS (SELECT source_id, page_no, seq, evidence_id, heading_level, left({sql.collapse('text')}, 200) AS title FROM ev WHERE block_type = 'heading' AND heading_level BETWEEN 1 AND 6 AND text IS NOT NULL), "
            f"l AS (SELECT *, {last} FROM h) SELECT evidence_id, array_to_string(list_filter([{shown}], lambda x: x IS NOT NULL), ' > ') AS path FROM l")


@query("win_05_section_paths", _path())
def win_05(s: SparkSession, d: str) -> DataFrame:
    return register.section_paths(ev(s, d, "source_id", "page_no", "seq", "block_type", "heading_level", "text"))


@query("win_06_bands", "SELECT evidence_id, (sum(CASE WHEN bbox.x1 - bbox.x0 > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, page_no ORDER BY seq, evidence_id ROWS UNBOUNDED PRECEDING))::bigint AS band FROM ev WHERE bbox IS NOT NULL AND page_no IS NOT NULL")
def win_06(s: SparkSession, d: str) -> DataFrame:
    return register.bands(ev(s, d, "source_id", "page_no", "seq", "bbox"))


@query("win_09_restated", ", w AS (SELECT quantity_id, lag(quantity_id) OVER o AS restates, char_start - lag(char_end) OVER o AS gap FROM qty WHERE char_start IS NOT NULL AND char_end IS NOT NULL WINDOW o AS (PARTITION BY evidence_id ORDER BY char_start, char_end, quantity_id)) SELECT quantity_id, restates, gap::bigint AS gap FROM w WHERE gap BETWEEN 0 AND 3")
def win_09(s: SparkSession, d: str) -> DataFrame:
    return register.restated(qty(s, d, "evidence_id", "char_start", "char_end"))


@query("win_11_latest_delivery", "SELECT pair_id, status, epoch_us(loaded_at) AS at FROM nd")
def win_11(s: SparkSession, d: str) -> DataFrame:
    return nd(s, d, "status", "loaded_at").select("pair_id", "status", F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("at"))


@query("win_12_first_run", "SELECT source_id, arg_min(run_id, (loaded_at, run_id)) AS run_id FROM sources WHERE source_id IS NOT NULL AND run_id IS NOT NULL AND loaded_at IS NOT NULL GROUP BY 1")
def win_12(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "sources").where("source_id IS NOT NULL AND run_id IS NOT NULL AND loaded_at IS NOT NULL").groupBy("source_id").agg(F.min_by("run_id", F.struct("loaded_at", "run_id")).alias("run_id"))


@query("win_13_label_changes", ", w AS (SELECT evidence_id, section_heading, lag(section_heading) OVER (PARTITION BY source_id ORDER BY page_no, seq, evidence_id) AS was FROM ev WHERE source_id IS NOT NULL AND page_no IS NOT NULL) SELECT evidence_id, section_heading, was FROM w WHERE section_heading IS DISTINCT FROM was")
def win_13(s: SparkSession, d: str) -> DataFrame:
    return register.label_changes(ev(s, d, "source_id", "page_no", "seq", "section_heading"))


# ---------------------------------------------------------------- order and top rows

@query("srt_02_top_pairs", "SELECT pair_id, round(CASE WHEN scorer = 'ratio' THEN score * 100 ELSE score END, 4) AS percent FROM nd WHERE status = 'candidate' AND score IS NOT NULL ORDER BY percent DESC, pair_id LIMIT 500")
def srt_02(s: SparkSession, d: str) -> DataFrame:
    return register.top_pairs(nd(s, d, "status", "score", "scorer"), 500)


@query("srt_03_components", ", c AS (SELECT equipment, component, count(*) AS n FROM ev WHERE equipment IS NOT NULL AND component IS NOT NULL GROUP BY 1, 2) SELECT equipment, component, n, row_number() OVER w AS place, n - lead(n) OVER w AS ahead FROM c WINDOW w AS (PARTITION BY equipment ORDER BY n DESC, component)")
def srt_03(s: SparkSession, d: str) -> DataFrame:
    return register.ranked_components(ev(s, d, "equipment", "component"))


@query("srt_04_work_list", "SELECT source_id, (CASE WHEN extraction_status = 'partial' THEN 0 ELSE 1 END)::bigint AS turn, lower(rel_path) AS path FROM src WHERE present = 1 AND extraction_status IN ('pending', 'partial') ORDER BY turn, path, source_id LIMIT 100")
def srt_04(s: SparkSession, d: str) -> DataFrame:
    return register.work_list(src(s, d, "present", "extraction_status", "rel_path"), 100)


# ---------------------------------------------------------------- sets

@query("set_01_not_delivered_again", "SELECT evidence_id FROM (SELECT DISTINCT evidence_id FROM evidence WHERE loaded_at < TIMESTAMP '2025-07-01' AND evidence_id IS NOT NULL EXCEPT SELECT evidence_id FROM evidence WHERE loaded_at >= TIMESTAMP '2025-07-01')")
def set_01(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "evidence").where("evidence_id IS NOT NULL")
    cut = F.lit("2025-07-01").cast("timestamp_ntz")
    return register.not_in(e.where(F.col("loaded_at") < cut).select("evidence_id"), e.where(F.col("loaded_at") >= cut).select("evidence_id"))


@query("set_04_models_in_common", f", s AS (SELECT evidence_id, {sql.several('model')} AS m FROM ev) SELECT pair_id, array_to_string(list_sort(list_intersect(a.m, b.m)), '; ') AS models FROM nd JOIN s a ON a.evidence_id = evidence_a JOIN s b ON b.evidence_id = evidence_b WHERE list_has_any(a.m, b.m)")
def set_04(s: SparkSession, d: str) -> DataFrame:
    return register.models_in_common(nd(s, d, "evidence_a", "evidence_b"), ev(s, d, "model"))


@query("prj_02_effective", "SELECT evidence_id, coalesce(nullif(display_text, ''), text) AS shown, coalesce(display_text, '') <> '' AS worded FROM ev")
def prj_02(s: SparkSession, d: str) -> DataFrame:
    return register.effective_texts(ev(s, d, "text", "display_text"))


@query("jon_05_hot_sources", "SELECT evidence_id, s.model AS source_model FROM ev JOIN src s ON s.source_id = ev.source_id")
def jon_05_hot(s: SparkSession, d: str) -> DataFrame:
    return register.hot_lookup(ev(s, d, "source_id"), src(s, d, "model"))


# ---------------------------------------------------------------- duplicates

_APPLIES = f"coalesce(array_to_string({sql.several('equipment')}, ';'), '') || '|' || coalesce(array_to_string({sql.several('model')}, ';'), '')"
_KEYED = f""", k AS (SELECT e.evidence_id, e.source_id, e.page_no, e.seq, e.block_type, sha256({sql.normalised('e.text')}) AS hash, {sql.topic('e.section_heading')} AS topic,
 (SELECT {_APPLIES} FROM (SELECT e.equipment AS equipment, e.model AS model)) AS applies, coalesce(coalesce(s.is_repaired::int, 0) * 2 + CASE WHEN s.extraction_status = 'complete' THEN 0 ELSE 1 END, 3) AS rank
 FROM ev e LEFT JOIN src s ON s.source_id = e.source_id WHERE e.status = 'active' AND e.block_type IN ('paragraph', 'list_item', 'table', 'danger', 'warning', 'caution', 'notice', 'note', 'caption'))"""


@query("dup_01_exact_groups", _KEYED + """, n AS (SELECT *, CASE WHEN block_type IN ('danger', 'warning', 'caution', 'notice') THEN row_number() OVER (PARTITION BY hash, topic, applies, source_id, block_type IN ('danger', 'warning', 'caution', 'notice') ORDER BY page_no, seq, evidence_id) ELSE 0 END AS nth FROM k),
b AS (SELECT hash, topic, applies, nth, arg_min(evidence_id, (rank, source_id, page_no, seq, evidence_id)) AS canonical_id, count(*) AS members FROM n GROUP BY ALL HAVING count(*) > 1)
SELECT n.evidence_id, canonical_id, CASE WHEN n.evidence_id = canonical_id THEN 'canonical' ELSE 'exact_duplicate' END AS role, members FROM n JOIN b USING (hash, topic, applies, nth)""")
def dup_01(s: SparkSession, d: str) -> DataFrame:
    e = ev(s, d, "source_id", "page_no", "seq", "block_type", "status", "text", "section_heading", "equipment", "model")
    return duplicates.exact_groups(duplicates.keyed(e, src(s, d, "is_repaired", "extraction_status")))


@query("dup_02_context_keys", _KEYED + " SELECT evidence_id, topic, applies FROM k")
def dup_02(s: SparkSession, d: str) -> DataFrame:
    e = ev(s, d, "source_id", "page_no", "seq", "block_type", "status", "text", "section_heading", "equipment", "model")
    return duplicates.keyed(e, src(s, d, "is_repaired", "extraction_status")).select("evidence_id", "topic", "applies")


@query("dup_04_guards")
def dup_04(s: SparkSession, d: str) -> DataFrame:
    e = ev(s, d, "text", "block_type", "safety_level", "component", "source_id", "revision", "equipment", "model")
    return duplicates.guarded_pairs(nd(s, d, "evidence_a", "evidence_b"), e).select("pair_id", F.array_join("flags", ";").alias("flags"))
