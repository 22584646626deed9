"""Queries of classification, conflicts, similarity, intake, streaming and audit, each with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import similarity
from tessera.functions import text as t
from tessera.operators import audit, classification, conflicts
from tessera.operators.standing import SAFETY
from tessera.plans import sql
from tessera.plans.register_queries import ev, nd, qty, query, src
from tessera.plans.session import table
from tessera.sources import intake
from tessera.streaming import deliveries

Q = sql.quoted


# ---------------------------------------------------------------- classification

def _chapter_sql() -> str:
    c = classification
    named = [f"coalesce(regexp_matches(section_heading, {Q(c.word_pattern(x.headings))}), false)" if x.headings else "false" for x in c.CHAPTERS]
    context = "(" + " OR ".join(named) + ")"
    parts = []
    for i, (x, hit) in enumerate(zip(c.CHAPTERS, named)):
        score = [f"CASE WHEN {hit} THEN {c.SECTION} ELSE 0.0 END"]
        if x.headings:
            score.append(f"CASE WHEN block_type = 'heading' AND regexp_matches(text, {Q(c.word_pattern(x.headings))}) THEN {c.OWN_HEADING} ELSE 0.0 END")
        if x.words:
            score.append(f"least({c.WORDS_AT_MOST}, {c.WORD} * len(list_distinct(list_transform(regexp_extract_all(text, {Q(c.word_pattern(x.words))}), lambda w: lower(w)))))")
        score += [f"CASE WHEN regexp_matches(text, {Q(p)}) THEN {c.PATTERN} ELSE 0.0 END" for p in x.patterns]
        if x.blocks:
            score.append(f"CASE WHEN block_type IN ({', '.join(map(Q, x.blocks))}) AND NOT {context} THEN {c.BLOCK} ELSE 0.0 END")
        parts.append(f"{{'score': ({' + '.join(score)})::double, 'place': {-i}, 'name': '{x.name}'}}")
    return (f", s AS (SELECT evidence_id, list_reverse_sort([{', '.join(parts)}]) AS s FROM ev WHERE text IS NOT NULL) "
            f"SELECT evidence_id, CASE WHEN s[1].score < {c.LEAST} THEN 'unclassified' ELSE s[1].name END AS chapter, s[1].score AS score, CASE WHEN s[1].score < {c.LEAST} THEN 'unclassified' "
            f"WHEN s[2].score > 0 AND s[1].score - s[2].score < {c.LEAD} THEN 'ambiguous' ELSE 'classified' END AS outcome FROM s")


@query("cls_01_chapters", _chapter_sql())
def cls_01(s: SparkSession, d: str) -> DataFrame:
    return classification.chapters_of(ev(s, d, "text", "block_type", "section_heading"))


@query("cls_03_chapter_counts", _chapter_sql().replace("SELECT evidence_id, CASE WHEN s[1]", ", done AS (SELECT CASE WHEN s[1]", 1).replace("END AS chapter, s[1].score AS score,", "END AS chapter,") + ") SELECT chapter, outcome, count(*) AS n FROM done GROUP BY 1, 2")
def cls_03(s: SparkSession, d: str) -> DataFrame:
    return classification.chapters_of(ev(s, d, "text", "block_type", "section_heading")).groupBy("chapter", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("cls_05_components", ", " + "h AS (" + " UNION ALL ".join(
    f"SELECT evidence_id, '{n}' AS component, len(regexp_extract_all(text, {Q(classification.word_pattern((*w, n)))})) AS hits FROM ev WHERE text IS NOT NULL" for n, w in classification.COMPONENTS.items())
    + ") SELECT evidence_id, component, hits FROM h WHERE hits > 0")
def cls_05(s: SparkSession, d: str) -> DataFrame:
    return classification.components_of(ev(s, d, "text"))


@query("cls_09_applicability", """, known AS (SELECT DISTINCT trim(m) AS model FROM (SELECT unnest(string_split(model, ';')) AS m FROM src) WHERE trim(m) <> ''),
n AS (SELECT evidence_id, source_id, list_distinct(regexp_extract_all(coalesce(section_heading || chr(10), '') || text, '\\b[A-Z]{2,3}-[0-9]{1,4}\\b')) AS named FROM ev WHERE text IS NOT NULL),
m AS (SELECT evidence_id, source_id, array_to_string(list_sort(list_filter(named, lambda x: x IN (SELECT model FROM known))), '; ') AS own FROM n)
SELECT m.evidence_id, CASE WHEN own <> '' THEN own ELSE s.model END AS models, CASE WHEN own <> '' THEN 'text' ELSE 'source' END AS origin FROM m LEFT JOIN src s ON s.source_id = m.source_id""".replace(
    "list_filter(named, lambda x: x IN (SELECT model FROM known))", "list_intersect(named, (SELECT list(model) FROM known))"))
def cls_09(s: SparkSession, d: str) -> DataFrame:
    sources = src(s, d, "model")
    known = sources.select(F.explode(t.several(F.col("model"))).alias("model")).distinct()
    return classification.applicability(ev(s, d, "text", "section_heading", "source_id"), sources, known)


# ---------------------------------------------------------------- conflicts

def _subject(x: str) -> str:
    alike = "CASE {0} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in conflicts.SYNONYMS.items()) + " ELSE {0} END"
    stop = "(" + ", ".join(map(Q, conflicts.STOPWORDS)) + ")"
    words = f"list_filter(list_transform(regexp_extract_all(lower({x}), '[a-z][a-z-]+'), lambda w: regexp_replace(w, '-+$', '')), lambda w: w NOT IN {stop})"
    same = f"list_transform({words}, lambda w: {alike.format('w')})"
    single = f"list_transform({same}, lambda w: CASE WHEN length(w) > 4 AND w LIKE '%s' AND NOT regexp_matches(w, '(?:ss|us|is)$') THEN left(w, length(w) - 1) ELSE w END)"
    return f"array_to_string(list_sort(list_distinct(list_filter(list_transform({single}, lambda w: {alike.format('w')}), lambda w: w NOT IN {stop}))), ' ')"


_CLAUSE = "regexp_extract(left(text, char_start), '(?s)^(?:.*(?:\\. |; |\\n|, ))?(.*)$', 1)"
_VALUES = f""", v AS (SELECT q.*, e.source_id, e.text, e.section_heading, coalesce(array_to_string({sql.several('e.model')}, ';'), '') AS models FROM qty q JOIN ev e ON e.evidence_id = q.evidence_id
 WHERE parameter IN ({', '.join(map(Q, conflicts.COMPARED))}) AND canonical_value IS NOT NULL AND alternate_of IS NULL AND char_start IS NOT NULL AND e.status = 'active' AND (dup_role IS NULL OR dup_role = 'canonical')),
values_ AS (SELECT quantity_id, evidence_id, source_id, parameter, models, canonical_unit, CASE WHEN qualifier IN ('max', 'min') THEN qualifier ELSE 'nominal' END AS qualifier,
 CASE WHEN contains({_subject(_CLAUSE)}, ' ') THEN {_subject(_CLAUSE)} ELSE {_subject("concat_ws(' ', " + _CLAUSE + ", section_heading)")} END AS subject, canonical_value FROM v)"""


def _values(s: SparkSession, d: str) -> DataFrame:
    q = qty(s, d, "evidence_id", "parameter", "qualifier", "canonical_value", "canonical_unit", "alternate_of", "char_start")
    return conflicts.stated_values(q, ev(s, d, "status", "dup_role", "source_id", "text", "section_heading", "model"))


@query("unt_04_subjects", _VALUES + " SELECT quantity_id, evidence_id, source_id, parameter, models, canonical_unit, qualifier, subject, canonical_value FROM values_")
def unt_04(s: SparkSession, d: str) -> DataFrame:
    return _values(s, d)


@query("con_01_quantity_conflicts", _VALUES + f""", g AS (SELECT parameter, qualifier, subject, models, canonical_unit, count(*) AS n, count(DISTINCT evidence_id) AS statements, min(canonical_value) AS low, max(canonical_value) AS high FROM values_ WHERE subject <> '' GROUP BY ALL)
SELECT parameter, qualifier, subject, models, canonical_unit, n, statements, round(low, 6) AS low, round(high, 6) AS high FROM g WHERE statements > 1 AND low + greatest({conflicts.ABSOLUTE}, {conflicts.RELATIVE} * greatest(abs(low), abs(high))) < high""")
def con_01(s: SparkSession, d: str) -> DataFrame:
    return conflicts.quantity_conflicts(_values(s, d))


@query("con_02_dual_units", f"SELECT q.quantity_id, q.alternate_of, round(abs(p.canonical_value - q.canonical_value) / abs(p.canonical_value), 6) AS off FROM qty q JOIN qty p ON p.quantity_id = q.alternate_of "
       f"WHERE q.canonical_value IS NOT NULL AND p.canonical_value <> 0 AND p.canonical_unit = q.canonical_unit AND abs(p.canonical_value - q.canonical_value) / abs(p.canonical_value) > {conflicts.DUAL}")
def con_02(s: SparkSession, d: str) -> DataFrame:
    return conflicts.dual_unit_conflicts(qty(s, d, "alternate_of", "canonical_value", "canonical_unit"))


_PARTS = f""", h AS (SELECT evidence_id, table_cells, list_position(list_transform(table_cells[1], lambda c: regexp_matches(coalesce(c, ''), {Q(conflicts.NUMBER_HEADER)})), true) AS i,
 list_position(list_transform(table_cells[1], lambda c: regexp_matches(coalesce(c, ''), {Q(conflicts.NAME_HEADER)})), true) AS j FROM ev WHERE len(table_cells) > 1),
r AS (SELECT evidence_id, i, j, unnest(table_cells[2:]) AS line FROM h WHERE i > 0 AND j > 0), parts AS (SELECT evidence_id, trim(line[i]) AS part_number, trim(line[j]) AS description FROM r WHERE trim(line[i]) <> '' AND trim(line[j]) <> '')"""


@query("con_03_table_parts", _PARTS + " SELECT * FROM parts")
def con_03(s: SparkSession, d: str) -> DataFrame:
    return conflicts.table_parts(ev(s, d, "table_cells"))


@query("con_03_inline_parts", ", p AS (SELECT evidence_id, unnest(regexp_extract_all(text, '(?i)\\b(?:P/N|PN|part *(?:no\\.?|number)|order *no\\.?) *[:#]? *([A-Z0-9][A-Z0-9./-]{2,})', 1)) AS p FROM ev WHERE block_type <> 'table' AND text IS NOT NULL) "
       "SELECT evidence_id, regexp_replace(p, '[.,;)]+$', '') AS part_number FROM p")
def con_03b(s: SparkSession, d: str) -> DataFrame:
    return conflicts.inline_parts(ev(s, d, "text", "block_type"))


@query("con_04_part_numbers", _PARTS + f", n AS (SELECT evidence_id, {sql.normalised('description')} AS name, upper(part_number) AS number FROM parts) SELECT name, count(DISTINCT number) AS numbers, count(DISTINCT evidence_id) AS statements, "
       "min(number) AS first_number, max(number) AS last_number FROM n GROUP BY name HAVING count(DISTINCT number) > 1 AND count(DISTINCT evidence_id) > 1")
def con_04(s: SparkSession, d: str) -> DataFrame:
    return conflicts.part_conflicts(conflicts.table_parts(ev(s, d, "table_cells")))


_ROWS = f""", rows_ AS (SELECT source_id, {sql.topic('section_heading')} AS topic, block_type, page_no, text FROM ev WHERE status = 'active' AND block_type IN ('list_item', {', '.join(map(Q, SAFETY))}) AND section_heading IS NOT NULL),
proc AS (SELECT source_id, topic, count(*) FILTER (block_type = 'list_item') AS steps, count(*) FILTER (block_type <> 'list_item') AS warnings, min(page_no) AS first_page, max(page_no) AS last_page FROM rows_ WHERE topic <> '' GROUP BY 1, 2)"""


def _rows(s: SparkSession, d: str) -> DataFrame:
    return ev(s, d, "source_id", "status", "block_type", "section_heading", "page_no", "text")


@query("con_05_procedures", _ROWS + " SELECT * FROM proc")
def con_05(s: SparkSession, d: str) -> DataFrame:
    return conflicts.procedures(_rows(s, d))


@query("con_06_procedure_lengths", _ROWS + " SELECT topic, count(*) AS sources, min(steps) AS fewest, max(steps) AS most FROM proc WHERE steps >= 2 GROUP BY topic HAVING min(steps) < max(steps)")
def con_06(s: SparkSession, d: str) -> DataFrame:
    return conflicts.procedure_conflicts(conflicts.procedures(_rows(s, d)))


@query("con_07_missing_warnings", _ROWS + f""", w AS (SELECT DISTINCT source_id, topic FROM rows_ WHERE topic <> '' AND block_type = 'list_item'), n AS (SELECT topic, count(*) AS sources FROM w GROUP BY 1),
h AS (SELECT r.topic, sha256({sql.normalised('r.text')}) AS hash, count(DISTINCT r.source_id) AS having_ FROM rows_ r JOIN w ON w.source_id = r.source_id AND w.topic = r.topic WHERE r.block_type <> 'list_item' GROUP BY 1, 2)
SELECT h.topic, hash, having_ AS "having", sources FROM h JOIN n ON n.topic = h.topic WHERE having_ < sources""")
def con_07(s: SparkSession, d: str) -> DataFrame:
    return conflicts.missing_warnings(_rows(s, d))


_TOLD = "list_sort(list_intersect(guard_flags, [" + ", ".join(map(Q, conflicts.TELLING)) + "]))"


@query("con_08_safety_pairs", f"SELECT pair_id, evidence_a, evidence_b, array_to_string({_TOLD}, ';') AS told FROM nd JOIN ev a ON a.evidence_id = evidence_a AND a.status = 'active' JOIN ev b ON b.evidence_id = evidence_b AND b.status = 'active' "
       f"WHERE nd.status IN ('candidate', 'not_duplicate') AND (a.block_type IN ({', '.join(map(Q, SAFETY))}) OR b.block_type IN ({', '.join(map(Q, SAFETY))})) AND len({_TOLD}) > 0")
def con_08(s: SparkSession, d: str) -> DataFrame:
    return conflicts.safety_conflicts(nd(s, d, "evidence_a", "evidence_b", "status", "guard_flags"), ev(s, d, "status", "block_type"))


@query("con_09_fingerprints", "SELECT pair_id, sha256('safety|None|' || least(evidence_a, evidence_b) || CASE WHEN evidence_a = evidence_b THEN '' ELSE '|' || greatest(evidence_a, evidence_b) END) AS fingerprint FROM nd WHERE evidence_a IS NOT NULL AND evidence_b IS NOT NULL")
def con_09(s: SparkSession, d: str) -> DataFrame:
    return nd(s, d, "evidence_a", "evidence_b").where("evidence_a IS NOT NULL AND evidence_b IS NOT NULL").select(
        "pair_id", conflicts.fingerprint("safety", F.lit(None).cast("string"), F.array("evidence_a", "evidence_b")).alias("fingerprint"))


@query("con_11_families", "SELECT doc_number, count(*) AS sources, count(DISTINCT revision) AS revisions, min(source_id) AS first_source FROM src WHERE doc_number <> '' GROUP BY 1 HAVING count(*) > 1")
def con_11(s: SparkSession, d: str) -> DataFrame:
    return conflicts.families(src(s, d, "doc_number", "revision"))


# ---------------------------------------------------------------- similarity

def _texts(s: SparkSession, d: str) -> DataFrame:
    side = lambda a, b: ev(s, d, "text").where("text IS NOT NULL").select(F.col("evidence_id").alias(a), t.normalised(F.col("text")).alias(b))
    return nd(s, d, "evidence_a", "evidence_b").join(side("evidence_a", "ta"), "evidence_a").join(side("evidence_b", "tb"), "evidence_b")


@query("sim_01_pair_ratios")
def sim_01(s: SparkSession, d: str) -> DataFrame:
    return _texts(s, d).select("pair_id", F.round(similarity.indel("ta", "tb"), 4).alias("ratio"))


@query("sim_02_token_sort")
def sim_02(s: SparkSession, d: str) -> DataFrame:
    return _texts(s, d).select("pair_id", F.round(similarity.token_sort(F.col("ta"), F.col("tb")), 4).alias("ratio"))


# ---------------------------------------------------------------- intake, streaming, audit

@query("src_07_changes", """, old AS (SELECT rel_path, max(sha256) AS sha256 FROM sources WHERE rel_path IS NOT NULL AND loaded_at < TIMESTAMP '2025-07-01' GROUP BY 1), new AS (SELECT rel_path, max(sha256) AS sha256 FROM sources WHERE rel_path IS NOT NULL AND loaded_at >= TIMESTAMP '2025-07-01' GROUP BY 1)
SELECT coalesce(o.rel_path, n.rel_path) AS rel_path, CASE WHEN o.rel_path IS NULL THEN 'new' WHEN n.rel_path IS NULL THEN 'missing' WHEN o.sha256 IS NOT DISTINCT FROM n.sha256 THEN 'unchanged' ELSE 'modified' END AS change FROM old o FULL OUTER JOIN new n ON o.rel_path = n.rel_path""")
def src_07(s: SparkSession, d: str) -> DataFrame:
    rows, cut = table(s, d, "sources").where("rel_path IS NOT NULL"), F.lit("2025-07-01").cast("timestamp_ntz")
    content = lambda w: rows.where(w).groupBy("rel_path").agg(F.max("sha256").alias("sha256"))
    return intake.changes(content(F.col("loaded_at") < cut), content(F.col("loaded_at") >= cut))


@query("src_09_numbered", "SELECT source_id, row_number() OVER (ORDER BY lower(rel_path), source_id) AS n FROM src WHERE rel_path IS NOT NULL")
def src_09(s: SparkSession, d: str) -> DataFrame:
    rows = src(s, d, "rel_path").where("rel_path IS NOT NULL").select("source_id", F.lower("rel_path").alias("p"))
    return intake.numbered(rows, "p", "source_id").select("source_id", "n")


@query("src_04_listing")
def src_04(s: SparkSession, d: str) -> DataFrame:
    return intake.listing(s, d, "region*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("name"), "size", "sha256")


@query("str_04_upserted", "SELECT evidence_id, max(status) AS status FROM (SELECT evidence_id, status FROM evidence WHERE evidence_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY loaded_at DESC NULLS LAST, status DESC NULLS LAST) = 1) GROUP BY 1")
def str_04(s: SparkSession, d: str) -> DataFrame:
    return deliveries.upserted(s, f"{d}/evidence.parquet", "evidence_id", ["status"]).select("evidence_id", "status")


@query("str_02_windows", ", e AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2) "
       "SELECT epoch_us(start) AS start_us, event_type, n, total FROM e WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def str_02(s: SparkSession, d: str) -> DataFrame:
    return deliveries.windowed(s, f"{d}/events.parquet", "1 hour", "10 minutes").select(F.unix_micros("start").alias("start_us"), "event_type", "n", "total")


def _log(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "near_duplicates").where("pair_id IS NOT NULL AND loaded_at IS NOT NULL").select("pair_id", F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("at"), F.coalesce("status", F.lit("")).alias("status"))


@query("aud_01_chains", ", l AS (SELECT pair_id, list_sort(list({'a': epoch_us(loaded_at), 's': coalesce(status, '')})) AS e FROM near_duplicates WHERE pair_id IS NOT NULL AND loaded_at IS NOT NULL GROUP BY 1) "
       f"SELECT pair_id, len(e) AS entries, list_reduce(list_prepend('{audit.GENESIS}', list_transform(e, lambda x: x.s)), lambda h, x: sha256(h || '|' || x)) AS head FROM l")
def aud_01(s: SparkSession, d: str) -> DataFrame:
    chain = audit.chained(_log(s, d), "pair_id", ["at", "status"], "status")
    return chain.groupBy("pair_id").agg(F.max("number").alias("entries"), F.max_by("entry_hash", "number").alias("head"))


@query("aud_02_broken", "SELECT pair_id, 1::bigint AS number FROM near_duplicates WHERE false")
def aud_02(s: SparkSession, d: str) -> DataFrame:
    return audit.broken(audit.chained(_log(s, d), "pair_id", ["at", "status"], "status"), "pair_id")
