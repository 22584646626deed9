"""Problem 4 in SQL, with the exact conversions of the table of spellings."""

from __future__ import annotations

from tessera.functions import letters
from tessera.functions.unit_names import spellings, text_pattern
from tessera.operators.quantities import AHEAD
from tessera.plans.sql import quoted


def plain_marks(x: str) -> str:
    source, target = letters.translation()
    out = f"regexp_replace(translate({x}, {quoted(source)}, {quoted(target)}), '\\bmW\\b', 'milliwatt', 'g')"
    return f"lower(replace(replace({out}, '℃', '°C'), '℉', '°F'))"


def unit_form(x: str) -> str:
    bare = f"regexp_replace(trim(regexp_replace({plain_marks(x)}, ' +', ' ', 'g')), '^[.,;:\\s]+|[.,;:\\s]+$', '', 'g')"
    return f"regexp_replace({bare}, '^[(\\[] *([^()\\[\\]]*?) *[)\\]]$', '\\1')"


def _number() -> str:
    plain = "regexp_replace(trim(regexp_replace(value_text, '[−–‒]', '-', 'g')), '^\\+', '')"
    for _ in range(3):  # groups of thousands: without look-around, every second one at a time
        plain = f"regexp_replace({plain}, '([0-9])[\\s   ''’]([0-9]{{3}})([^0-9/]|$)', '\\1\\2\\3', 'g')"
    return plain


def statement() -> str:
    table = ", ".join(f"({quoted(f)}, '{p}', {s!r}::double, {o!r}::double)" for f, (p, s, o) in spellings().items())
    inside = text_pattern().replace("(?![\\p{L}\\p{N}]|/\\p{L})", "(?:[^\\p{L}\\p{N}/]|/(?:[^\\p{L}]|$)|$)")
    blank = lambda c: f"CASE WHEN trim({unit_form(c)}) <> '' THEN {c} END"
    fraction = "'^(?:([0-9]+)[\\s  ]+)?([0-9]+)[/⁄]([0-9]+)$'"
    return f"""WITH units(form, measures, scale, off) AS (VALUES {table}),
one AS (SELECT *, CASE WHEN starts_with(raw_text, value_text) THEN substring(raw_text, length(value_text) + 1) END AS rest, {_number()} AS t FROM quantities
 WHERE quantity_id IS NOT NULL AND (value_min IS NULL OR isnan(value_min)) AND (value_max IS NULL OR isnan(value_max))),
two AS (SELECT *, regexp_replace(t, '^-\\s*', '') AS b, CASE WHEN starts_with(t, '-') THEN -1.0 ELSE 1.0 END::double AS sign FROM one),
three AS (SELECT *, coalesce(CASE WHEN NOT isnan(value) THEN value END, sign * coalesce(
  CASE WHEN regexp_matches(b, '^[0-9]+(\\.[0-9]+)?$|^\\.[0-9]+$') THEN try_cast(b AS double)
   WHEN regexp_matches(b, '^[0-9]{{1,3}}(,[0-9]{{3}})+\\.[0-9]+$|^[0-9]{{1,3}}(,[0-9]{{3}}){{2,}}$') THEN try_cast(replace(b, ',', '') AS double)
   WHEN regexp_matches(b, '^[0-9]{{1,3}}(\\.[0-9]{{3}})+,[0-9]+$') THEN try_cast(replace(replace(b, '.', ''), ',', '.') AS double)
   WHEN regexp_matches(b, '^[0-9]{{1,3}}(\\.[0-9]{{3}}){{2,}}$') THEN try_cast(replace(b, '.', '') AS double)
   WHEN regexp_matches(b, '^[1-9][0-9]{{0,2}},[0-9]{{3}}$') AND NOT coalesce(list_contains(flags, 'decimal_comma'), false) THEN try_cast(replace(b, ',', '') AS double)
   WHEN regexp_matches(b, '^[0-9]*,[0-9]+$') THEN try_cast(replace(b, ',', '.') AS double) END,
  CASE WHEN regexp_matches(b, {fraction}) AND try_cast(regexp_extract(b, {fraction}, 3) AS double) <> 0
   THEN coalesce(try_cast(regexp_extract(b, {fraction}, 1) AS double), 0) + regexp_extract(b, {fraction}, 2)::double / regexp_extract(b, {fraction}, 3)::double END)) AS number FROM two),
rows_ AS (SELECT quantity_id, evidence_id, parameter, char_end, number, CASE WHEN coalesce({blank('unit_raw')}, {blank('rest')}) IS NOT NULL THEN {unit_form(f"coalesce({blank('unit_raw')}, {blank('rest')})")} END AS form
 FROM three WHERE number IS NOT NULL QUALIFY row_number() OVER (PARTITION BY quantity_id ORDER BY number DESC, form DESC NULLS LAST, evidence_id DESC NULLS LAST) = 1),
texts AS (SELECT evidence_id, min(text) AS text FROM evidence WHERE text IS NOT NULL GROUP BY 1),
named AS (SELECT quantity_id, number, parameter, regexp_extract({plain_marks(f"substring(text, char_end + 1, {AHEAD})")}, {quoted(inside)}, 1) AS form FROM rows_ JOIN texts ON texts.evidence_id = rows_.evidence_id WHERE form IS NULL AND char_end IS NOT NULL),
every AS (SELECT quantity_id, number, parameter, form, false AS read FROM rows_ WHERE form IS NOT NULL UNION ALL SELECT quantity_id, number, parameter, form, true FROM named WHERE form <> '')
SELECT quantity_id, canonical_unit, round((number * scale + off) * 1000)::bigint AS canonical_milli FROM every JOIN units ON units.form = every.form
JOIN (SELECT DISTINCT parameter AS p, canonical_unit FROM canonical_units) c ON c.p = measures WHERE NOT read OR every.parameter IS NULL OR every.parameter = measures"""
