"""Pieces of SQL that say what the operators of the register say."""

from __future__ import annotations

import unicodedata

from tessera.functions import text as t

#: One row per record, with the values of its last delivery.
STANDING = """
ev AS (SELECT * FROM evidence WHERE evidence_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY loaded_at DESC NULLS LAST, status DESC NULLS LAST) = 1),
src AS (SELECT * FROM sources WHERE source_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY loaded_at DESC NULLS LAST, present DESC NULLS LAST) = 1),
nd AS (SELECT * FROM near_duplicates WHERE pair_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY loaded_at DESC NULLS LAST, status DESC NULLS LAST) = 1),
qty AS (SELECT * FROM quantities WHERE quantity_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY quantity_id ORDER BY evidence_id DESC) = 1)"""

SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'))"


def compose(x: str) -> str:
    """NFKC by tables made from the rule: single characters by translation, others one by one."""
    forms = [c for c in map(chr, [*range(0xA0, 0x250), *range(0x2000, 0x2500), *range(0x3000, 0x3001), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFFEF)])
             if unicodedata.decomposition(c).startswith("<") and unicodedata.normalize("NFKC", c) != c]
    one = [c for c in forms if len(unicodedata.normalize("NFKC", c)) == 1]
    more = [c for c in forms if len(unicodedata.normalize("NFKC", c)) > 1 and c in "¼½¾…№™℃℉ﬀﬁﬂﬃﬄﬅﬆ″‴‼⁇⁈⁉¨¯´¸"]
    out = f"translate({x}, {quoted(''.join(one))}, {quoted(''.join(unicodedata.normalize('NFKC', c) for c in one))})"
    for c in more:
        out = f"replace({out}, {quoted(c)}, {quoted(unicodedata.normalize('NFKC', c))})"
    return f"nfc_normalize({out})"


def normalised(x: str) -> str:
    marks = t.DASHES + t.SINGLE_QUOTES + t.DOUBLE_QUOTES + t.SOFT
    plain = "-" * len(t.DASHES) + "'" * len(t.SINGLE_QUOTES) + '"' * len(t.DOUBLE_QUOTES)
    folded = f"translate({compose(x)}, {quoted(marks)}, {quoted(plain)})"
    # No look-around: every second break of several in a row is joined by the second pass.
    joined = folded
    for _ in range(2):
        joined = f"regexp_replace({joined}, '([a-z])-\\n([a-z])', '\\1\\2', 'g')"
    return f"coalesce(lower({collapse(joined)}), '')"


def topic(x: str) -> str:
    return normalised(f"regexp_replace({x}, '^{SPACE}*(?:[0-9]{{1,2}}(?:\\.[0-9]{{1,2}}){{0,4}}\\.?|[A-Z]\\.|[IVX]+\\.){SPACE}+', '')")


def several(x: str) -> str:
    return f"list_sort(list_distinct(list_filter(list_transform(string_split({x}, ';'), lambda v: trim(v)), lambda v: v <> '')))"
