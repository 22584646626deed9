"""Problems 5 and 6 in SQL: the look of a text by the small table of letters, and an exact join by rare words.

The look leaves aside what SQL cannot take apart (composed letters of other scripts); the near-duplicate
statement is exact: a pair that reaches the similarity shares at least one of the rarest elements of both,
as many as its sizes allow to be left out, and all pairs that share one are compared.
"""

from __future__ import annotations

import unicodedata

from tessera.llm.confusables import BASIC
from tessera.llm.lookalike import _FORMS, _INVISIBLE, _VISIBLE

_FROM = "".join(a for a, _ in BASIC.values())
_TO = "".join(b for _, b in BASIC.values())


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _forms() -> tuple[str, str]:
    """Characters with a form of one character that looks the same, made by the rule of ``lookalike``."""
    one = []
    for c in map(chr, [*range(0xA0, 0x3100), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFFEF)]):
        kind = unicodedata.decomposition(c).split(" ")[0]
        if unicodedata.category(c) == "Zs":
            one.append((c, " "))
        elif c in "‐‑":
            one.append((c, "-"))
        elif kind in _FORMS and c not in _VISIBLE and not (kind == "<compat>" and unicodedata.category(c)[0] in "PZ") and len(unicodedata.normalize("NFKC", c)) == 1:
            one.append((c, unicodedata.normalize("NFKC", c)))
    gone = "".join(map(chr, _INVISIBLE)) + "‌‍"
    return "".join(a for a, _ in one) + gone, "".join(b for _, b in one)


def look(x: str) -> str:
    source, target = _forms()
    plain = f"translate({x}, {_q(source)}, {_q(target)})"
    for c in "ﬀﬁﬂﬃﬄ℃℉":
        plain = f"replace({plain}, '{c}', '{unicodedata.normalize('NFKC', c)}')"
    spelled = f"^(?:[\\p{{Latin}}\\p{{M}}\\p{{N}}]|[{_FROM}])+$"
    return (f"array_to_string(list_transform(regexp_extract_all(nfc_normalize({plain}), '[\\p{{L}}\\p{{M}}\\p{{N}}]+|[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), "
            f"lambda w: CASE WHEN regexp_matches(w, {_q(spelled)}) THEN translate(w, {_q(_FROM)}, {_q(_TO)}) ELSE w END), '')")


_TYPES = "('paragraph', 'list_item', 'table', 'danger', 'warning', 'caution', 'notice', 'note', 'caption')"

P5 = f"""WITH s AS (SELECT evidence_id, text, display_text FROM evidence WHERE evidence_id IS NOT NULL AND text IS NOT NULL AND block_type IN {_TYPES}
 QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY loaded_at DESC NULLS LAST, display_text DESC NULLS LAST) = 1),
l AS (SELECT *, {look('text')} AS look FROM s)
SELECT 'text' AS field, a.evidence_id AS evidence_a, b.evidence_id AS evidence_b FROM l a JOIN l b ON a.look = b.look AND a.text <> b.text AND a.evidence_id < b.evidence_id
UNION ALL SELECT 'display_text', evidence_id, evidence_id FROM l WHERE display_text <> '' AND display_text <> text AND {look('display_text')} = look"""


def p6(keys: str) -> str:
    """``keys`` are the tables of problem 2, of which ``keys`` (evidence_id, key) is one."""
    return f"""WITH {keys},
s AS (SELECT evidence_id, any_value(text) AS text FROM evidence WHERE evidence_id IS NOT NULL AND text IS NOT NULL AND block_type IN {_TYPES} GROUP BY 1),
l AS (SELECT s.evidence_id, keys.key, {look('text')} AS look FROM s JOIN keys ON keys.evidence_id = s.evidence_id),
u AS (SELECT look, row_number() OVER (ORDER BY look) AS u, regexp_extract_all(lower(look), '[\\p{{L}}\\p{{N}}]+') AS words FROM (SELECT DISTINCT look FROM l)),
w AS (SELECT u, unnest(words) AS word FROM u),
el AS (SELECT u, word, row_number() OVER (PARTITION BY u, word) AS nth FROM w),
n AS (SELECT u, count(*) AS n FROM el GROUP BY 1),
f AS (SELECT word, nth, count(*) AS f FROM el GROUP BY 1, 2),
r AS (SELECT el.*, n, row_number() OVER (PARTITION BY el.u ORDER BY f, el.word, el.nth) AS place FROM el JOIN n ON n.u = el.u JOIN f ON f.word = el.word AND f.nth = el.nth),
p AS (SELECT * FROM r WHERE place <= n - ceil(n * 0.85 / 1.15 - 1e-9) + 1),
c AS (SELECT DISTINCT a.u AS a, b.u AS b, a.n AS na, b.n AS nb FROM p a JOIN p b ON a.word = b.word AND a.nth = b.nth AND a.u < b.u WHERE least(a.n, b.n) >= 0.85 / 1.15 * greatest(a.n, b.n) - 1e-9),
o AS (SELECT c.a, c.b FROM c JOIN el x ON x.u = c.a JOIN el y ON y.u = c.b AND y.word = x.word AND y.nth = x.nth GROUP BY c.a, c.b, c.na, c.nb HAVING 2 * count(*) >= 0.85 * (na + nb) - 1e-9),
m AS (SELECT l.evidence_id, l.key, u.u FROM l JOIN u ON u.look = l.look)
SELECT least(x.evidence_id, y.evidence_id) AS evidence_a, greatest(x.evidence_id, y.evidence_id) AS evidence_b FROM o JOIN m x ON x.u = o.a JOIN m y ON y.u = o.b WHERE x.key <> y.key"""
