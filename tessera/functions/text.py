"""Text, date and number functions as column expressions.

White space means all Unicode white space unless said otherwise.  Null gives null, but for functions that
say otherwise.  Everything stays in the JVM; compatibility forms are resolved by the ICU library that
Spark brings along.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "[\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
# Marks that normalisation folds or drops.
SOFT = "­​‌‍﻿"
DASHES = "‐‑‒–—―−"
SINGLE_QUOTES, DOUBLE_QUOTES = "‘’‚‛", "“”„«»"
# Signal words and their levels.
SIGNALS = {"DANGER": "danger", "GEFAHR": "danger", "WARNING": "warning", "WARNUNG": "warning", "CAUTION": "caution", "VORSICHT": "caution",
           "NOTICE": "notice", "IMPORTANT": "notice", "ACHTUNG": "notice", "NOTE": "note", "HINWEIS": "note"}
NUMBERING = f"^{SPACE}*(?:[0-9]{{1,2}}(?:\\.[0-9]{{1,2}}){{0,4}}\\.?|[A-Z]\\.|[IVX]+\\.){SPACE}+"
LIST_ITEM = f"(?i)^{SPACE}*(?:\\(?[0-9]{{1,3}}[.)]|\\(?[a-z][.)]|step{SPACE}+[0-9]{{1,3}}{SPACE}*[:.)]?|[•●▪■◦–*·-]){SPACE}+[^\\t-\\r \\x{{A0}}]"
PAGE_NUMBER = f"(?i)^{SPACE}*(?:page{SPACE}*)?[-–]?{SPACE}*[0-9]{{1,4}}{SPACE}*(?:(?:of|/){SPACE}*[0-9]{{1,4}})?{SPACE}*[-–]?{SPACE}*$"
CAPTION = f"(?i)^(?:fig(?:ure)?\\.?|abb(?:ildung)?\\.?|diagram|illustration|drawing|table|tab\\.){SPACE}*[A-Z]?[0-9]+[0-9A-Za-z_.-]*"
BLANK_PAGE = f"(?i)this{SPACE}+page{SPACE}+(?:is{SPACE}+)?intentionally{SPACE}+(?:left{SPACE}+)?blank"


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def composed(text: Column) -> Column:
    """NFKC; plain ASCII is passed through."""
    wide = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(True))
    return F.when(text.isNull() | (F.octet_length(text) == F.length(text)), text).otherwise(wide)


def folded(text: Column) -> Column:
    """Soft marks away, dashes and quotes in one form each."""
    marks = DASHES + SINGLE_QUOTES + DOUBLE_QUOTES + SOFT
    return F.translate(text, marks, "-" * len(DASHES) + "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES))


def normalised(text: Column) -> Column:
    """The form under which texts are compared: compatibility forms, dashes, quotes, soft marks, hyphens at
    line ends, white space and case are made alike; digits, signs and units stay.  Null gives ''."""
    joined = F.regexp_replace(folded(composed(text)), "(?<=[a-z])-\n(?=[a-z])", "")
    return F.coalesce(F.lower(collapse(joined)), F.lit(""))


def norm_hash(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def squash(text: Column) -> Column:
    """Without any white space, for containment tests."""
    return F.regexp_replace(text, SPACE + "+", "")


def template(text: Column) -> Column:
    """Lower case with runs of digits as #: what repeats in headers and footers."""
    return collapse(F.regexp_replace(F.lower(text), "[0-9]+", "#"))


def topic(heading: Column) -> Column:
    """A heading without its numbering, normalised; null gives ''."""
    return normalised(F.regexp_replace(heading, NUMBERING, ""))


def numeric_tokens(text: Column) -> Column:
    """The numbers as printed, sorted: a sign counts unless a letter or digit stands before it."""
    t = F.translate(composed(text), DASHES, "-" * len(DASHES))
    # A hyphen after a letter or digit is no sign; a plus sign is no part of the number.
    signed = F.regexp_replace(t, "(?<=[\\p{L}\\p{N}])-(?=\\d)", "\u0002")
    tokens = F.regexp_extract_all(signed, F.lit("(?<![A-Za-z])[-+]?\\d+(?:[.,]\\d+)*"), F.lit(0))
    return F.array_sort(F.transform(tokens, lambda x: F.ltrim(x, F.lit("+"))))


def signal(text: Column) -> Column:
    """The safety level of a text that begins with a signal word: in capitals, or in any case before a colon."""
    words = "|".join(sorted(SIGNALS, key=lambda w: (-len(w), w)))
    capital = F.regexp_extract(text, f"^{SPACE}*({words})(?![0-9A-Za-z_])", 1)
    colon = F.regexp_extract(text, f"(?i)^{SPACE}*({words}){SPACE}*:", 1)
    levels = F.create_map(*[F.lit(x) for pair in SIGNALS.items() for x in pair])
    return levels[F.upper(F.when(capital != "", capital).otherwise(F.nullif(colon, F.lit(""))))]


def pattern_kind(text: Column) -> Column:
    """Which layout pattern a text has, if any."""
    return (F.when(text.rlike(PAGE_NUMBER), "page_number").when(text.rlike(CAPTION), "caption").when(text.rlike(BLANK_PAGE), "blank_notice")
            .when(text.rlike(LIST_ITEM), "list_item"))


def table_text(cells: Column) -> Column:
    """Cells joined by bars, rows by line breaks."""
    return F.array_join(F.transform(cells, lambda row: F.array_join(F.transform(row, lambda c: F.coalesce(c, F.lit(""))), " | ")), "\n")


def safe_name(text: Column, longest: int = 80) -> Column:
    """A file name of plain letters, digits, points, hyphens and underscores."""
    plain = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_"), "^[._]+|[._]+$", "")
    return F.when(plain == "", F.lit("file")).otherwise(F.substring(plain, 1, longest))


def escaped(text: Column) -> Column:
    """Marked-up text: & < > as entities."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def cell(text: Column, longest: int) -> Column:
    """A spreadsheet cell: no control characters, never a formula, cut at ``longest`` with a note."""
    plain = F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")
    safe = F.when(plain.rlike("^[=+@-]"), F.concat(F.lit("'"), plain)).otherwise(plain)
    return F.when(F.length(safe) > longest, F.concat(F.substring(safe, 1, longest - 15), F.lit(" ...[truncated]"))).otherwise(safe)


def several(text: Column) -> Column:
    """A list printed with semicolons, as a sorted set."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: x != "")))


# Months by the first three letters of their English names.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
LONG_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def normalised_date(raw: Column) -> Column:
    """struct(value, ambiguous): ISO where the notation says which date it is, else as printed."""
    s = F.trim(raw)
    month = F.create_map(*[F.lit(x) for i, m in enumerate(LONG_MONTHS, 1) for x in (m, i)], *[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, i) if m != "may"])

    def parts(pattern: str, *groups: int) -> list[Column]:
        return [F.regexp_extract(s, pattern, g) for g in groups]

    def iso(y: Column, m: Column, d: Column) -> Column:
        made = F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")
        return F.when(made.isNull(), F.struct(s.alias("value"), F.lit(True).alias("ambiguous"))).otherwise(
            F.struct(F.date_format(made, "yyyy-MM-dd").alias("value"), F.lit(False).alias("ambiguous")))

    def plain(value: Column, ambiguous: Column) -> Column:
        return F.struct(value.alias("value"), ambiguous.alias("ambiguous"))

    p_iso, p_num = "^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})$", "^([0-9]{1,2})[./]([0-9]{1,2})[./]([0-9]{4})$"
    p_dmy, p_mdy, p_my = "^([0-9]{1,2}) +([A-Za-z]+)\\.? +([0-9]{4})$", "^([A-Za-z]+)\\.? +([0-9]{1,2}),? +([0-9]{4})$", "^([A-Za-z]+)\\.? +([0-9]{4})$"
    y, m, d = parts(p_iso, 1, 2, 3)
    a, b, y2 = parts(p_num, 1, 2, 3)
    an, bn = a.try_cast("int"), b.try_cast("int")
    d3, m3, y3 = parts(p_dmy, 1, 2, 3)
    m4, d4, y4 = parts(p_mdy, 1, 2, 3)
    m5, y5 = parts(p_my, 1, 2)
    dotted = iso(y2, bn, an)
    return (F.when(s.rlike(p_iso), iso(y, m, d))
            .when(s.rlike(p_num) & (an > 12) & (bn <= 12), iso(y2, bn, an)).when(s.rlike(p_num) & (bn > 12) & (an <= 12), iso(y2, an, bn))
            .when(s.rlike(p_num) & s.contains("."), plain(dotted["value"], an != bn)).when(s.rlike(p_num), plain(s, an != bn))
            .when(s.rlike(p_dmy) & month[F.lower(m3)].isNotNull(), iso(y3, month[F.lower(m3)], d3))
            .when(s.rlike(p_mdy) & month[F.lower(m4)].isNotNull(), iso(y4, month[F.lower(m4)], d4))
            .when(s.rlike(p_my) & month[F.lower(m5)].isNotNull(), plain(F.concat(y5, F.lit("-"), F.lpad(month[F.lower(m5)].cast("string"), 2, "0")), F.lit(False)))
            .when(s.isNotNull(), plain(s, F.lit(False))))


def parsed_number(text: Column) -> Column:
    """A printed number: fractions, a comma as decimal mark or before groups of three digits; else null."""
    t = F.trim(F.translate(text, "  ", ""))
    whole, top, bottom = (F.regexp_extract(t, "^(?:([0-9]+) +)?([0-9]+)/([0-9]+)$", g).try_cast("double") for g in (1, 2, 3))
    return (F.when(t.contains("/"), F.when(t.rlike("^(?:[0-9]+ +)?[0-9]+/[0-9]+$"), F.coalesce(whole, F.lit(0.0)) + F.try_divide(top, bottom)))
            .when(t.rlike("^[0-9]{1,3}(?:,[0-9]{3})+(?:\\.[0-9]+)?$"), F.replace(t, F.lit(",")).try_cast("double"))
            .when(t.rlike("^[0-9]+,[0-9]+$"), F.replace(t, F.lit(","), F.lit(".")).try_cast("double"))
            .when(t.rlike("^-?[0-9]*\\.?[0-9]+$|^-?[0-9]+\\.$"), t.try_cast("double")))


def quality(text: Column) -> Column:
    """0 to 1: how plausible a text layer is.  Glyph references, replacement and private characters, control
    characters, words without a vowel, with five consonants in a row or in mixed case, and a lack of letters
    take away from 1; a blank text has 0."""
    count = lambda c, p: F.regexp_count(c, F.lit(p)).cast("double")
    glyphs, bare = count(text, "\\(cid:[0-9]+\\)"), F.regexp_replace(text, "\\(cid:[0-9]+\\)", "")
    visible = F.greatest(F.lit(1.0), F.length(squash(bare)).cast("double"))
    odd, control = count(bare, "[\\x{FFFD}\\x{E000}-\\x{F8FF}]"), count(bare, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F]")
    letters = count(bare, "\\p{L}")
    words = F.filter(F.regexp_extract_all(bare, F.lit("\\p{L}+"), F.lit(0)), lambda w: F.length(w) >= 3)
    judged = F.filter(words, lambda w: w.rlike("^[A-Za-z\\x{C0}-\\x{24F}]+$") & ~F.lower(w).isin(*NO_VOWEL) & ~((F.upper(w) == w) & (F.length(w) <= 5)))
    bad = F.filter(judged, lambda w: ~w.rlike("(?i)[aeiouyäöüàáâãåæèéêëìíîïòóôõøùúûýÿœ]") | w.rlike("(?i)[bcdfghjklmnpqrstvwxz]{5,}")
                   | ((F.length(w) > 3) & (F.regexp_count(F.substring(w, 2, 100_000), F.lit("\\p{Lu}")) >= 2) & (F.upper(w) != w)))
    share = F.coalesce(F.try_divide(F.size(bad), F.size(words)), F.lit(0.0))
    penalty = (F.least(F.lit(1.0), glyphs * 8 / F.length(text)) + F.least(F.lit(1.0), odd * 3 / visible) + F.least(F.lit(0.5), control * 3 / visible)
               + share * 1.2 + F.when((visible > 20) & (letters / visible < 0.25), (0.25 - letters / visible) * 1.5).otherwise(0.0))
    return F.when(squash(text) == "", F.lit(0.0)).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - penalty)), 3))


# Technical abbreviations without a vowel.
NO_VOWEL = ("nm", "psi", "kpa", "mpa", "rpm", "hp", "kw", "mm", "cm", "km", "ml", "pn", "qty", "nr", "st", "ltd", "lbs", "lb", "ft", "hz", "kv", "mv", "vdc", "vac", "gpm",
            "cst", "pcs", "cw", "ccw", "dn", "pvc", "ptfe", "npt", "bsp", "tbd", "sn", "dwg", "rh", "lh", "hmi", "plc", "gnd", "pwr", "nbr", "fkm")
