"""Problem 5: text that looks the same but is stored as other characters.

``look`` gives every text one stored form.  Invisible characters go, special spaces become plain
ones, wide, narrow and joined forms are resolved and accents composed.  Then each token's letters
are resolved to the scripts they can be spelled in: the sets of all letters are intersected; a
token whose letters fit no single script as stored is mixed, one that fits a script through
look-alikes only is a whole-script confusable (``confusable_tokens`` lists both).  The first script, in
the order of ``SCRIPTS``, in which the whole token can be spelled gives the spelling; where there is none, the script with most
letters of its own does and the rest stays.

Visible differences stay: letter case, punctuation, accents, plain spaces, tabs and line breaks,
raised and lowered digits.  Joiners stay beside letters of scripts that they shape.

Defined cases: null stays null and looks like nothing else; an empty text looks like itself; a
record delivered several times is one, with the display text of its last delivery; equal strings
are no pair; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.confusables import SCRIPTS, SHAPES, Letters, basic, from_icu
from tessera.operators.records import latest, statements
from tessera.plans.workspace import Workspace

_INVISIBLE = [0xAD, 0x34F, 0x61C, 0x180E, 0xFEFF, 0x200B, 0x200E, 0x200F, *range(0x202A, 0x202F), *range(0x2060, 0x2065),
              *range(0x2066, 0x2070), *range(0xFE00, 0xFE10)]
#: Letters that joiners shape: Arabic to Mongolian.
_SHAPED = "؀-ࣿऀ-႟ក-᢯"
_LOOSE_JOINERS = re.compile(f"(?<![{_SHAPED}\u200c\u200d])[\u200c\u200d]+(?![{_SHAPED}\u200c\u200d])")
_FORMS = {"<wide>", "<narrow>", "<noBreak>", "<font>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>"}


#: Latin, and a token: letters and digits with the accents on them.
_LATIN_ONLY = re.compile("[\x00-\u024f\u0300-\u036f\u1e00-\u1eff\u2000-\u2bff]*\\Z")
_TOKEN = re.compile("[^\\W_]+(?:[\u0300-\u036f]+[^\\W_]*)*")
#: Long s and the letters joined with it differ visibly from s; so do ligatures of two letters from none.
_VISIBLE = frozenset("ſﬅϲϹϑϕϖϐϰϱϴϵ№")
KEPT = 200_000


class _Forms(dict):
    """A translation table that fills itself; it grows with the character set, not with the data."""

    def __init__(self, apart: frozenset[str]):
        super().__init__({**{i: i for i in range(128)}, **{i: None for i in _INVISIBLE}, 0x200C: 0x200C, 0x200D: 0x200D})
        self.apart = (apart - {"µ"}) | _VISIBLE

    def __missing__(self, code: int):
        to = self[code] = self.form(chr(code))
        return to

    def form(self, char: str) -> str:
        """One character without its compatibility form, where the form looks the same."""
        if unicodedata.category(char) == "Zs":
            return " "
        if char in "‐‑":
            return "-"
        kind = unicodedata.decomposition(char).split(" ")[0]
        if kind not in _FORMS or char in self.apart or kind == "<compat>" and unicodedata.category(char)[0] in "PZ":
            return char
        return unicodedata.normalize("NFKC", char)


class Reader:
    """Texts as they look, by a table of letters."""

    def __init__(self, letters: Letters):
        self.letters, self.forms, self.kept = letters, _Forms(letters.apart), {}
        own_shapes = "".join(c for c in letters.member if letters.own.get(c) == ("Latin",) and not c.isascii())
        self.shapes = re.compile(f"[{own_shapes}]") if own_shapes else None

    def __reduce__(self):
        return Reader, (self.letters,)

    def scripts(self, token: str) -> tuple[str, str | None]:
        """What a token's letters are as stored, and the first script in which it can be spelled whole.

        ``single``: of one script that look-alikes of another can't spell before it; ``whole``: of one script,
        but spelled in an earlier one; ``mixed``: of several scripts, no script holds all letters."""
        letters = [c for c in unicodedata.normalize("NFD", token) if c.isalpha()]
        if not letters:
            return "single", None
        held = frozenset.intersection(*[frozenset(self.letters.own.get(c, ("Other",))) for c in letters])
        common = frozenset.intersection(*[self.letters.scripts(c) or frozenset(("Other",)) for c in letters])
        first = next((s for s in SCRIPTS if s in common), None)
        if not held:
            return "mixed", first
        return ("single" if first is None or first in held else "whole"), first

    def consistent(self, token: str) -> str:
        """The token in the first script that can spell all its letters; where there is none, in that with
        most letters of its own, and the rest stays."""
        kept = self.kept.get(token)
        if kept is not None:
            return kept
        apart = unicodedata.normalize("NFD", token)
        _, to = self.scripts(token)
        if to is None:
            only = [next(iter(s)) for s in (self.letters.scripts(c) for c in apart if c.isalpha()) if len(s) == 1]
            to = max(SCRIPTS, key=lambda s: only.count(s)) if only else None
        out = token if to is None else unicodedata.normalize("NFC", "".join(self._plain(self.letters.spelled(c, to) or c) if c.isalpha() else c for c in apart))
        if len(self.kept) > KEPT:
            self.kept.clear()
        if len(token) <= 64:
            self.kept[token] = out
        return out

    def _plain(self, letter: str) -> str:
        name = self.letters.member.get(letter, "")
        return name if letter in SHAPES and name.isascii() and name else letter

    def look(self, text: str | None) -> str | None:
        """The one stored form of everything that looks like ``text``."""
        if text is None or text.isascii():
            return text
        t = text.translate(self.forms)
        if "\u200c" in t or "\u200d" in t:
            t = _LOOSE_JOINERS.sub("", t)
        if not t.isascii():
            t = unicodedata.normalize("NFC", t)
            if not _LATIN_ONLY.match(t) or self.shapes and self.shapes.search(t):
                t = _TOKEN.sub(lambda m: m[0] if m[0].isascii() else self.consistent(m[0]), t)
        return t


@cache
def plain_reader() -> Reader:
    return Reader(basic())


def reader(spark: SparkSession) -> Reader:
    """The reader with all letters of the Unicode list."""
    return Reader(from_icu(spark))


def look(text: str | None) -> str | None:
    """The look of a text by the small table of letters."""
    return plain_reader().look(text)


def digest(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


_LOOKS = T.StructType([T.StructField("look", T.BinaryType()), T.StructField("stored", T.BinaryType()), T.StructField("shown", T.BooleanType())])


def _looks(by: Reader):
    @F.pandas_udf(_LOOKS)
    def run(text: pd.Series, display: pd.Series) -> pd.DataFrame:
        seen, kept, shown = [], [], []
        for a, b in zip(text, display):
            form = by.look(a)
            seen.append(digest(form))
            kept.append(seen[-1] if form is a else digest(a))
            shown.append(bool(b) and b != a and by.look(b) == form)
        return pd.DataFrame({"look": seen, "stored": kept, "shown": shown})

    return run


def look_column(by: Reader):
    """A column function: text to the form in which all that looks like it is stored."""

    @F.pandas_udf(T.StringType())
    def run(text: pd.Series) -> pd.Series:
        return text.map(by.look, na_action="ignore")

    return run


def _is_ascii(c: str) -> Column:
    return F.octet_length(c) == F.length(c)


def looks(evidence: DataFrame) -> DataFrame:
    """One row per statement: digests of its look and of its stored text, and whether its last
    display text looks like it while stored differently.  Statements in plain ASCII don't leave the JVM."""
    by = _looks(reader(evidence.sparkSession))
    rows = statements(evidence, ["evidence_id", "loaded_at", "text", "display_text"])
    plain = _is_ascii("text") & (F.coalesce(F.col("display_text"), F.lit("")) == "")
    ascii_look = F.unhex(F.md5("text"))
    left = rows.where(plain).select("evidence_id", "loaded_at", ascii_look.alias("look"), ascii_look.alias("stored"), F.lit(False).alias("shown"))
    other = rows.where(~plain).select("evidence_id", "loaded_at", by("text", "display_text").alias("l")).select("evidence_id", "loaded_at", "l.look", "l.stored", "l.shown")
    return latest(left.unionByName(other), "evidence_id", ["shown", "look", "stored"])


def normalised(evidence: DataFrame) -> DataFrame:
    """(evidence_id, text): the statements' texts in the one form that everything looking like them shares."""
    by = look_column(reader(evidence.sparkSession))
    rows = latest(statements(evidence, ["evidence_id", "loaded_at", "text"]), "evidence_id", ["text"])
    return (rows.where(_is_ascii("text")).select("evidence_id", "text")
            .unionByName(rows.where(~_is_ascii("text")).select("evidence_id", by("text").alias("text"))))


def confusable_tokens(evidence: DataFrame) -> DataFrame:
    """(token, kind, script, statements): tokens of mixed scripts, and those of one script that are spelled in an earlier one."""
    by = reader(evidence.sparkSession)
    kinds = T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("script", T.StringType())]))

    @F.pandas_udf(kinds)
    def run(text: pd.Series) -> pd.Series:
        out = []
        for t in text:
            tokens = {m[0] for m in _TOKEN.finditer(unicodedata.normalize("NFC", t.translate(by.forms))) if not m[0].isascii()}
            found = [(w, *by.scripts(w)) for w in sorted(tokens)]
            out.append([{"token": w, "kind": k, "script": s} for w, k, s in found if k != "single"])
        return pd.Series(out)

    rows = latest(statements(evidence, ["evidence_id", "loaded_at", "text"]), "evidence_id", ["text"]).where(~_is_ascii("text"))
    return (rows.select("evidence_id", F.explode(run("text")).alias("t")).groupBy("t.token", "t.kind", "t.script")
            .agg(F.count(F.lit(1)).alias("statements")))


def found(evidence: DataFrame) -> DataFrame:
    """Pairs that look the same.  Stored spellings are paired first, once each, and then
    members are attached, so a spelling with very many copies is never compared with itself."""
    ws = Workspace(evidence.sparkSession, "lookalike")
    rows = ws.save(looks(evidence), "looks")
    spellings = rows.groupBy("look", "stored").agg(F.count(F.lit(1)).alias("n"))
    several = spellings.groupBy("look").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > 1).select("look")
    members = ws.save(rows.join(several, "look", "left_semi").select("evidence_id", "look", "stored"), "members")
    kinds = members.select("look", "stored").distinct()
    pairs = (kinds.withColumnRenamed("stored", "a").join(kinds.withColumnRenamed("stored", "b"), "look")
             .where(F.col("a") < F.col("b")))
    left = members.select("look", F.col("stored").alias("a"), F.col("evidence_id").alias("x"))
    right = members.select("look", F.col("stored").alias("b"), F.col("evidence_id").alias("y"))
    texts = pairs.join(left, ["look", "a"]).join(right, ["look", "b"]).select(
        F.lit("text").alias("field"), F.least("x", "y").alias("evidence_a"), F.greatest("x", "y").alias("evidence_b"))
    shown = rows.where("shown").select(F.lit("display_text").alias("field"), F.col("evidence_id").alias("evidence_a"), F.col("evidence_id").alias("evidence_b"))
    return texts.unionByName(shown)
