"""Letters of different scripts that look the same, as classes of equal skeletons.

The classes come from the Unicode list of confusable characters (UTS 39) by way of the ICU library that
Spark brings along: two letters of the same case are one class if ICU gives them one skeleton.  They are
asked for once, on the driver, and number a few thousand.  Scripts are ICU's script extensions, so a
letter may belong to several.  Without ICU the small table of ``BASIC`` letters is used.

Left out, because readers tell them apart: letters that differ from a letter of their own script only
(dotless i, long s, small capitals), and the Greek and Cyrillic letters of ``DISTINCT``.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import SparkSession

# Letters of other scripts beside the Latin letters they look like.
BASIC = {
    "Cyrillic": ("АВЕЅІЈКМНОРСТХУԌԚԜһаԁеіјӏорԛсѕԝхуҮ", "ABESIJKMHOPCTXYGQWhadeijlopqcswxyY"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϳϲ", "ABEZHIKMNOPTYXovjc"),
    "Armenian": ("ՕՍոսօհց", "OUnuohg"),
    "Cherokee": ("ᎪᎫᎬᎳᎷᎻᎽᏀᏃᏚᏞᏟᏢᏴᏔ", "AJEWMHYGZSLCPBW"),
}
# Unicode scripts (name and code) whose letters are looked at, in the order in which a spelling is chosen.
SCRIPTS = {"Latin": "Latn", "Cyrillic": "Cyrl", "Greek": "Grek", "Armenian": "Armn", "Cherokee": "Cher", "Coptic": "Copt", "Lisu": "Lisu",
           "Georgian": "Geor", "Tifinagh": "Tfng", "Osage": "Osge", "Deseret": "Dsrt", "Elbasan": "Elba", "Warang Citi": "Wara",
           "Old Italic": "Ital", "Lycian": "Lyci", "Carian": "Cari", "Runic": "Runr"}
# Letters that have a skeleton in common with others and are read as different ones.
DISTINCT = frozenset("αγικρσυϒϱϜбггЗзϨ")
#: Letters of the Latin script in another shape, which readers take for the plain one.
SHAPES = {"ɑ": "a", "ɡ": "g"}


class Letters:
    """For each letter its scripts and its class; for each class its letter in each script."""

    def __init__(self, own: dict[str, tuple[str, ...]], classes: dict[str, dict[str, str]], apart: frozenset[str] = frozenset()):
        self.own, self.apart = own, apart
        self.member = {c: name for name, letters in classes.items() for c in letters}
        self.spelling: dict[str, dict[str, str]] = {}
        for name, letters in classes.items():
            for c, script in letters.items():
                # The first letter of a script in code order is the one that is written.
                kept = self.spelling.setdefault(name, {})
                if script not in kept or (len(c), c) < (len(kept[script]), kept[script]):
                    kept[script] = c

    def scripts(self, letter: str) -> frozenset[str]:
        """The resolved script set: its own scripts and those in which its look-alikes are."""
        return frozenset(self.own.get(letter, ())) | frozenset(self.spelling.get(self.member.get(letter, ""), ()))

    def spelled(self, letter: str, script: str) -> str | None:
        """The letter as it is spelled in a script, or None."""
        if script in self.own.get(letter, ()):
            return letter
        return self.spelling.get(self.member.get(letter, ""), {}).get(script)


def _basic_own(char: str) -> tuple[str, ...]:
    code = ord(char)
    for name, low, high in (("Greek", 0x370, 0x3FF), ("Greek", 0x1F00, 0x1FFF), ("Cyrillic", 0x400, 0x52F), ("Armenian", 0x530, 0x58F), ("Cherokee", 0x13A0, 0x13FF)):
        if low <= code <= high:
            return (name,)
    return ("Latin",) if code < 0x250 or 0x1E00 <= code < 0x1F00 else ("Other",)


def basic() -> Letters:
    """The small table, for use without a session."""
    classes: dict[str, dict[str, str]] = {}
    for script, (letters, latin) in BASIC.items():
        for a, b in zip(letters, latin):
            classes.setdefault(b, {b: "Latin"})[a] = script
    chars = (chr(c) for c in (*range(0x41, 0x590), *range(0x13A0, 0x1400), *range(0x1E00, 0x2000)))
    return Letters({c: _basic_own(c) for c in chars if c.isalpha()}, classes)


def _skeletons(jvm, chars: list[str]) -> dict[str, str]:
    checker = jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    out: dict[str, str] = {}
    for i in range(0, len(chars), 20_000):
        part = chars[i:i + 20_000]
        found = checker.getSkeleton("\u0001".join(part)).split("\u0001")
        if len(found) != len(part):
            raise ValueError("skeletons do not match their characters")
        out.update(zip(part, found))
    return out


def _target(char: str, skeleton: str, plain: dict[str, list[str]]) -> str | None:
    """The name of a letter's class: the Latin letter of its case, else skeleton and case."""
    upper = char.isupper()
    if skeleton in plain:
        same = [x for x in plain[skeleton] if x.isalpha() and x.isupper() == upper]
        return same[0] if same else skeleton if skeleton.isalpha() else None
    return f"{skeleton}{'+' if upper else '-'}" if len(skeleton) == 1 else None


_made: list[Letters] = []


def from_icu(spark: SparkSession) -> Letters:
    """All classes, made once per driver."""
    if _made:
        return _made[0]
    try:
        made = _from_icu(spark._jvm)
    except (TypeError, AttributeError):  # no such class on the class path, or no JVM at hand
        made = basic()
    _made.append(made)
    return made


def _from_icu(jvm) -> Letters:
    own: dict[str, tuple[str, ...]] = {}
    for name, code in SCRIPTS.items():
        letters = jvm.com.ibm.icu.text.UnicodeSet(f"[[:scx={code}:]&[:L:]]")
        for i in range(letters.getRangeCount()):
            for c in map(chr, range(letters.getRangeStart(i), letters.getRangeEnd(i) + 1)):
                own[c] = (*own.get(c, ()), name)
    forms = [chr(c) for c in range(0xA0, 0x20000) if unicodedata.decomposition(chr(c)).startswith("<compat>")]
    # Compatibility forms that do not look like what they stand for.
    shown = _skeletons(jvm, forms)
    stand = {c: unicodedata.normalize("NFKC", c) for c in forms}
    checker = jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    meant = checker.getSkeleton("\u0001".join(stand[c] for c in forms)).split("\u0001")
    apart = frozenset(c for c, m in zip(forms, meant) if shown[c] != m) if len(meant) == len(forms) else frozenset()
    skeletons = _skeletons(jvm, sorted(own))
    plain: dict[str, list[str]] = {}
    for c in map(chr, range(0x41, 0x7B)):
        if c.isalpha():
            plain.setdefault(skeletons[c], []).append(c)
    grouped: dict[str, dict[str, str]] = {}
    for c, scripts in own.items():
        if c in DISTINCT or len(scripts) > 1 or unicodedata.decomposition(c) and c not in apart or (scripts[0] == "Latin" and not c.isascii() and c not in SHAPES):
            continue
        name = _target(c, skeletons[c], plain)
        if name:
            grouped.setdefault(name, {})[c] = scripts[0]
    classes = {name: letters for name, letters in grouped.items() if len(set(letters.values())) > 1 or any(c in SHAPES for c in letters)}
    return Letters(own, classes, apart)
