"""Letters of other scripts that look like Latin ones, and plain spellings of short marks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of other scripts beside the Latin letters they look like.
LOOKS = {
    "Cyrillic": ("АВЕЅІЈКМНОРСТХУԌԚԜһаԁеіјӏорԛсѕԝхуҮ", "ABESIJKMHOPCTXYGQWhadeijlopqcswxyY"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϳϲ", "ABEZHIKMNOPTYXovjc"),
    "Armenian": ("ՕՍոսօհց", "OUnuohg"),
    "Cherokee": ("ᎪᎫᎬᎳᎻᎽᏀᏃᏎᏚᏞᏟᏢᏴᏔ", "AJEWMYGZ4SLCPBW"),
}

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_SPACES = "".join(map(chr, [0x09, 0x0A, 0x0D, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))
_GONE = "".join(map(chr, [0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF]))
_PLAIN = {"²": "2", "³": "3", "⁄": "/", "−": "-", "‐": "-", "‑": "-", "·": ".", "⋅": ".", "•": ".", "∙": ".", "*": ".", "×": ".", "µ": "u", "μ": "u", "º": "°", chr(0x212A): "K", chr(0x212B): "Å"}


def translation() -> tuple[str, str]:
    """Characters and what they become; those without a counterpart go."""
    source = "".join(o for o, _ in LOOKS.values()) + _WIDE + "".join(_PLAIN) + _SPACES + _GONE
    target = "".join(x for _, x in LOOKS.values()) + "".join(chr(ord(c) - 0xFEE0) for c in _WIDE) + "".join(_PLAIN.values()) + " " * len(_SPACES)
    return source, target


def plain_marks(text: Column) -> Column:
    """Units and numbers in one spelling: wide and look-alike letters to Latin, special spaces to
    plain ones, invisible characters away, lower case.  One pass in the JVM."""
    # Only the case tells milliwatt from megawatt; elsewhere it may be careless.
    folded = F.regexp_replace(F.translate(text, *translation()), "\\bmW\\b", "milliwatt")
    return F.lower(F.replace(F.replace(folded, F.lit("℃"), F.lit("°C")), F.lit("℉"), F.lit("°F")))
