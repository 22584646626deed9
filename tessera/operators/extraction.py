"""Quantities read from running text: where they stand, what they say and what that is in canonical units.

A text is folded character by character, so that places stay, and scanned once for numbers with a unit of the
table behind them: plain, with groups of thousands, with a decimal comma, as fractions, as ranges and with a
tolerance.  Dates, clock times and codes that run into a number are no numbers.  Words that are only units in a
column of their own (``in``, ``a``) are none here.

Defined cases: null and empty texts have no quantities; a number without a unit is none; a range gives its ends
and no value; a tolerance widens the value to a range and keeps it; a temperature's tolerance is a difference.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import letters
from tessera.functions.unit_names import CANONICAL, NOT_IN_TEXT, spellings

_GROUPED = r"\d{1,3}(?:[, '’]\d{3})+(?:\.\d+)?(?!\d)"
_NUMBER = rf"(?:\d+ \d+/\d+|\d+/\d+|{_GROUPED}|\d+(?:[.,]\d+)?)"
_DATE = re.compile(r"\b\d{4}-\d{1,2}-\d{1,2}\b|\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b|\b\d{1,2}:\d{2}(?::\d{2})?\b")
_QUALIFIER = re.compile(r"(max|min|approx|ca|at least|at most|up to|nominal)[a-z]*\.?[ :=]*$")
_KINDS = {"max": "max", "at most": "max", "up to": "max", "min": "min", "at least": "min", "approx": "approx", "ca": "approx", "nominal": "nominal"}
SCHEMA = ("evidence_id string, char_start int, char_end int, raw_text string, qualifier string, unit string, parameter string, value double, value_min double, value_max double, "
          "canonical_unit string, canonical_value double, canonical_min double, canonical_max double")


class Reader:
    """Scans texts by the table of spellings."""

    def __init__(self) -> None:
        known = spellings()
        # The degree signs of one character keep their place as marks of their own.
        self.units = {n: c for n, c in known.items() if n not in NOT_IN_TEXT} | {"\x01": known["°c"], "\x02": known["°f"]}
        names = sorted(self.units, key=lambda n: (-len(n), n))
        unit = "|".join(re.escape(n) for n in names)
        self.find = re.compile(rf"(?<![\w./,-])([-+]?)({_NUMBER})(?:( ?(?:-|to|\.\.\.) ?)({_NUMBER}))?(?: ?(?:\xb1|\+/-) ?({_NUMBER}))? ?({unit})(?![\w]|/\w)").finditer
        source, target = letters.translation()
        # Every character keeps its place: what would go becomes a space.
        self.table = {ord(c): (target[i] if i < len(target) else " ") for i, c in enumerate(source)} | {ord("–"): "-", ord("—"): "-", ord("℃"): "\x01", ord("℉"): "\x02", ord("…"): " "}

    def folded(self, text: str) -> str:
        low = re.sub(r"\bmW\b", "\x03W", text.translate(self.table))
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in low)
        return _DATE.sub(lambda m: "#" * len(m[0]), low)

    def quantities(self, text: str) -> Iterator[tuple]:
        plain = self.folded(text)
        for m in self.find(plain):
            sign, first, joint, second, spread, unit = m.groups()
            a = number(first)
            b = number(second) if second else None
            if a is None or second and b is None:
                continue
            if sign == "-":
                a = -a
            parameter, scale, offset = self.units[unit]
            value, low, high = a, None, None
            if b is not None:
                value, low, high = None, min(a, b), max(a, b)
            wide = number(spread) if spread else None
            if wide is not None and value is not None:
                low, high = a - wide, a + wide
            q = _QUALIFIER.search(plain, max(0, m.start() - 24), m.start())
            to = lambda x: None if x is None else scale * x + offset  # noqa: B023, E731
            yield (m.start(), m.end(), text[m.start():m.end()], _KINDS.get(q[1]) if q else None, {"\x01": "°c", "\x02": "°f"}.get(unit, unit), parameter, value, low, high, CANONICAL[parameter], to(value), to(low), to(high))


def number(text: str) -> float | None:
    """A number as printed, in any local way."""
    if "/" in text:
        whole, _, rest = text.rpartition(" ")
        top, bottom = rest.split("/")
        return float(whole or 0) + int(top) / int(bottom) if int(bottom) else None
    if re.fullmatch(_GROUPED, text):
        return float(re.sub(r"[, '’]", "", text))
    return float(text.replace(",", "."))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader, schema = Reader(), None
    kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 4, *[pa.float64()] * 3, pa.string(), *[pa.float64()] * 3]
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
    for batch in batches:
        rows = [(i, *q) for i, text in zip(batch.column("evidence_id").to_pylist(), batch.column("text").to_pylist()) if text for q in reader.quantities(text)]
        columns = list(zip(*rows)) if rows else [()] * len(names)
        schema = schema or pa.schema(list(zip(names, kinds)))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], schema=schema)


def extracted(evidence: DataFrame) -> DataFrame:
    """The quantities of all texts (evidence_id, text); texts without a digit don't leave the JVM."""
    return evidence.where(F.col("text").rlike("[0-9]")).select("evidence_id", "text").mapInArrow(_scan, SCHEMA)


def restatements(quantities: DataFrame) -> DataFrame:
    """Neighbouring quantities of one parameter, the second in brackets or after a slash, and how far apart they are."""
    a = quantities.where("canonical_value IS NOT NULL").select("evidence_id", F.col("char_start").alias("s"), F.col("char_end").alias("e"), "parameter", F.col("canonical_value").alias("first"))
    b = quantities.where("canonical_value IS NOT NULL").select("evidence_id", F.col("char_start").alias("start2"), F.col("parameter"), F.col("canonical_value").alias("second"))
    gap = F.col("start2") - F.col("e")
    return a.join(b, ["evidence_id", "parameter"]).where(gap.between(1, 3)).select("evidence_id", F.col("s").alias("char_start"), F.col("start2").alias("restated_at"),
                                                                                  F.round(F.try_divide(F.abs(F.col("first") - F.col("second")), F.abs("first")), 6).alias("off"))
