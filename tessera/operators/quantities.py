"""Problem 4: printed quantities as values in the canonical unit of their parameter.

A quantity's unit is ``unit_raw``; where that is blank, what follows the value in ``raw_text``; where
that is blank too, a unit directly after ``char_end`` in the evidence text.  What a spelling means,
its parameter, scale and offset, comes from ``unit_graph``: links between quantities that say the
same thing twice, robust estimates, snapped to exact conversions and carried from the canonical
units along the graph.  A missing ``parameter`` costs nothing.  A printed value is read where
``value`` is missing: ``2 045``, ``0,61``, ``13,507.0``, ``25 3/4``.

Defined cases: ranges, values that cannot be read, units of no canonical parameter and quantities
without a unit give no row; a unit in running text that contradicts a given parameter is no unit;
repeated rows are one quantity; ``canonical_*`` of an earlier run is only one link among many; a lone comma before
three digits groups thousands unless flagged as decimal or after a leading zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.letters import plain_marks
from tessera.functions.unit_names import CANONICAL, text_pattern
from tessera.operators.unit_graph import conversions
from tessera.plans.workspace import Workspace

#: Characters of running text in which a unit is looked for; the longest spelling has fewer.
AHEAD = 40


def printed_value(text: Column, flags: Column) -> Column:
    """The number a text is, in any local way of printing it, or null (so for a range)."""
    t = F.regexp_replace(F.trim(F.regexp_replace(text, "[−–‒]", "-")), "^\\+", "")
    t = F.regexp_replace(t, "(?<=\\d)[\\s    '’](?=\\d{3}(?!\\d|/))", "")
    negative = F.when(t.startswith("-"), -1.0).otherwise(1.0)
    body = F.regexp_replace(t, "^-\\s*", "")
    decimal = F.array_contains(flags, "decimal_comma")
    plain = (F.when(body.rlike("^\\d+(\\.\\d+)?$|^\\.\\d+$"), body)
             .when(body.rlike("^\\d{1,3}(,\\d{3})+\\.\\d+$|^\\d{1,3}(,\\d{3}){2,}$"), F.replace(body, F.lit(",")))
             .when(body.rlike("^\\d{1,3}(\\.\\d{3})+,\\d+$"), F.replace(F.replace(body, F.lit(".")), F.lit(","), F.lit(".")))
             .when(body.rlike("^\\d{1,3}(\\.\\d{3}){2,}$"), F.replace(body, F.lit(".")))
             .when(body.rlike("^[1-9]\\d{0,2},\\d{3}$") & ~F.coalesce(decimal, F.lit(False)), F.replace(body, F.lit(",")))
             .when(body.rlike("^\\d*,\\d+$"), F.replace(body, F.lit(","), F.lit(".")))).try_cast("double")
    fraction = "^(?:(\\d+)[\\s  ]+)?(\\d+)[/⁄](\\d+)$"
    part = lambda i: F.regexp_extract(body, fraction, i).try_cast("double")
    mixed = F.when(body.rlike(fraction), F.coalesce(part(1), F.lit(0.0)) + F.try_divide(part(2), part(3)))
    return negative * F.coalesce(plain, mixed)


def unit_form(text: Column) -> Column:
    """A unit without careless marks around it, in the spelling of the table."""
    t = F.regexp_replace(F.trim(F.regexp_replace(plain_marks(text), " +", " ")), "^[.,;:\\s]+|[.,;:\\s]+$", "")
    return F.regexp_replace(t, "^[(\\[] *([^()\\[\\]]*?) *[)\\]]$", "$1")


def printed(quantities: DataFrame) -> DataFrame:
    """One row per quantity of one readable value: number, spelling of its unit, and what it is tied to."""
    blank = lambda c: F.when(F.trim(unit_form(c)) != "", c)
    given = F.when(~F.isnan("value"), F.col("value"))
    none = lambda c: F.isnull(c) | F.isnan(c)
    single = quantities.where(F.col("quantity_id").isNotNull() & none("value_min") & none("value_max"))
    rest = F.when(F.startswith("raw_text", "value_text"), F.expr("substring(raw_text, length(value_text) + 1)"))
    return (single.select("quantity_id", "evidence_id", "parameter", "char_end", "alternate_of", "canonical_unit", "canonical_value",
                          F.coalesce(given, printed_value(F.col("value_text"), F.col("flags"))).alias("number"),
                          unit_form(F.coalesce(blank(F.col("unit_raw")), blank(rest))).alias("form"))
            .where(F.col("number").isNotNull()).groupBy("quantity_id")
            .agg(F.max(F.struct("number", "form", "evidence_id", "parameter", "char_end", "alternate_of", "canonical_unit", "canonical_value")).alias("q"))
            .select("quantity_id", "q.*"))


def same_things(rows: DataFrame) -> DataFrame:
    """Links (u, x, v, y): dual statements, and values with what an earlier run made of them."""
    here = rows.where(F.col("form").isNotNull())
    told = here.select(F.col("quantity_id").alias("alternate_of"), F.col("form").alias("v"), F.col("number").alias("y"))
    dual = here.where(F.col("alternate_of").isNotNull()).select("alternate_of", F.col("form").alias("u"), F.col("number").alias("x")).join(told, "alternate_of")
    earlier = here.where(F.col("canonical_unit").isNotNull() & F.col("canonical_value").isNotNull() & ~F.isnan("canonical_value")).select(
        F.col("form").alias("u"), F.col("number").alias("x"), unit_form(F.col("canonical_unit")).alias("v"), F.col("canonical_value").alias("y"))
    return dual.select("u", "x", "v", "y").unionByName(earlier)


def found(quantities: DataFrame, evidence: DataFrame, canonical: DataFrame) -> DataFrame:
    ws = Workspace(quantities.sparkSession, "quantities")
    canonical = canonical.where(F.col("parameter").isin(*CANONICAL)).select("parameter", "canonical_unit").distinct()
    rows = ws.save(printed(quantities), "printed")
    anchors = canonical.select(unit_form(F.col("canonical_unit")).alias("form"), F.col("parameter").alias("measures"))
    units = ws.save(conversions(same_things(rows), canonical, anchors, ws), "units")
    # A text never changes, so any delivery serves.
    texts = evidence.where(F.col("text").isNotNull()).select("evidence_id", "text")
    asked = rows.where(F.col("form").isNull() & F.col("char_end").isNotNull()).select("quantity_id", "number", "evidence_id", "parameter", "char_end")
    after = F.expr(f"substring(text, char_end + 1, {AHEAD})")
    named = (asked.join(texts, "evidence_id").select("quantity_id", "number", "parameter", after.alias("after")).groupBy("quantity_id")
             .agg(F.max(F.struct("number", "parameter", "after")).alias("q")).select("quantity_id", "q.number", "q.parameter",
                  F.regexp_extract(plain_marks(F.col("q.after")), text_pattern(), 1).alias("form"), F.lit(True).alias("read")))
    all_rows = (rows.where(F.col("form").isNotNull()).select("quantity_id", "number", "parameter", "form", F.lit(False).alias("read"))
                .unionByName(named.where(F.col("form") != "")))
    # Spellings of the table are a fixed number and are broadcast; the others go through a shuffle.
    fields = ["form", "measures", "canonical_unit", "scale", "offset"]
    met = all_rows.join(F.broadcast(units.where("spelled").select(*fields, F.lit(True).alias("met"))), "form", "left")
    new = met.where(F.col("met").isNull()).select(*all_rows.columns).join(units.where(~F.col("spelled")).select(*fields), "form")
    done = met.where("met").drop("met").unionByName(new)
    done = done.where(~F.col("read") | F.col("parameter").isNull() | (F.col("parameter") == F.col("measures")))
    return done.select("quantity_id", "canonical_unit", F.round((F.col("number") * F.col("scale") + F.col("offset")) * 1000.0).cast("long").alias("canonical_milli"))
