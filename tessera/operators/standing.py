"""The register as it stands: one row per record, with the values of its last delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Block types by what they hold.
SAFETY = ("danger", "warning", "caution", "notice")
ADMONITIONS = (*SAFETY, "note")
DEDUPE = ("paragraph", "list_item", "table", *ADMONITIONS, "caption")


def standing(df: DataFrame, key: str, columns: list[str], state: str, at: str = "loaded_at") -> DataFrame:
    """``key`` and ``columns`` of the last delivery of each record; ties go to the greatest ``state``.

    An aggregation with partial combine, so a record that is delivered very often gathers in no task."""
    names = [c for c in dict.fromkeys(columns) if c != key]
    last = F.max(F.struct(F.col(at).alias("_at"), F.col(state).alias("_state"), *[F.col(c) for c in names]))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(last.alias("_s")).select(key, *[F.col(f"_s.{c}").alias(c) for c in names])


def evidence(df: DataFrame, *columns: str) -> DataFrame:
    return standing(df, "evidence_id", list(columns), "status")


def sources(df: DataFrame, *columns: str) -> DataFrame:
    return standing(df, "source_id", list(columns), "present")


def near(df: DataFrame, *columns: str) -> DataFrame:
    return standing(df, "pair_id", list(columns), "status")


def quantities(df: DataFrame, *columns: str) -> DataFrame:
    """Repeated rows of a quantity are one."""
    names = list(dict.fromkeys(columns))
    return df.where(F.col("quantity_id").isNotNull()).groupBy("quantity_id").agg(F.max(F.struct(*names)).alias("_s")).select(
        "quantity_id", *[F.col(f"_s.{c}").alias(c) for c in names])


def effective(wording: Column | str, text: Column | str) -> Column:
    """A reviewer's wording if there is one; an empty one is none."""
    wording = F.col(wording) if isinstance(wording, str) else wording
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.nullif(wording, F.lit("")), text)
