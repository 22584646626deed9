"""Deliveries to records, and joins that survive one hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Block types whose text states something (headings, page furniture and figure text do not).
STATEMENT_TYPES = ("paragraph", "list_item", "table", "danger", "warning", "caution", "notice", "note", "caption")

#: A key is hot when it holds more than this share of all rows; so at most 1/HOT_SHARE keys are hot.
HOT_SHARE = 1e-3


def latest(df: DataFrame, key: str, columns: list[str], at: str = "loaded_at") -> DataFrame:
    """One row per record with the values of its last delivery.

    An aggregation with partial combine, not a window: a record delivered a billion times never
    gathers in one task.  Ties of ``at`` go to the greatest values, so the result is defined.
    Rows without a key are no record and are left out.
    """
    fields = [F.col(c) for c in columns]
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max(F.struct(F.col(at).alias("_at"), *fields)).alias("_s"))
        .select(key, *[F.col(f"_s.{c}").alias(c) for c in columns])
    )


def statements(evidence: DataFrame, columns: list[str]) -> DataFrame:
    """Deliveries of statements: block types that carry a claim, with an id and a text."""
    return evidence.where(
        F.col("block_type").isin(*STATEMENT_TYPES) & F.col("evidence_id").isNotNull() & F.col("text").isNotNull()
    ).select(*columns)


def lookup_skewed(big: DataFrame, small: DataFrame, key: str, weight: Column, total: int, how: str = "inner") -> DataFrame:
    """Join ``big`` to ``small`` (one row per key) where a key may hold a large part of ``big``.

    ``weight`` is the number of rows of ``big`` that a row of ``small`` meets.  Keys above
    ``HOT_SHARE`` of ``total`` number at most ``1 / HOT_SHARE``, a proven bound, and are broadcast;
    the others go through an ordinary shuffle in which no key is large.
    """
    limit = max(1.0, HOT_SHARE * total)
    hot = small.where(weight > limit)
    cold = small.where(~(weight > limit))
    names = hot.select(F.col(key).alias("_hot"))
    is_hot = big.join(F.broadcast(names), F.col(key) == F.col("_hot"), "left")
    hot_rows = is_hot.where(F.col("_hot").isNotNull()).drop("_hot").join(F.broadcast(hot), key, "inner")
    cold_rows = is_hot.where(F.col("_hot").isNull()).drop("_hot").join(cold, key, how)
    return hot_rows.unionByName(cold_rows)
