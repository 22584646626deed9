"""Hash chains over logs: each entry's hash covers the one before it.

A chain is verified in parallel, each entry against the one before by a join on its number; only making a
chain goes entry by entry, so logs are chained per entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GENESIS = "0" * 64


def entry_hash(before: Column, payload: Column) -> Column:
    return F.sha2(F.concat(before, F.lit("|"), payload), 256)


def chained(log: DataFrame, entity: str, order: list[str], payload: str) -> DataFrame:
    """(entity, number, payload, prev_hash, entry_hash): the entries of each entity in order, chained.

    An entity's entries are folded in one place, as each needs the one before."""
    entries = log.where(F.col(entity).isNotNull() & F.col(payload).isNotNull()).groupBy(entity).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(payload).alias("_p")))).alias("_entries"))
    empty = F.array().cast("array<struct<payload:string,prev_hash:string,entry_hash:string>>")

    def step(done: Column, x: Column) -> Column:
        last = F.coalesce(F.try_element_at(done, F.lit(-1))["entry_hash"], F.lit(GENESIS))
        return F.concat(done, F.array(F.struct(x["_p"].alias("payload"), last.alias("prev_hash"), entry_hash(last, x["_p"]).alias("entry_hash"))))

    links = entries.select(entity, F.posexplode(F.aggregate("_entries", empty, step)).alias("number", "_x"))
    return links.select(entity, (F.col("number") + 1).cast("bigint").alias("number"), "_x.*")


def broken(chain: DataFrame, entity: str) -> DataFrame:
    """(entity, number) of the first entry of each chain whose hash or predecessor is not right."""
    before = chain.select(entity, (F.col("number") + 1).alias("number"), F.col("entry_hash").alias("_before"))
    held = chain.join(before, [entity, "number"], "left").withColumn("_before", F.when(F.col("number") == 1, F.lit(GENESIS)).otherwise(F.col("_before")))
    bad = F.coalesce(F.col("prev_hash") != F.col("_before"), F.lit(True)) | F.coalesce(F.col("entry_hash") != entry_hash(F.col("prev_hash"), F.col("payload")), F.lit(True))
    return held.where(bad).groupBy(entity).agg(F.min("number").alias("number"))
