"""Problem 2: copies that differ in formatting only, through an incremental ledger.

Every statement gets a canonical key.  A ledger holds, in buckets of the key, how many records bear it,
the smallest id and the earliest representative; another holds, in buckets of the id, the records that
were counted.  A batch of deliveries is freed of records seen before, aggregated by key,
full-outer-joined to the buckets its keys fall into, and only those buckets are written anew.  So a
record that is delivered again, in the same batch or a later one, counts once, and a key's row is moved
only by batches that hold the key's bucket.  Members are read off by joining the records' keys to the
ledger rows with more than one record.

Defined cases: a null text, or one without any letter or digit, has no key and no copies; several
deliveries of a record count once; ties go to the smallest id; an empty table gives no rows; other
columns are ignored; a text of any length has a key of 16 bytes.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ledger import Ledgers, buckets_for
from tessera.operators.records import lookup_skewed, statements
from tessera.plans.workspace import Workspace

_WORD = r"\p{L}\p{M}\p{N}"


def _void(word: str, digit: str, minus: str) -> str:
    """What does not count: points and commas not between digits, minus signs not before a digit or directly
    after a letter or digit, and everything that is no letter, mark or digit."""
    return (rf"[^{word}.,{minus}]+|[.,](?:(?<![{digit}][.,])|(?![{digit}]))|[{minus}](?:(?<=[{word}][{minus}])|(?![{digit}]))")


_VOID = _void(_WORD, r"\p{N}", r"\-−")
#: Lower case spellings that upper case does not tell apart.
_FOLD = (("ß", "ss"), ("ς", "σ"))
FIELD_ENDS = r"[;|\r\n]"
#: Keys of nothing, of a text and of a table.
_NOTHING = tuple(hashlib.md5(x).digest() for x in (b"S", b"T"))
_RECORD = "evidence_id string, key binary, created_at timestamp"
_COUNT = "key binary, n long, group_id string, earliest struct<created_at: timestamp, evidence_id: string>"


def _bare(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, _VOID, ""), F.lit("−"), F.lit("-"))


def canonical(text: Column, block_type: Column) -> Column:
    """The text reduced to what counts; a table's fields in sorted order, empty ones left out."""
    low = F.lower(text)
    for a, b in _FOLD:
        low = F.replace(low, F.lit(a), F.lit(b))
    fields = F.array_sort(F.filter(F.transform(F.split(low, FIELD_ENDS), _bare), lambda x: x != ""))
    is_table = F.coalesce(block_type == "table", F.lit(False))
    return F.concat(F.when(is_table, F.lit("T")).otherwise(F.lit("S")), F.when(is_table, F.array_join(fields, "\u0001")).otherwise(_bare(low)))


def canonical_key(text: Column, block_type: Column) -> Column:
    """16 bytes, also for a text with nothing that counts: see ``has_key``."""
    return F.unhex(F.md5(canonical(text, block_type)))


def has_key(key: Column) -> Column:
    return key.isNotNull() & ~key.isin(*[F.lit(k) for k in _NOTHING])


class CopyLedger:
    """Counts and representatives per canonical key, and the records that are in them."""

    def __init__(self, ws: Workspace, rows: int, at: str | None = None):
        n = buckets_for(rows)
        self.ledgers = Ledgers(ws, "ledger", at)
        self.records = self.ledgers.table("records", "evidence_id", _RECORD, n)
        self.counts = self.ledgers.table("counts", "key", _COUNT, n)

    def apply(self, batch: DataFrame) -> None:
        """Takes in a batch of deliveries (key, evidence_id, created_at)."""
        rows = batch.groupBy("evidence_id").agg(F.min("key").alias("key"), F.min("created_at").alias("created_at")).where(has_key(F.col("key")))
        if self.records.parts:
            staged, touched = self.records.stage(rows, _RECORD)
            rows = staged.join(self.records.read(touched), "evidence_id", "left_anti")
        new = self.records.append(rows.select("evidence_id", "key", "created_at"))
        add = new.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("evidence_id").alias("group_id"),
                                     F.min(F.struct("created_at", "evidence_id")).alias("earliest"))
        if self.counts.parts:
            add, touched = self.counts.stage(add, _COUNT)
            both = self.counts.read(touched).alias("o").join(add.alias("n"), F.col("o.key") == F.col("n.key"), "full_outer")
            add = both.select(
                F.coalesce("o.key", "n.key").alias("key"),
                (F.coalesce("o.n", F.lit(0)) + F.coalesce("n.n", F.lit(0))).alias("n"),
                F.least("o.group_id", "n.group_id").alias("group_id"),
                F.least("o.earliest", "n.earliest").alias("earliest"))
        else:
            touched = []
        self.counts.replace(add, touched)
        self.ledgers.commit()


def build_ledger(evidence: DataFrame) -> tuple[CopyLedger, int]:
    """The ledger after all deliveries, taken in quarter by quarter, and the number of deliveries."""
    ws = Workspace(evidence.sparkSession, "copies")
    quarter = F.coalesce(F.date_format(F.trunc("loaded_at", "quarter"), "yyyy-MM"), F.lit("none"))
    keyed = statements(evidence, ["evidence_id", canonical_key(F.col("text"), F.col("block_type")).alias("key"), "created_at", quarter.alias("quarter")])
    every = ws.save(keyed, "deliveries", ["quarter"])
    sizes = every.groupBy("quarter").count().collect()  # one row per quarter
    total = sum(r["count"] for r in sizes)
    ledger = CopyLedger(ws, total)
    for q in sorted(r["quarter"] for r in sizes):
        ledger.apply(every.where(F.col("quarter") == q))
    ws.drop(every)
    return ledger, total


def found(evidence: DataFrame) -> DataFrame:
    ledger, total = build_ledger(evidence)
    groups = ledger.counts.read().where(F.col("n") > 1).select("key", "n", "group_id")
    return lookup_skewed(ledger.records.read().select("evidence_id", "key"), groups, "key", F.col("n"), total).select("evidence_id", "group_id")


def collapsed(evidence: DataFrame) -> DataFrame:
    """One record per text: the smallest id, the earliest record and the number of copies."""
    ledger, _ = build_ledger(evidence)
    return ledger.counts.read().select("group_id", F.col("earliest.evidence_id").alias("earliest_id"), F.col("n").alias("copies"))
