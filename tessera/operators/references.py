"""Problem 3: references that lead to no living, registered record, from signed counts kept per key.

Two ledgers are maintained.  One holds the standing state of every record: when it was last
delivered, whether it lives, and the keys it refers to.  A batch of deliveries is held against it, and
what changed goes as signed deltas into the other, which counts per key: +1 or -1 reference where a
record begins or ceases to refer to it, +1 registered when its record first appears, +1 or -1 living
when that record comes to life, is deleted or comes back.  A delivery older than the standing state, or
equal to it, changes nothing, so batches may overlap or come in any order.  Keys with references and
no living record, or with a reference older than their record, are the orphan keys; only the
references to those are looked up.

``first_ref`` of a key is the earliest time anybody referred to it and is not taken back with a
reference; it only says which keys to look at, every reference is then judged by its own time.

Hot keys (one target that a third of all rows refer to) are combined before the shuffle and looked
up through a bounded broadcast.

Defined cases: a null or empty id is no reference; a record delivered several times refers once;
ties of delivery go to the greatest state (so deleted wins over living where it sorts last); empty
tables give no rows; missing creation times never make a reference late; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ledger import Ledgers, buckets_for
from tessera.operators.records import lookup_skewed
from tessera.plans.workspace import Workspace

_REF = "struct<field:string,key:string>"
_STATE = f"id string, at timestamp, state string, alive int, created timestamp, born timestamp, refs array<{_REF}>"
_DELTA = "key string, refs long, registered long, living long, first_ref timestamp, born timestamp"
LONG_AGO = "1000-01-01"


def deliveries_of(df: DataFrame, table: str, key: str, state: str, created: str, dead: Column | None, fields: dict[str, str]) -> DataFrame:
    """Rows of a table as deliveries of records: ``dead`` says when a record of the table counts as
    deleted (None: nothing refers to the table); ``fields`` are the referring fields and their targets."""
    at = F.coalesce(F.col("loaded_at"), F.lit(LONG_AGO).cast("timestamp"))
    refs = F.filter(F.array(*[F.struct(F.lit(f).alias("field"), F.when(F.col(f) != "", F.concat(F.lit(f"{t}:"), F.col(f))).alias("key")) for f, t in fields.items()]),
                    lambda r: r["key"].isNotNull())
    alive = F.lit(None).cast("int") if dead is None else F.when(F.coalesce(dead, F.lit(False)), 0).otherwise(1)
    return df.where(F.col(key).isNotNull()).select(
        F.concat(F.lit(f"{table}:"), F.col(key)).alias("id"), at.alias("at"), F.col(state).cast("string").alias("state"),
        alive.alias("alive"), F.col(created).alias("created"), F.when(alive.isNotNull(), F.col(created)).alias("born"), refs.alias("refs"))


def deliveries(sources: DataFrame, evidence: DataFrame, near: DataFrame) -> DataFrame:
    """The deliveries of all three tables with their four referring fields."""
    return (deliveries_of(near, "near_duplicates", "pair_id", "status", "created_at", None, {"evidence_a": "evidence", "evidence_b": "evidence"})
            .unionByName(deliveries_of(evidence, "evidence", "evidence_id", "status", "created_at", F.col("status") == "superseded", {"canonical_evidence_id": "evidence"}))
            .unionByName(deliveries_of(sources, "sources", "source_id", "present", "first_seen_at", F.col("present") == 0, {"duplicate_of": "sources"})))


class ReferenceLedger:
    """Standing states and signed counts, maintained batch by batch."""

    def __init__(self, ws: Workspace, rows: int, at: str | None = None):
        n = buckets_for(rows)
        self.ledgers = Ledgers(ws, "ledger", at)
        self.states = self.ledgers.table("states", "id", _STATE, n)
        self.counts = self.ledgers.table("counts", "key", _DELTA, n)

    def apply(self, batch: DataFrame) -> None:
        """Takes in a batch of deliveries."""
        fields = ["at", "state", "alive", "created", "born", "refs"]
        last = batch.groupBy("id").agg(F.max(F.struct(*fields)).alias("s")).select("id", "s.*")
        staged, touched = self.states.stage(last, _STATE)
        old = self.states.read(touched)
        both = old.select("id", F.struct(*fields).alias("o")).join(staged.select("id", F.struct(*fields).alias("n")), "id", "full_outer")
        newer = F.col("n").isNotNull() & (F.col("o").isNull() | (F.struct("n.at", "n.state") > F.struct("o.at", "o.state")))
        moved = both.where(newer)
        one, zero, none = F.lit(1).cast("long"), F.lit(0).cast("long"), F.lit(None).cast("timestamp")

        def delta(key: Column, refs: Column, registered: Column, living: Column, first_ref: Column, born: Column) -> Column:
            return F.struct(key.alias("key"), refs.cast("long").alias("refs"), registered.cast("long").alias("registered"),
                            living.cast("long").alias("living"), first_ref.alias("first_ref"), born.alias("born"))

        before = F.coalesce(F.col("o.refs"), F.array().cast(f"array<{_REF}>"))
        gained = F.transform(F.array_except("n.refs", before), lambda r: delta(r["key"], one, zero, zero, F.col("n.created"), none))
        lost = F.transform(F.array_except(before, "n.refs"), lambda r: delta(r["key"], -one, zero, zero, none, none))
        was = F.coalesce("o.alive", F.lit(0))
        exists = F.array(delta(F.col("id"), zero, F.when(F.col("o.alive").isNull(), one).otherwise(zero), F.col("n.alive") - was, none, F.col("n.born")))
        existence = F.when(F.col("n.alive").isNotNull() & (F.col("o.alive").isNull() | (F.col("n.alive") != was)), exists).otherwise(F.filter(exists, lambda _: F.lit(False)))
        changes = moved.select(F.explode(F.concat(gained, lost, existence)).alias("d")).select("d.*")
        add, keys = self.counts.stage(self._sum(changes), _DELTA)
        self.counts.replace(self._sum(self.counts.read(keys).unionByName(add)), keys)
        self.states.replace(both.select("id", F.when(newer, F.col("n")).otherwise(F.col("o")).alias("s")).select("id", "s.*"), touched)
        self.ledgers.commit()

    @staticmethod
    def _sum(deltas: DataFrame) -> DataFrame:
        return deltas.groupBy("key").agg(F.sum("refs").alias("refs"), F.sum("registered").alias("registered"), F.sum("living").alias("living"),
                                         F.min("first_ref").alias("first_ref"), F.min("born").alias("born"))

    def references(self) -> DataFrame:
        """The references that stand now."""
        named = F.split_part(F.col("id"), F.lit(":"), F.lit(1))
        return self.states.read().where(F.size("refs") > 0).select("id", "created", F.explode("refs").alias("r")).select(
            named.alias("ref_table"), F.col("r.field").alias("ref_field"), F.expr("substring(id, instr(id, ':') + 1)").alias("ref_id"),
            F.col("r.key").alias("key"), "created")

    def orphans(self, total: int) -> DataFrame:
        """The references that lead to no living, already registered record."""
        bad = self.counts.read().where((F.col("refs") > 0) & ((F.col("living") <= 0) | (F.col("born") > F.col("first_ref"))))
        met = lookup_skewed(self.references(), bad.select("key", "refs", "registered", "living", "born"), "key", F.col("refs"), total)
        state = (F.when(F.col("registered") <= 0, "missing").when(F.col("living") <= 0, "deleted")
                 .when(F.col("born") > F.col("created"), "late"))
        return met.select("ref_table", "ref_field", "ref_id", F.date_format("created", "yyyy-MM").alias("period"),
                          state.alias("state")).where(F.col("state").isNotNull())


def found(sources: DataFrame, evidence: DataFrame, near: DataFrame) -> DataFrame:
    """Orphans after all deliveries, taken in quarter by quarter."""
    ws = Workspace(sources.sparkSession, "references")
    quarter = F.date_format(F.trunc("at", "quarter"), "yyyy-MM")
    every = ws.save(deliveries(sources, evidence, near).withColumn("quarter", quarter), "deliveries", ["quarter"])
    sizes = every.groupBy("quarter").count().collect()  # one row per quarter
    rows = sum(r["count"] for r in sizes)
    ledger = ReferenceLedger(ws, rows)
    for q in sorted(r["quarter"] for r in sizes):
        ledger.apply(every.where(F.col("quarter") == q).drop("quarter"))
    ws.drop(every)
    return ledger.orphans(2 * rows)


def report(sources: DataFrame, evidence: DataFrame, near: DataFrame) -> DataFrame:
    """Orphans per referring table, field, month and state."""
    return found(sources, evidence, near).groupBy("ref_table", "ref_field", "period", "state").agg(F.count(F.lit(1)).alias("orphans"))
