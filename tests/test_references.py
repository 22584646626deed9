"""Problem 3: orphans, whole and batch by batch."""

from tables import clashing, day, evidence, near, nulls, sources
from tessera.operators import references
from tessera.operators.references import ReferenceLedger, deliveries
from tessera.plans.workspace import Workspace


def found(df):
    return {(r["ref_field"], r["ref_id"], r["period"], r["state"]) for r in df.collect()}


def tables(spark):
    e = evidence(
        spark, {"evidence_id": "A"}, {"evidence_id": "B", "canonical_evidence_id": "A"}, {"evidence_id": "C", "canonical_evidence_id": "GONE"},
        {"evidence_id": "D", "loaded_at": day(1)}, {"evidence_id": "D", "status": "superseded", "loaded_at": day(100)},
        {"evidence_id": "L", "created_at": day(50), "loaded_at": day(60)}, {"evidence_id": "X", "canonical_evidence_id": ""},
        {"evidence_id": "B", "canonical_evidence_id": "A", "loaded_at": day(120)},
        # deleted, then back
        {"evidence_id": "R", "status": "superseded", "loaded_at": day(2)}, {"evidence_id": "R", "loaded_at": day(130)})
    n = near(spark, {"pair_id": "1", "evidence_a": "A", "evidence_b": "D"}, {"pair_id": "2", "evidence_a": "L", "evidence_b": "R"},
             {"pair_id": "3", "evidence_a": None, "evidence_b": "NO", "loaded_at": day(140)}, {"pair_id": "1", "evidence_a": "A", "evidence_b": "D", "loaded_at": day(150)})
    s = sources(spark, {"source_id": "S1", "duplicate_of": "S2"}, {"source_id": "S2", "present": 0}, {"source_id": "S3", "duplicate_of": ""}, {"source_id": "S4", "duplicate_of": "S9"})
    return s, e, n


WANTED = {("canonical_evidence_id", "C", "2025-01", "missing"), ("evidence_b", "1", "2025-01", "deleted"), ("evidence_a", "2", "2025-01", "late"),
          ("evidence_b", "3", "2025-01", "missing"), ("duplicate_of", "S1", "2025-01", "deleted"), ("duplicate_of", "S4", "2025-01", "missing")}


def test_found(spark):
    assert found(references.found(*tables(spark))) == WANTED


def test_nulls_and_clashing_columns(spark):
    assert found(references.found(*[clashing(nulls(t)) for t in tables(spark)])) == WANTED


def test_batches_in_any_order_and_twice(spark):
    every = deliveries(*tables(spark))
    parts = [every.where(f"pmod(hash(id, at), 3) = {i}") for i in range(3)]
    for order in ((0, 1, 2), (2, 1, 0, 1, 2)):
        ledger = ReferenceLedger(Workspace(spark, "test"), 500_000)
        for i in order:
            ledger.apply(parts[i])
        assert found(ledger.orphans(100)) == WANTED
        counts = {r["key"]: (r["refs"], r["registered"], r["living"]) for r in ledger.counts.read().collect()}
        assert counts["evidence:D"] == (1, 1, 0) and counts["evidence:R"] == (1, 1, 1) and counts["evidence:GONE"] == (1, 0, 0)


def test_deletion_is_a_negative_delta(spark):
    ledger = ReferenceLedger(Workspace(spark, "test"), 500_000)
    none = sources(spark).limit(0)
    ledger.apply(deliveries(none, evidence(spark, {"evidence_id": "A"}), near(spark, {"pair_id": "1", "evidence_a": "A"})))
    assert found(ledger.orphans(9)) == set()
    ledger.apply(deliveries(none, evidence(spark, {"evidence_id": "A", "status": "superseded", "loaded_at": day(9)}), near(spark).limit(0)))
    assert found(ledger.orphans(9)) == {("evidence_a", "1", "2025-01", "deleted")}


def test_ledger_is_found_again_and_untouched_buckets_stay(spark, tmp_path):
    none, at = sources(spark).limit(0), f"file://{tmp_path}/kept"
    first = ReferenceLedger(Workspace(spark, "test"), 1_000_000, at)
    first.apply(deliveries(none, evidence(spark, *[{"evidence_id": f"E{i}"} for i in range(60)]), near(spark).limit(0)))
    before = dict(first.states.parts)
    again = ReferenceLedger(Workspace(spark, "test"), 1_000_000, at)
    again.apply(deliveries(none, evidence(spark, {"evidence_id": "E1", "status": "superseded", "loaded_at": day(9)}), near(spark).limit(0)))
    changed = [b for b in before if again.states.parts[b] != before[b]]
    assert len(changed) == 1 and again.states.read().count() == 60


def test_empty(spark):
    s, e, n = (t.limit(0) for t in tables(spark))
    assert references.found(s, e, n).count() == 0 and references.report(s, e, n).count() == 0
