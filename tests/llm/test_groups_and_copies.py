"""Problems 1 and 2."""

import random

from pyspark.sql import functions as F
from tables import clashing, day, evidence, near, nulls

from tessera.llm import copies, groups
from tessera.llm.copies import CopyLedger, canonical_key
from tessera.plans.workspace import Workspace


def union_find(links):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    return {x: find(x) for x in top}


def grouped(spark, links, **more):
    df = spark.createDataFrame(links, "a string, b string")
    return {r["id"]: r["group_id"] for r in groups.connected_groups(df, **more).collect()}


def test_random_graphs(spark):
    rng = random.Random(3)
    links = [(f"v{rng.randint(0, 400)}", f"v{rng.randint(0, 400)}") for _ in range(330)] + [("hub", f"h{i}") for i in range(200)]
    assert grouped(spark, links + [(b, a) for a, b in links[:50]]) == union_find([x for x in links if x[0] != x[1]])


def test_ordered_chain_stays_linear(spark):
    n, sizes = 3000, []
    got = grouped(spark, [(f"{i:06d}", f"{i + 1:06d}") for i in range(n)], sizes=sizes)
    assert set(got.values()) == {"000000"} and len(got) == n + 1 and max(sizes) <= 2.1 * n and len(sizes) < 20


def test_no_links(spark):
    assert grouped(spark, [("a", "a"), (None, "b"), ("c", None)]) == {} and grouped(spark, []) == {}


def test_found_groups(spark):
    e = evidence(spark, {"evidence_id": "A"}, {"evidence_id": "B"}, {"evidence_id": "C", "canonical_evidence_id": "B"}, {"evidence_id": "D", "canonical_evidence_id": "NONE"}, {"evidence_id": "E"})
    n = near(spark, {"pair_id": "1", "evidence_a": "B", "evidence_b": "A"}, {"pair_id": "2", "evidence_a": "D", "evidence_b": "E"},
             {"pair_id": "2", "evidence_a": "D", "evidence_b": "E", "status": "stale", "loaded_at": day(5)}, {"pair_id": "3", "evidence_a": "A", "evidence_b": "A"}, {"pair_id": "4", "evidence_a": "A", "evidence_b": "GONE"})
    wanted = {("A", "A"), ("B", "A"), ("C", "A")}
    for a, b in ((e, n), (clashing(nulls(e)), clashing(nulls(n)))):
        assert {tuple(r) for r in groups.found(a, b).collect()} == wanted
    assert groups.found(e.limit(0), n.limit(0)).count() == 0


TEXTS = {"A": "Torque 3.5 Nm (max.)", "B": "TORQUE 3.5 nm max", "C": "torque 35 Nm max", "D": "set to -5 °C", "E": "set to 5 °C", "F": "Straße", "G": "STRASSE", "H": "...", "I": "", "J": None}


def test_found_copies(spark):
    rows = [{"evidence_id": k, "text": t} for k, t in TEXTS.items()] + [
        {"evidence_id": "T1", "block_type": "table", "text": "Bolt; 5 mm |  "}, {"evidence_id": "T2", "block_type": "table", "text": "5mm\nBOLT"}, {"evidence_id": "P", "text": "5mm bolt"},
        {"evidence_id": "X", "block_type": "heading", "text": "Straße"}, {"evidence_id": "A", "text": TEXTS["A"], "loaded_at": day(300)},
        {"evidence_id": "L1", "text": "long. " * 40_000}, {"evidence_id": "L2", "text": "LONG " * 40_000}]
    wanted = {("A", "A"), ("B", "A"), ("F", "F"), ("G", "F"), ("T1", "T1"), ("T2", "T1"), ("L1", "L1"), ("L2", "L1")}
    e = evidence(spark, *rows)
    for df in (e, clashing(nulls(e))):
        assert {tuple(r) for r in copies.found(df).collect()} == wanted
    assert {(r["group_id"], r["copies"]) for r in copies.collapsed(e).collect()} >= {("A", 2), ("C", 1), ("T1", 2)}
    assert copies.found(e.limit(0)).count() == 0


def test_ledger_in_batches_equals_the_whole(spark):
    rng = random.Random(5)
    rows = [{"evidence_id": f"E{i % 60:02d}", "text": f"Text {i % 60 % 17}!", "created_at": day(i % 60)} for i in range(150)]
    rng.shuffle(rows)
    keyed = evidence(spark, *rows).select("evidence_id", canonical_key(F.col("text"), F.col("block_type")).alias("key"), "created_at")
    out = []
    for parts in (1, 4):
        ledger = CopyLedger(Workspace(spark, "test"), 1_000_000)
        for i in range(parts):
            batch = keyed.where(f"pmod(hash(evidence_id, created_at, {i}), 1) = 0") if parts == 1 else keyed.where(f"pmod(hash(evidence_id), 4) = {i} or pmod(hash(evidence_id), 4) = {i} - 1")
            ledger.apply(batch)
        out.append({(bytes(r["key"]), r["n"], r["group_id"], r["earliest"]["evidence_id"]) for r in ledger.counts.read().collect()})
    assert out[0] == out[1] and sum(n for _, n, _, _ in out[0]) == 60


def test_untouched_buckets_are_not_rewritten(spark):
    ledger = CopyLedger(Workspace(spark, "test"), 1_000_000)
    rows = evidence(spark, *[{"evidence_id": f"E{i}", "text": f"t {i}"} for i in range(80)]).select("evidence_id", canonical_key(F.col("text"), F.col("block_type")).alias("key"), "created_at")
    ledger.apply(rows)
    before = dict(ledger.counts.parts)
    ledger.apply(evidence(spark, {"evidence_id": "NEW", "text": "t 3"}).select("evidence_id", canonical_key(F.col("text"), F.col("block_type")).alias("key"), "created_at"))
    assert sum(before[b] != ledger.counts.parts[b] for b in before) == 1
