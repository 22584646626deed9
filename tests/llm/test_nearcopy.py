"""Problem 6: pairs against brute force, near the threshold, in hot buckets and on awkward tables."""

import random

import numpy as np
from tables import clashing, day, evidence, nulls

from tessera.llm import nearcopy
from tessera.plans.workspace import Workspace


def sets_of(seed: int, bases: int, size: int, edits: int) -> dict[int, set[int]]:
    """Bases of common elements with a few rare ones, each with a copy whose rare ones are exchanged."""
    rng, out = np.random.default_rng(seed), {}
    for i in range(bases):
        base = set((rng.choice(60, size - edits - 2, replace=False) + 1).tolist()) | set(rng.integers(10**6, 2 * 10**9, edits + 2).tolist())
        rare = sorted(x for x in base if x >= 10**6)[:edits]
        out[2 * i + 1], out[2 * i + 2] = base, base - set(rare) | set(rng.integers(10**6, 2 * 10**9, edits).tolist())
    return out


def brute(sets: dict[int, set[int]]) -> set[tuple[int, int]]:
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
            if 2 * len(sets[a] & sets[b]) >= nearcopy.SIMILARITY * (len(sets[a]) + len(sets[b])) - 1e-9}


def joined(spark, sets):
    alone = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "bag long, elements array<int>")
    near = nearcopy.near_bags(alone, nearcopy.corpus_signer(alone), Workspace(spark, "test"))
    return {(r["a"], r["b"]) for r in near.collect()}


def test_pairs_whose_rare_words_are_exchanged(spark):
    sets = sets_of(1, 200, 40, 2)
    wanted = brute(sets)
    assert len(wanted) >= 200 and joined(spark, sets) == wanted


def test_recall_at_the_threshold_where_the_shared_words_are_common(spark):
    """Similarity exactly 0.85, and all that the pairs do not share is rare."""
    sets = sets_of(4, 400, 40, 6)
    wanted = brute(sets)
    found = joined(spark, sets)
    assert len(wanted) >= 400 and found <= wanted and len(found) >= 0.96 * len(wanted)


def test_bucket_size_costs_no_pairs(spark, monkeypatch):
    sets = sets_of(2, 60, 40, 5)
    small = joined(spark, sets)
    monkeypatch.setattr(nearcopy, "HOT_BUCKET", 2)
    monkeypatch.setattr(nearcopy, "SAMPLE", 1)
    assert joined(spark, sets) == small
    monkeypatch.setattr(nearcopy, "AT_ONCE", 1)
    assert joined(spark, sets) == small


def test_blocks_all_meet():
    bag, many = np.arange(50, dtype=np.int64), np.full(50, 4)
    row, key = nearcopy.blocks(np.full(50, 7, np.int64), bag, many)
    held = [set(key[row == i].tolist()) for i in range(50)]
    assert all(held[i] & held[j] for i in range(50) for j in range(50))


def test_buckets_over_several_batches():
    import pyarrow as pa
    key = np.sort(np.random.default_rng(1).integers(0, 30, 400))
    bag, zero = np.arange(400), np.zeros(400, np.int64)
    batches = [pa.RecordBatch.from_arrays([pa.array(x[i:i + 7]) for x in (key, bag, zero, zero.astype(np.int32))], names=["key", "bag", "parity", "size"]) for i in range(0, 400, 7)]
    got = {(a, b) for out in nearcopy._meeting(iter(batches)) for a, b in zip(out.column("a").to_pylist(), out.column("b").to_pylist())}
    assert got == {(i, j) for i in range(400) for j in range(i + 1, 400) if key[i] == key[j]}


def test_wide_buckets_are_compared_as_small_ones(monkeypatch):
    rng = np.random.default_rng(3)
    key, size = np.repeat(np.arange(4), [300, 2, 90, 65]), rng.integers(5, 60, 457).astype(np.int32)
    parity, bag = (np.int64(1) << rng.integers(0, 12, 457)) ^ (np.int64(1) << rng.integers(0, 12, 457)), rng.permutation(457)
    monkeypatch.setattr(nearcopy, "ACROSS", 70)
    got = []
    for wide in (nearcopy.WIDE, 1000):
        monkeypatch.setattr(nearcopy, "WIDE", wide)
        got.append([p for out in nearcopy._within(key, bag, parity, size) for p in zip(out.column("a").to_pylist(), out.column("b").to_pylist())])
    assert len(got[0]) > 1000 and sorted(got[0]) == sorted(got[1])


def flat(sets) -> tuple[np.ndarray, np.ndarray]:
    return np.array([x for s in sets for x in sorted(s)], np.int32), np.cumsum([0, *map(len, sets)])


def test_signatures_do_not_depend_on_other_texts():
    rng = np.random.default_rng(5)
    sets = [set(rng.integers(0, 5000, n).tolist()) for n in (3, 40, 3000, 1, 1500, 40)]
    signer = nearcopy.Signer({7: 0.1}, 4.0, 5)
    together = signer.sign(*flat(sets))
    assert together.shape == (6, 5 * nearcopy.keys_for(5)) and len(np.unique(together)) > 200
    assert all((signer.sign(*flat([s]))[0] == together[n]).all() for n, s in enumerate(sets))


def alike(texts: int) -> list[set[int]]:
    """Sets of 30 of 40 common elements and ten rare ones: any two are alike, none are near."""
    rng = np.random.default_rng(6)
    common = np.argsort(rng.random((texts, 40)), axis=1)[:, :30] + 1
    return [set(x) for x in np.hstack([common, rng.integers(10**6, 2 * 10**9, (texts, 10))]).tolist()]


def test_comparisons_of_a_text_grow_far_slower_than_the_table(spark):
    """Keys of one length for all tables make them grow as the table does."""
    each = []
    for texts in (2_000, 32_000):
        sets = alike(texts)
        bag = np.random.default_rng(7).permutation(texts).tolist()
        alone = spark.createDataFrame([(b, list(s)) for b, s in zip(bag, sets)], "bag long, elements array<int>")
        signer = nearcopy.suited(alone, [nearcopy.Signer({}, 1.0, table=1)])[0]
        n = np.unique(signer.keys(signer.sign(*flat(sets))), return_counts=True)[1]
        each.append(int((n * (n - 1) // 2).sum()) / texts)
    assert each[1] < 8 * each[0]


def test_key_lengths_miss_no_more():
    p = nearcopy.SIMILARITY / (2 - nearcopy.SIMILARITY)
    assert all((1 - p**k) ** nearcopy.keys_for(k) <= nearcopy.MISSED for k in nearcopy.LENGTHS)
    shares = [0.13**k for k in nearcopy.LENGTHS]
    lengths = [nearcopy.cheapest_length(shares, n) for n in (10**4, 10**7, 10**9)]
    assert lengths == sorted(set(lengths))


def test_weights_do_not_depend_on_partitions(spark):
    rows = [(k % 5, 3, [1, 2, 3 + k % 5]) for k in range(40)]
    weights = []
    for n in (1, 7):
        sets = spark.createDataFrame(rows, "bag long, size int, elements array<int>").repartition(n)
        weights.append(nearcopy.corpus_signer(nearcopy.different_sets(sets)).common)
    assert weights[0] == weights[1] and len(weights[0]) == 7


def texts(seed=7):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    out = {}
    for i in range(60):
        words = rng.choices(vocabulary, k=rng.randint(8, 40))
        out[f"A{i:03d}"] = " ".join(words)
        edited = list(words)
        edited[rng.randrange(len(words))] = "new"
        out[f"B{i:03d}"] = "  ".join(edited).upper()
        rng.shuffle(words)
        out[f"C{i:03d}"] = ", ".join(words)
    return out


def test_found(spark):
    from collections import Counter
    made = texts()
    bags = {k: Counter(t.lower().replace(",", "").split()) for k, t in made.items()}
    bare = {k: "".join(c for c in t.lower() if c.isalnum()) for k, t in made.items()}
    ids = sorted(made)
    wanted = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if bare[a] != bare[b]
              and 2 * sum((bags[a] & bags[b]).values()) >= 0.85 * (sum(bags[a].values()) + sum(bags[b].values())) - 1e-9}
    e = evidence(spark, *[{"evidence_id": k, "text": t} for k, t in made.items()], {"evidence_id": "N", "text": None}, {"evidence_id": "O", "text": "?!"}, {"evidence_id": "P", "text": ""},
                 {"evidence_id": "A000", "text": made["A000"], "loaded_at": day(99)}, {"evidence_id": "H", "block_type": "heading", "text": made["A001"]},
                 {"evidence_id": "L1", "text": "long text " * 30_000}, {"evidence_id": "L2", "text": "text long " * 30_000})
    for df in (e, clashing(nulls(e))):
        assert {tuple(r) for r in nearcopy.found(df).collect()} == wanted | {("L1", "L2")}
    assert nearcopy.found(e.limit(0)).count() == 0
    rows = {r["evidence_id"]: r for r in nearcopy.classes(e).collect()}
    assert rows["A000"]["members"] == 2 and rows["C000"]["class_id"] == "A000" and rows["L2"]["class_id"] == "L1"
