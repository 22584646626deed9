"""Problem 8: everything once, nothing over the capacity, few containers, the wanted mixture."""

import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import packing
from tessera.plans.workspace import Workspace


def lengths(spark, n, seed=1):
    rng = random.Random(seed)
    rows = [(i, ("hot" if i % 3 == 0 else f"s{i % 5}"), rng.randint(0, 300)) for i in range(n)] + [(n, None, 5000), (n, None, 5000), (n + 1, "s1", 0)]
    return spark.createDataFrame(rows, "doc_id long, source string, tokens long"), rows


def test_best_fit():
    sizes = np.array([60, 50, 50, 40, 30, 30, 20, 20])
    at = packing.best_fit(sizes, 100)
    assert max(np.bincount(at, sizes)) <= 100 and len(set(at)) == 3


def check(out, rows, limits):
    wanted = sum(r[2] for r in rows)
    for limit, capacity in limits:
        one = out.where(F.col("limit_id") == limit)
        full = [r["t"] for r in one.groupBy("container_id").agg(F.sum("tokens").alias("t")).collect()]
        assert sum(full) == wanted and max(full) <= capacity and len(full) <= 1.02 * wanted / capacity + 2
        split = one.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.sum("tokens").alias("t")).where(f"k > 1 and t <= {capacity}")
        assert split.count() == 0


def test_everything_once(spark):
    df, rows = lengths(spark, 3000)
    limits = [(1, 512), (2, 4096)]
    check(packing.pack(df, limits, Workspace(spark, "test")), rows, limits)


def test_windows_have_the_mixture_of_the_whole(spark, monkeypatch):
    monkeypatch.setattr(packing, "CONTAINERS", 64)
    monkeypatch.setattr(packing, "BLOCK_ROWS", 500)
    df, rows = lengths(spark, 6000)
    limits = [(1, 512)]
    out = packing.pack(df, limits, Workspace(spark, "test"))
    check(out, rows, limits)
    every = sum(r[2] for r in rows)
    hot = sum(r[2] for r in rows if r[1] == "hot") / every
    shares = out.groupBy("mix_window").agg((F.sum(F.when(F.col("source") == "hot", F.col("tokens")).otherwise(0)) / F.sum("tokens")).alias("share")).collect()
    assert len(shares) > 15 and all(abs(r["share"] - hot) < 0.03 for r in shares)


def test_given_targets(spark, monkeypatch):
    monkeypatch.setattr(packing, "CONTAINERS", 64)
    rows = [(i, "a" if i % 2 else "b", 50) for i in range(8000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    out = packing.pack(df, [(1, 512)], Workspace(spark, "test"), {"a": 0.75, "b": 0.25})
    first = out.where("mix_window < 5").groupBy("source").agg(F.sum("tokens").alias("t")).collect()
    share = {r["source"]: r["t"] for r in first}
    assert abs(share["a"] / (share["a"] + share["b"]) - 0.75) < 0.01


def test_awkward(spark):
    docs = spark.createDataFrame([(1, "a", None), (2, None, ""), (3, None, " seal" * 1000), (3, None, " seal" * 1000)], "doc_id long, source string, text string").withColumn("tokens", F.lit("x"))
    limits = spark.createDataFrame([(1, 64), (1, 64), (2, None), (3, 0), (None, 128)], "limit_id int, capacity_tokens int").where("limit_id is not null")
    out = packing.packed(docs, limits)
    assert out.agg(F.sum("tokens")).first()[0] == 2000 and out.select("doc_id").distinct().count() == 1
    assert packing.packed(docs.limit(0), limits).count() == 0 and packing.packed(docs, limits.limit(0)).count() == 0
    assert packing.fill(out, limits).first()["fullest"] == 64
