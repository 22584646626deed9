"""Problem 1: pairwise matches to groups, by seed-tree pruning.

Ids become 64-bit vertices by a hash (a collision, which is looked for, means another salt), so a round
moves longs, and the order of vertices has nothing to do with that of ids: a chain whose ids ascend,
as ids of pages and sequences do, is pruned as fast as any other.

Each round every vertex learns the smallest vertex of its neighbourhood and passes it to all its
neighbours.  A vertex that nobody, itself included, took as a minimum leaves the graph and hangs
below the smallest it heard of; the others it heard of are tied to that one and go on.  The dropped
edges form a forest whose roots are the smallest vertices of their groups.  When no edge is left, the
roots flow down the forest, round by round in reverse, and each group is given its smallest id.

All steps are aggregations with partial combine and joins against a written table of one row per
vertex, whose other side the adaptive skew join splits where a hub is hot; group ids of very large
groups are looked up through a bounded broadcast.

Defined cases: null or equal ends are no link; repeated and reversed links count once; an empty
link table gives an empty result; other columns of the inputs are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.records import latest, lookup_skewed
from tessera.plans.workspace import Workspace

LINKING = ("candidate", "confirmed_duplicate")
SALTS = 8


def _vertex(column: str, salt: int) -> Column:
    return F.xxhash64(F.col(column), F.lit(salt))


def _both_ways(a: str, b: str) -> Column:
    return F.explode(F.array(F.struct(F.col(a).alias("u"), F.col(b).alias("v")), F.struct(F.col(b).alias("u"), F.col(a).alias("v"))))


def vertices(links: DataFrame, ws: Workspace) -> tuple[DataFrame, int]:
    """(id, vertex) of all ids in links, and the salt under which no two ids share a vertex."""
    ids = ws.save(links.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    for salt in range(SALTS):
        named = ids.select("id", _vertex("id", salt).alias("vertex"))
        if named.groupBy("vertex").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            return named, salt
    raise RuntimeError(f"ids share 64-bit vertices under each of {SALTS} salts")


def connected_groups(links: DataFrame, max_rounds: int = 64, sizes: list[int] | None = None) -> DataFrame:
    """(a, b) links to (id, group_id): group_id is the smallest id reachable, itself included.

    ``sizes``, if given, gets the number of directed edges of each round."""
    ws = Workspace(links.sparkSession, "groups")
    pair = ws.save(links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select("a", "b"), "pairs")
    named, salt = vertices(pair, ws)
    graph = ws.save(pair.select(_vertex("a", salt).alias("a"), _vertex("b", salt).alias("b")).select(_both_ways("a", "b").alias("e")).select("e.*").distinct(), "graph")
    ws.drop(pair)
    forest: list[DataFrame] = []
    for _ in range(max_rounds):
        if graph.isEmpty():
            break
        if sizes is not None:
            sizes.append(graph.count())
        nearest = ws.save(graph.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least")), "nearest")
        heard = ws.save(
            graph.join(nearest, "u").select(F.col("v").alias("x"), "least")
            .unionByName(nearest.select(F.col("u").alias("x"), "least")).distinct(), "heard")
        best = ws.save(heard.groupBy("x").agg(F.min("least").alias("best"), F.max(F.col("x") == F.col("least")).alias("seed")), "best")
        forest.append(ws.save(best.where(~F.col("seed")).select(F.col("x").alias("child"), F.col("best").alias("parent")), "forest"))
        tied = heard.join(best.select("x", "best"), "x").where(F.col("least") != F.col("best"))
        after = ws.save(tied.select(_both_ways("least", "best").alias("e")).select("e.*").distinct(), "graph")
        for old in (graph, nearest, heard, best):
            ws.drop(old)
        graph = after
    else:
        raise RuntimeError(f"links did not settle in {max_rounds} rounds")
    return _named(named, _flow_down(forest, ws), ws)


def _flow_down(forest: list[DataFrame], ws: Workspace) -> DataFrame | None:
    """(vertex, root) of all vertices but the roots; what was dropped last lies nearest to a root."""
    levels: list[DataFrame] = []
    for level in reversed(forest):
        here = level
        if levels:
            above = reduce(DataFrame.unionByName, levels).select(F.col("vertex").alias("parent"), "root")
            here = level.join(above, "parent", "left")
        else:
            here = level.withColumn("root", F.lit(None).cast("long"))
        levels.append(ws.save(here.select(F.col("child").alias("vertex"), F.coalesce("root", "parent").alias("root")), "level"))
        ws.drop(level)
    return reduce(DataFrame.unionByName, levels) if levels else None


def _named(named: DataFrame, rooted: DataFrame | None, ws: Workspace) -> DataFrame:
    """Ids with the smallest id of their group."""
    if rooted is None:
        return named.select("id", F.col("id").alias("group_id"))
    members = ws.save(named.join(rooted, "vertex", "left").select("id", F.coalesce("root", "vertex").alias("root")), "members")
    least = ws.save(members.groupBy("root").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("n")), "least")
    return lookup_skewed(members, least, "root", F.col("n"), members.count()).select("id", "group_id")


def evidence_links(evidence: DataFrame, near: DataFrame) -> DataFrame:
    """Links (a, b) between evidence ids that exist, from pair states and canonical references."""
    known = evidence.where(F.col("evidence_id").isNotNull()).select(F.col("evidence_id").alias("id")).distinct()
    pairs = (latest(near, "pair_id", ["status", "evidence_a", "evidence_b"])
             .where(F.col("status").isin(*LINKING)).select(F.col("evidence_a").alias("a"), F.col("evidence_b").alias("b")))
    refs = evidence.select(F.col("evidence_id").alias("a"), F.col("canonical_evidence_id").alias("b"))
    links = (pairs.unionByName(refs)
             .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return (links.join(known.withColumnRenamed("id", "a"), "a", "left_semi")
            .join(known.withColumnRenamed("id", "b"), "b", "left_semi"))


def found(evidence: DataFrame, near: DataFrame) -> DataFrame:
    groups = connected_groups(evidence_links(evidence, near))
    return groups.select(F.col("id").alias("evidence_id"), "group_id")
