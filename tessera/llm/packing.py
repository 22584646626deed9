"""Problem 8: texts into containers of fixed capacity, in a controlled mixture of their sources.

Deficit round-robin: every window gives each source's queue a quantum of tokens, its target share of
the window; a queue hands out texts while its deficit lasts and carries the rest of it on to the next
window.  As a queue's deficit is only ever spent on its own texts, the text whose tokens end at place
``c`` of its queue is handed out in the first window whose summed quanta reach ``c``; so the windows of
all texts follow from running sums, and the deficits carried over windows and over partitions are the
sums of the blocks before.  Queues are cut into blocks of about ``BLOCK_ROWS`` texts, so a source that
holds a third of all texts never gathers in one task.

Within a window the texts are packed best fit decreasing.  Containers that a window leaves less full
than ``FULL`` are taken up again: their texts are carried on and packed together with those of
``CARRY`` windows.  A text is split only above the capacity: into full pieces and a rest.

Without given targets, each source's target is its share of all tokens, so that every window has the
mixture of the whole and all queues run dry in the last one.  A source without a target (where targets
are given) has the smallest of them.

Defined cases: null texts and texts without tokens take no container and give no row; a null source is
a source of its own; start_token is the piece's first token in its text; a doc_id that occurs twice is
two texts; limits without a positive capacity are left out; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.tokens import counts
from tessera.plans.workspace import Workspace

#: Texts in a block of a queue, containers in a window, share of a container from which on it is closed, windows whose rest is packed together.
BLOCK_ROWS, CONTAINERS, FULL, CARRY = 100_000, 512, 0.98, 64
#: A table of limits is a setting, not data.
MOST_LIMITS = 1000
_OUT = "limit_id int, capacity long, mix_window long, container long, doc_id long, source string, start_token long, tokens long"


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each piece: longest first, into the fullest container that has room."""
    out = np.zeros(len(sizes), np.int64)
    rooms: list[tuple[int, int]] = []
    used = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, container = rooms.pop(at)
        else:
            room, container, used = capacity, used, used + 1
        out[i] = container
        if room > size:
            insort(rooms, (room - size, container))
    return out


def _pack_window(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["tokens", "doc_id", "start_token"], kind="stable", ascending=[False, True, True])
    return frame.assign(container=best_fit(frame["tokens"].to_numpy(), int(frame["capacity"].iloc[0])))[
        ["limit_id", "capacity", "mix_window", "container", "doc_id", "source", "start_token", "tokens"]]


def pieces(lengths: DataFrame, limits: list[tuple[int, int]]) -> DataFrame:
    """Every text for every limit, cut where it exceeds the capacity."""
    each = F.explode(F.array(*[F.struct(F.lit(i).cast("int").alias("limit_id"), F.lit(c).cast("long").alias("capacity")) for i, c in limits]))
    zero = F.lit(0).cast("long")
    return (lengths.where(F.col("tokens") > 0).select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.col("tokens").alias("all"), each.alias("l"))
            .select("doc_id", "source", "all", "l.*")
            .withColumn("start_token", F.explode(F.sequence(zero, F.col("all") - 1, F.col("capacity"))))
            .select("limit_id", "capacity", "doc_id", "source", "start_token", F.least("capacity", F.col("all") - F.col("start_token")).alias("tokens"),
                    F.xxhash64("doc_id", "start_token").alias("turn")))


def mix_windows(items: DataFrame, blocks: int, targets: dict[str, float] | None = None) -> DataFrame:
    """Adds ``mix_window``, the window in which deficit round-robin hands a piece out."""
    queue = items.withColumn("block", F.pmod("turn", F.lit(blocks)))
    sums = queue.groupBy("limit_id", "capacity", "source", "block").agg(F.sum("tokens").alias("held"))
    before = sums.withColumn("before", F.sum("held").over(Window.partitionBy("limit_id", "source").orderBy("block")) - F.col("held"))
    total = sums.groupBy("limit_id", "capacity", "source").agg(F.sum("held").alias("queue"))
    every = total.groupBy("limit_id").agg(F.sum("queue").alias("every"))
    quanta = total.join(every, "limit_id")
    windows = F.greatest(F.lit(1.0), F.ceil(F.col("every") / (F.col("capacity") * CONTAINERS)))
    if targets:
        share = F.coalesce(F.create_map(*[F.lit(x) for pair in targets.items() for x in pair])[F.col("source")], F.lit(min(targets.values())))
        quantum = share / F.sum(share).over(Window.partitionBy("limit_id")) * F.col("capacity") * CONTAINERS
    else:
        quantum = F.col("queue") / windows
    quanta = quanta.select("limit_id", "source", quantum.alias("quantum"))
    plan = before.join(quanta, ["limit_id", "source"]).select("limit_id", "source", "block", "before", "quantum")
    running = Window.partitionBy("limit_id", "source", "block").orderBy("turn", "doc_id", "start_token").rowsBetween(Window.unboundedPreceding, 0)
    served = queue.withColumn("within", F.sum("tokens").over(running)).join(plan, ["limit_id", "source", "block"])
    place = F.ceil((F.col("before") + F.col("within")) / F.col("quantum") - 1e-9) - 1
    return served.select("limit_id", "capacity", "doc_id", "source", "start_token", "tokens", F.greatest(F.lit(0), place).cast("long").alias("mix_window"))


def pack(lengths: DataFrame, limits: list[tuple[int, int]], ws: Workspace, targets: dict[str, float] | None = None) -> DataFrame:
    """The pieces of all texts with their windows and containers."""
    rows = lengths.count()
    mixed = mix_windows(pieces(lengths, limits), max(1, -(-rows // BLOCK_ROWS)), targets)
    first = ws.save(mixed.groupBy("limit_id", "mix_window").applyInPandas(_pack_window, _OUT), "windows")
    filled = Window.partitionBy("limit_id", "mix_window", "container")
    level = first.withColumn("fill", F.sum("tokens").over(filled))
    closed = level.where(F.col("fill") >= FULL * F.col("capacity")).drop("fill").withColumn("carried", F.lit(0).cast("long"))
    rest = level.where(F.col("fill") < FULL * F.col("capacity")).drop("fill")
    again = (rest.withColumn("group", F.floor(F.col("mix_window") / CARRY)).groupBy("limit_id", "group").applyInPandas(_pack_window, _OUT)
             .withColumn("carried", F.lit(1).cast("long")))
    # The window is that of the round-robin; a carried container is numbered in the group's last window.
    at = F.when(F.col("carried") == 1, F.floor(F.col("mix_window") / CARRY) * CARRY + CARRY - 1).otherwise(F.col("mix_window"))
    return closed.unionByName(again).select(
        "limit_id", ((at * 2 + F.col("carried")) * (1 << 22) + F.col("container")).cast("long").alias("container_id"),
        "mix_window", "doc_id", "source", "start_token", "tokens")


def packed(documents: DataFrame, limits: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    ws = Workspace(documents.sparkSession, "packing")
    given = limits.where("capacity_tokens > 0").select("limit_id", "capacity_tokens").distinct().limit(MOST_LIMITS + 1).collect()
    if len(given) > MOST_LIMITS:
        raise ValueError(f"more than {MOST_LIMITS} limits")
    if not given:
        return documents.sparkSession.createDataFrame([], "limit_id int, container_id long, mix_window long, doc_id long, source string, start_token long, tokens long")
    return pack(ws.save(counts(documents), "lengths"), sorted((r[0], r[1]) for r in given), ws, targets)


def fill(packs: DataFrame, limits: DataFrame) -> DataFrame:
    """Per limit: containers, tokens, the fewest containers that could hold them, and the share filled."""
    one = packs.groupBy("limit_id", "container_id").agg(F.sum("tokens").alias("t")).groupBy("limit_id").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    return one.join(F.broadcast(limits.select("limit_id", "capacity_tokens").distinct().limit(MOST_LIMITS)), "limit_id").select(
        "limit_id", "containers", "tokens", "fullest", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least"),
        (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("filled"))
