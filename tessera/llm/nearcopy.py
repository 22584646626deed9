"""Problem 6: near-duplicate statements, by min-wise signatures whose keys grow with the table.

A text is the set of its words as they look, the n-th occurrence of a word being an element of its
own, so that twice the common elements over the sum of both sizes is the wanted similarity.  For
each of two independent tables min-wise symbols are drawn from the set: in one all words weigh the
same, so that what is found depends on the similarity alone, in the other common words weigh less, by
counts over all different sets.  A key is made of some symbols that no other key has, and texts that
share a key meet in its bucket.  The longer the keys, the more of them a pair at the threshold needs,
and the fewer texts meet that have nothing but everyday words in common.  How many would meet is
estimated from some texts of the table, and the length of least work is taken: with one length for
all tables the comparisons would grow as the square of the texts.  Pairs that
meet are thinned without loss: each element flips one of 64 bits, so the bits in which two sets
differ are never more than the elements in which they differ.  The rest is compared exactly.

Equal sets are one node.  Buckets that hold very many different texts (found on one text in 64)
are cut into blocks, and every block meets every other and itself: the pairs found do not depend
on the size of a bucket, and a hot bucket that is missed costs time, never pairs.

The join is not exact: a pair over the threshold is missed where it shares no key in either table.
At similarity 0.85 the equal weights alone miss about one pair in a hundred, whatever the length of
the keys, above it fewer; the README has recall as measured.  Elements are 32-bit codes:
two sets are taken to share a word that they don't with a probability of at most the product of their
sizes over 2**32.

Defined cases: null texts and texts without words have no pairs; deliveries of a record count once;
copies in the sense of problem 2 and texts that look the same (problem 5) are no pairs of each
other; an empty table gives no rows; other columns are ignored; texts of any length are compared
as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.copies import canonical_key
from tessera.llm.lookalike import Reader, reader
from tessera.operators.records import lookup_skewed, statements
from tessera.plans.workspace import Workspace

SIMILARITY = 0.85
#: The probability with which a pair exactly at the threshold is missed by the equal weights alone.
MISSED = 0.01
#: Symbols of a key; the longer, the more keys are needed.
LENGTHS = range(4, 13)
#: Work on an index row (drawn, shuffled, sorted) in comparisons.
ROW_COST = 80
#: Texts whose similarity says how long keys must be, and the agreement from which on a pair counts as wanted.
PROBED, WANTED = 1024, 0.5
#: Elements from which on a text is signed on its own; texts signed at once.
LONG, ABREAST = 1024, 1024
#: A word in more than this share of the texts is common; there are at most (mean words) / share of them.
COMMON = 0.02
#: Different texts in a bucket from which on it is split further.
HOT_BUCKET = 8192
SAMPLE = 64

_WORD = re.compile(r"[^\W_]+")
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; the same on every machine."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def words(text: str) -> list[str]:
    """Runs of letters and digits of a text given as it looks, letter case ignored."""
    return _WORD.findall(text.lower())


class _Elements(dict):
    """Word to its 64-bit code, kept per task; restarted when it holds a million words."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 1_000_000:
            self.clear()
        code = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return code


def element_sets(texts: list[str], codes: _Elements) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 32-bit elements of all texts (as they look), and where each text's begin (one more than texts)."""
    lists = [words(t) for t in texts]
    ends = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=ends[1:])
    flat = np.fromiter((codes[w] for x in lists for w in x), np.uint64, ends[-1])
    row = np.repeat(np.arange(len(lists)), np.diff(ends))
    order = np.lexsort((flat, row))
    flat, row = flat[order], row[order]
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])
    at = np.arange(len(flat))
    occurrence = at - np.maximum.accumulate(np.where(new, at, 0))
    element = (mix(flat + occurrence.astype(np.uint64) * _GOLD) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    order = np.lexsort((element, row))
    return element[order], ends


def bags(element: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit id per set: sum of mixed elements."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(element.view(np.uint32).astype(np.uint64) + _GOLD), dtype=np.uint64)])
    return mix(total[ends[1:]] - total[ends[:-1]] + np.diff(ends).astype(np.uint64) * _GOLD).view(np.int64)


SETS = "evidence_id string, copy binary, looks long, bag long, size int, elements array<int>"


def _setter(by: Reader):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Element sets of statements.  A set already sent by this task is not sent again."""
        import xxhash

        codes, sent = _Elements(), set()
        for batch in batches:
            ids, copy = batch.column("evidence_id"), batch.column("copy")
            texts = [by.look(t) for t in batch.column("text").to_pylist()]
            element, ends = element_sets(texts, codes)
            bag = bags(element, ends)
            looks = [xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t in texts]
            keep = np.zeros(len(texts), bool)
            if len(sent) > 1_000_000:
                sent.clear()
            for i, b in enumerate(bag.tolist()):
                if b not in sent:
                    sent.add(b)
                    keep[i] = True
            size = np.diff(ends)
            kept = np.repeat(keep, size)
            offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.where(keep, size, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(~keep, False)), pa.array(element[kept]))
            yield pa.RecordBatch.from_arrays(
                [ids, copy, pa.array(np.array(looks, np.uint64).view(np.int64)), pa.array(bag), pa.array(size.astype(np.int32)), lists],
                names=["evidence_id", "copy", "looks", "bag", "size", "elements"])

    return run


def keys_for(length: int) -> int:
    """So many independent keys of this length that a pair at the threshold shares none with a probability of ``MISSED`` at most."""
    return int(np.ceil(np.log(MISSED) / np.log1p(-((SIMILARITY / (2.0 - SIMILARITY)) ** length))))


class Signer:
    """Signatures and index keys of element sets: ``keys_for(length)`` keys, each of ``length`` symbols of its own."""

    def __init__(self, common: dict[int, float], rare: float, length: int = LENGTHS[0], table: int = 0):
        self.names = np.array(sorted(common), np.int32)
        self.weights = np.array([common[k] for k in self.names.tolist()], np.float64)
        self.common, self.rare, self.length, self.table, self.count = common, rare, length, table, keys_for(length)
        # Tables draw from streams of their own, whatever their length.
        self.seeds = mix((np.uint64(table) << np.uint64(32)) + np.arange(1, 1 + self.count * length, dtype=np.uint64) * _GOLD)
        self.factors = mix(np.arange(1, 1 + length, dtype=np.uint64) * _M2) | np.uint64(1)

    def equal(self) -> Signer:
        """Equal weights, with other draws."""
        return Signer({}, 1.0, self.length, 1)

    def of_length(self, length: int) -> Signer:
        return Signer(self.common, self.rare, length, self.table)

    def weight(self, element: np.ndarray) -> np.ndarray:
        if not len(self.names):
            return np.full(len(element), self.rare)
        at = np.minimum(np.searchsorted(self.names, element), len(self.names) - 1)
        return np.where(self.names[at] == element, self.weights[at], self.rare)

    def sign(self, element: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(texts, symbols): for each symbol the least exponential draw, which stands for its element."""
        known, place = np.unique(element, return_inverse=True)
        draw = mix(known.view(np.uint32).astype(np.uint64)[:, None] * _GOLD ^ self.seeds[None, :])
        uniform = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        # Positive floats order as their bits do.
        race = (-np.log(uniform) / self.weight(known)[:, None]).astype(np.float32).view(np.uint32)
        size, out = np.diff(ends), np.empty((len(ends) - 1, len(self.seeds)), np.uint32)
        order = np.argsort(-size, kind="stable")
        long = int(np.count_nonzero(size > LONG))
        for i in order[:long]:
            parts = [race[place[a:min(a + LONG, ends[i + 1])]].min(axis=0) for a in range(ends[i], ends[i + 1], LONG)]
            out[i] = np.min(parts, axis=0)
        # Texts of like size side by side: the n-th elements of all of them at once.
        drawn = np.empty((ABREAST, len(self.seeds)), np.uint32)
        for a in range(long, len(order), ABREAST):
            rows = order[a:a + ABREAST]
            start, sizes = ends[rows], size[rows]
            least = race[place[start]]
            for n in range(1, int(sizes[0])):
                m = int(np.searchsorted(-sizes, -n))
                np.take(race, place[start[:m] + n], axis=0, out=drawn[:m], mode="clip")
                np.minimum(least[:m], drawn[:m], out=least[:m])
            out[rows] = least
        return out

    def keys(self, signature: np.ndarray) -> np.ndarray:
        """(texts, keys): each key from symbols that no other key has."""
        parts = signature.reshape(-1, self.count, self.length)
        total = np.zeros(parts.shape[:2], np.uint64)
        for n, factor in enumerate(self.factors):
            total += (parts[:, :, n].astype(np.uint64) + np.uint64(1)) * factor
        return mix(total ^ mix(np.arange(1, 1 + self.count, dtype=np.uint64) * _M1)[None, :]).view(np.int64)


def agreeing(signature: np.ndarray) -> list[float]:
    """For each of ``LENGTHS``, the share of pairs of texts that agree in so many independent symbols, without bias:
    of a pair that agrees in ``m`` of ``n`` symbols, C(m, k) / C(n, k)."""
    texts, symbols = signature.shape
    same = np.zeros((texts, texts), np.uint16)
    for column in signature.T:
        same += column[:, None] == column[None, :]
    met = np.bincount(same[np.triu_indices(texts, 1)], minlength=symbols + 1)
    # Pairs that are wanted anyway are no reason for longer keys.
    met[int(WANTED * symbols):] = 0
    pairs = max(texts * (texts - 1) / 2, 1.0)
    return [float(sum(c * comb(m, k) for m, c in enumerate(met.tolist())) / comb(symbols, k) / pairs) for k in LENGTHS]


def cheapest_length(shares: list[float], texts: int) -> int:
    """The key length of least work: a comparison for every two texts that agree in a key, ``ROW_COST`` for a row."""
    return min(zip(LENGTHS, shares), key=lambda x: keys_for(x[0]) * (ROW_COST + x[1] * texts / 2))[0]


def parities(element: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits per set, one flipped by each element."""
    bit = np.uint64(1) << (mix(element.view(np.uint32).astype(np.uint64) + _M2) >> np.uint64(58))
    return np.bitwise_xor.reduceat(bit, ends[:-1]).view(np.int64)


def blocks(key: np.ndarray, bag: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and keys of hot buckets cut into ``many`` blocks: a key for every two blocks, so that a
    row's block meets each block of its bucket, its own included."""
    own, rows, keys = (mix(bag.view(np.uint64)) % many.astype(np.uint64)).astype(np.int64), [], []
    for other in range(int(many.max(initial=0))):
        row = np.flatnonzero(many > other)
        low, high = np.minimum(own[row], other).astype(np.uint64), np.maximum(own[row], other).astype(np.uint64)
        rows.append(row)
        keys.append(mix(key[row].view(np.uint64) ^ mix(low * _GOLD + high * _M1 + np.uint64(1))).view(np.int64))
    return (np.concatenate(rows), np.concatenate(keys)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


#: Index rows worked on at once.
AT_ONCE = 400_000
#: Rows from which on a bucket is worked on by itself, in squares of so many rows by ``ACROSS``.
WIDE, ACROSS = 64, 4096
INDEX = "key long, bag long, parity long, size int"


def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The elements of all sets, and where each set's begin (one more than sets)."""
    lists = batch.column("elements")
    ends = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]].astype(np.int32, copy=False), ends - ends[0]


def _indexer(signer: Signer, hot: dict[int, int]):
    heads = np.array(sorted(hot), np.int64)
    parts = np.array([hot[k] for k in heads.tolist()], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            element, ends = flat(batch)
            keys, bag = signer.keys(signer.sign(element, ends)), batch.column("bag").to_numpy()
            parity, size = parities(element, ends), np.diff(ends).astype(np.int32)
            row, key = np.repeat(np.arange(len(keys)), keys.shape[1]), keys.reshape(-1)
            if len(heads):
                is_hot = np.isin(key, heads)
                hot_row, hot_key = row[is_hot], key[is_hot]
                at, more_key = blocks(hot_key, bag[hot_row], parts[np.searchsorted(heads, hot_key)])
                row, key = np.concatenate([row[~is_hot], hot_row[at]]), np.concatenate([key[~is_hot], more_key])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(bag[row]), pa.array(parity[row]), pa.array(size[row])],
                                             names=["key", "bag", "parity", "size"])

    return run


def element_table(evidence: DataFrame) -> DataFrame:
    rows = statements(evidence, ["evidence_id", "text", canonical_key(F.col("text"), F.col("block_type")).alias("copy")])
    return rows.mapInArrow(_setter(reader(evidence.sparkSession)), SETS)


def different_sets(sets: DataFrame) -> DataFrame:
    """Each set once, however many texts or tasks hold it."""
    return sets.where(F.col("elements").isNotNull() & (F.col("size") > 0)).select("bag", "elements").dropDuplicates(["bag"])


def corpus_signer(alone: DataFrame) -> Signer:
    """Weights from the counts of all elements; only common ones, a bounded number, are gathered."""
    texts = alone.count()
    counts = alone.select(F.explode("elements").alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("n"))
    common = counts.where(F.col("n") > COMMON * max(texts, 1)).collect()
    return Signer({r["e"]: float(np.log(max(texts / r["n"], 1.0)) + 0.02) for r in common}, float(np.log(1 / COMMON) + 0.02))


def _prober(signers: list[Signer]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                element, ends = flat(batch)
                signed = [one.sign(element, ends) for one in signers]
                yield pa.RecordBatch.from_arrays([pa.array([row.tobytes() for row in x], pa.binary()) for x in signed], names=[f"s{n}" for n in range(len(signed))])

    return run


def suited(alone: DataFrame, signers: list[Signer]) -> list[Signer]:
    """The signers with keys as long as the number of texts and their usual similarity ask for."""
    texts = alone.count()
    some = alone.where(F.pmod("bag", F.lit(max(texts // PROBED, 1))) == 0)
    schema = ", ".join(f"s{n} binary" for n in range(len(signers)))
    rows = some.mapInArrow(_prober([one.of_length(LENGTHS[0]) for one in signers]), schema).limit(4 * PROBED).collect()
    if len(rows) < 2:
        return signers
    drawn = [np.array([np.frombuffer(r[n], np.uint32) for r in rows]) for n in range(len(signers))]
    return [one.of_length(cheapest_length(agreeing(x), texts)) for one, x in zip(signers, drawn)]


def met_in_table(alone: DataFrame, signer: Signer) -> DataFrame:
    """Pairs (a, b), a < b, that share a bucket of one table and may reach the threshold."""
    some = alone.where(F.pmod("bag", F.lit(SAMPLE)) == 0).mapInArrow(_indexer(signer, {}), INDEX)
    often = some.groupBy("key").count().where(F.col("count") >= max(HOT_BUCKET // SAMPLE, 2)).orderBy(F.desc("count"), "key").limit(100_000)
    hot = {r["key"]: max(2, -(-r["count"] * SAMPLE // HOT_BUCKET)) for r in often.collect()}
    index = alone.mapInArrow(_indexer(signer, hot), INDEX)
    return index.repartition("key").sortWithinPartitions("key").mapInArrow(_meeting, "a long, b long")


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs within the buckets of index rows sorted by key; a bucket may go over several batches."""
    held: list[list[np.ndarray]] = []
    rows, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        one = [batch.column(n).to_numpy() for n in ("key", "bag", "parity", "size")]
        # Buckets are gathered until there are enough rows, and only whole ones are worked on.
        if rows >= AT_ONCE and one[0][-1] != last:
            cut = int(np.searchsorted(one[0], last, side="right")) if one[0][0] <= last else 0
            held.append([x[:cut] for x in one])
            yield from _within(*[np.concatenate(x) for x in zip(*held)])
            held, rows, one = [], 0, [x[cut:] for x in one]
        held.append(one)
        rows, last = rows + len(one[0]), one[0][-1]
    if held:
        yield from _within(*[np.concatenate(x) for x in zip(*held)])


def _within(key: np.ndarray, bag: np.ndarray, parity: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Every row against the rows after it in its bucket.  No true pair fails: the differing bits and
    the difference of sizes are at most the differing elements."""
    if not len(key):
        return
    parity, left, right, held = parity.view(np.uint64), [], [], 0
    for row, other in _side_by_side(key, parity, size):
        na, nb = size[row], size[other]
        most = (1.0 - SIMILARITY) * (na + nb) + 1e-6
        close = (np.bitwise_count(parity[row] ^ parity[other]) <= most) & (np.abs(na - nb) <= most)
        a, b = bag[row[close]], bag[other[close]]
        left.append(np.minimum(a, b))
        right.append(np.maximum(a, b))
        held += len(a)
        if held > 1_000_000:
            yield _pairs(left, right)
            left, right, held = [], [], 0
    if held:
        yield _pairs(left, right)


def _side_by_side(key: np.ndarray, parity: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one bucket to compare.  Small buckets all at once: first neighbours, then rows two apart, and
    so on.  Wide ones in squares, of which only rows are given out whose bits may be near enough."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    many = np.diff(np.append(starts, len(key)))
    ends = np.repeat(starts + many, many)
    row, apart = np.flatnonzero(np.repeat(many <= WIDE, many)), 1
    while True:
        row = row[ends[row] - row > apart]
        if not len(row):
            break
        yield row, row + apart
        apart += 1
    # The larger set of a pair has at most (2 - s) / s times the elements of the smaller, so they differ in 2 (1 - s) / s times those of either at most.
    bits = np.minimum(2.0 * (1.0 - SIMILARITY) / SIMILARITY * size + 1e-6, 64.0).astype(np.uint8)
    for start, end in zip(starts[many > WIDE].tolist(), (starts + many)[many > WIDE].tolist()):
        for a in range(start, end, WIDE):
            b = min(a + WIDE, end)
            for c in range(a, end, ACROSS):
                d = min(c + ACROSS, end)
                near = np.bitwise_count(parity[a:b, None] ^ parity[None, c:d]) <= bits[a:b, None]
                row, other = np.divmod(np.flatnonzero(near), d - c)
                row, other = row + a, other + c
                after = other > row
                yield row[after], other[after]


def _pairs(left: list[np.ndarray], right: list[np.ndarray]) -> pa.RecordBatch:
    """Different pairs, once each."""
    a, b = np.concatenate(left), np.concatenate(right)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) & (a != b)
    return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], names=["a", "b"])


def near_bags(alone: DataFrame, signer: Signer, ws: Workspace) -> DataFrame:
    """Pairs (a, b) of bag ids, a < b, whose sets reach the threshold."""
    # One table after the other, so that only one index is on disk at a time.
    met = [ws.save(met_in_table(alone, one).distinct(), "met") for one in suited(alone, [signer.equal(), signer])]
    pairs = ws.save(reduce(DataFrame.unionByName, met).distinct(), "pairs")
    for one in met:
        ws.drop(one)
    half = pairs.join(alone.withColumnRenamed("bag", "a"), "a").withColumnRenamed("elements", "ea")
    both = half.join(alone.withColumnRenamed("bag", "b"), "b")
    common = F.size(F.array_intersect("ea", "elements"))
    near = ws.save(both.where(2.0 * common >= SIMILARITY * (F.size("ea") + F.size("elements")) - 1e-9).select("a", "b"), "near")
    ws.drop(pairs)
    return near


def _members(sets: DataFrame) -> DataFrame:
    return sets.where((F.col("size") > 0) & F.col("copy").isNotNull()).select("evidence_id", "bag", "copy", "looks").distinct()


def near_sets(evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evidence_id, bag, copy, looks) of all statements with words, and the pairs (a, b) of their bags that are near."""
    ws = Workspace(evidence.sparkSession, "nearcopy")
    sets = ws.save(element_table(evidence), "sets")
    alone = ws.save(different_sets(sets), "alone")
    return _members(sets), near_bags(alone, corpus_signer(alone), ws)


def classes(evidence: DataFrame) -> DataFrame:
    """One row per statement: its class (all statements of the same words, named by the smallest id), how many
    statements the class has, and how many other classes are near it."""
    members, near = near_sets(evidence)
    each = members.select("evidence_id", "bag").distinct()
    named = each.groupBy("bag").agg(F.min("evidence_id").alias("class_id"), F.count(F.lit(1)).alias("members"))
    linked = near.select(F.explode(F.array("a", "b")).alias("bag")).groupBy("bag").agg(F.count(F.lit(1)).alias("links"))
    table = named.join(linked, "bag", "left").select("bag", "class_id", "members", F.coalesce("links", F.lit(0).cast("long")).alias("links"))
    return lookup_skewed(each, table, "bag", F.col("members"), each.count()).select("evidence_id", "class_id", "members", "links")


def found(evidence: DataFrame) -> DataFrame:
    """Pairs of statements; every pair of members of near classes, as the contract asks."""
    members, near = near_sets(evidence)
    units = members.select("bag", "copy").distinct()
    mixed = units.groupBy("bag").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > 1).select(F.col("bag").alias("a"), F.col("bag").alias("b"))
    sides = near.unionByName(mixed)
    one = units.select(F.col("bag").alias("a"), F.col("copy").alias("copy_a"))
    two = units.select(F.col("bag").alias("b"), F.col("copy").alias("copy_b"))
    pairs = sides.join(one, "a").join(two, "b").where(
        (F.col("copy_a") != F.col("copy_b")) & ((F.col("a") != F.col("b")) | (F.col("copy_a") < F.col("copy_b"))))
    left = members.select(F.col("bag").alias("a"), F.col("copy").alias("copy_a"), F.col("evidence_id").alias("x"), F.col("looks").alias("lx"))
    right = members.select(F.col("bag").alias("b"), F.col("copy").alias("copy_b"), F.col("evidence_id").alias("y"), F.col("looks").alias("ly"))
    full = pairs.join(left, ["a", "copy_a"]).join(right, ["b", "copy_b"]).where(F.col("lx") != F.col("ly"))
    return full.select(F.least("x", "y").alias("evidence_a"), F.greatest("x", "y").alias("evidence_b"))
