"""Problem 7: the token ids of a public byte-level tokenizer (``byte_bpe_50k``), encoded here.

A text is cut into pieces by the tokenizer's own pattern.  A piece that is itself a token is that
token; any other piece starts as a doubly linked list of its bytes.  A priority queue holds the
merges of neighbouring symbols by rank, leftmost first among equals; the least is taken, its two
symbols become one, and the merges with its new neighbours are queued.  An entry whose symbols have
changed since it was queued is stale and is skipped, so nothing is ever searched for or removed.
A piece of n bytes takes O(n log n), however long it is.

Ids of pieces are kept per worker in a table that is emptied when it holds ``KEPT`` pieces; a piece of
more than ``KEPT_CHARS`` characters is never kept.  Decoding concatenates vocabulary strings.

Every string in a text is ordinary text, special tokens' names included.  Defined cases: a null or
empty text has an empty list; a lone surrogate, which UTF-8 cannot hold, is the replacement mark; a
null or repeated doc_id is a row like any other; other columns are ignored; an empty table gives no
rows.  The vocabulary file is a parameter and is read on each worker.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import cache, partial
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

RANKS = "byte_bpe_50k.tiktoken"
KEPT, KEPT_CHARS = 400_000, 200


class Encoder:
    """A byte-pair vocabulary as ranks, with its pattern of pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.strings = ranks, {i: s for s, i in ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self.kept: _Pieces = _Pieces(self)

    def merge(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        ranks = self.ranks
        whole = ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        symbol: list[bytes | None] = [data[i:i + 1] for i in range(n)]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(rank, i, symbol[i], symbol[i + 1]) for i in range(n - 1) if (rank := ranks.get(data[i:i + 2])) is not None]
        heapify(queue)
        while queue:
            _, i, left, right = heappop(queue)
            j = after[i]
            if symbol[i] is not left or j == n or symbol[j] is not right:
                continue  # stale
            symbol[i], symbol[j] = left + right, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (rank := ranks.get(symbol[i] + symbol[k])) is not None:
                    heappush(queue, (rank, i, symbol[i], symbol[k]))
            h = before[i]
            if h >= 0 and (rank := ranks.get(symbol[h] + symbol[i])) is not None:
                heappush(queue, (rank, h, symbol[h], symbol[i]))
        out, i = [], 0
        while i < n:
            out.append(ranks[symbol[i]])
            i = after[i]
        return out

    def encode(self, text: str) -> list[int]:
        pieces = self.pieces(text)
        if len(self.kept) > KEPT:
            self.kept.clear()
        return list(chain.from_iterable(map(self.kept.__getitem__, pieces)))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


class _Pieces(dict):
    """Ids of pieces met before."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> list[int]:
        ids = self.encoder.merge(piece.encode("utf-8", "surrogatepass") if piece.isprintable() else clean(piece).encode("utf-8"))
        if len(piece) <= KEPT_CHARS:
            self[piece] = ids
        return ids


def clean(text: str) -> str:
    """Lone surrogates as the replacement mark."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


@cache
def encoder(name: str = RANKS) -> Encoder:
    """The tokenizer, once per worker."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return Encoder(ranks, public_tokenizers.PATTERN)


def _ids(name: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encode = encoder(name).encode
    for batch in batches:
        lists = [encode(t) if t else [] for t in batch.column("text").to_pylist()]
        ends = np.zeros(len(lists) + 1, np.int64)
        np.cumsum([len(x) for x in lists], out=ends[1:])
        flat = np.fromiter(chain.from_iterable(lists), np.int32, ends[-1])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))],
                                         names=["doc_id", "ids"])


def _counts(name: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encode = encoder(name).encode
    for batch in batches:
        counts = [len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(counts, pa.int64())],
                                         names=["doc_id", "source", "tokens"])


def _texts(name: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    decode = encoder(name).decode
    for batch in batches:
        texts = [None if x is None else decode(x) for x in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])


def _run(df: DataFrame, task: Callable, name: str, schema: str) -> DataFrame:
    return df.mapInArrow(partial(task, name), schema)


def ids(documents: DataFrame, name: str = RANKS) -> DataFrame:
    return _run(documents.select("doc_id", "text"), _ids, name, "doc_id long, ids array<int>")


def texts(encoded: DataFrame, name: str = RANKS) -> DataFrame:
    """(doc_id, ids) back to (doc_id, text)."""
    return _run(encoded.select("doc_id", "ids"), _texts, name, "doc_id long, text string")


def counts(documents: DataFrame, name: str = RANKS) -> DataFrame:
    """Tokens of each text, with its source."""
    return _run(documents.select("doc_id", "source", "text"), _counts, name, "doc_id long, source string, tokens long")
