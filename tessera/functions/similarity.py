"""Similarity of strings by their longest common subsequence, in Arrow batches.

``indel`` is twice the length of the longest common subsequence over the sum of both lengths, in percent: a
dynamic programme on bits, one machine word after the other, in time of len(a) * len(b) / 64.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence; a bit of ``row`` is clear where a step was gained."""
    if len(a) > len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    if not a and not b:
        return 100.0
    return 200.0 * common_subsequence(a, b) / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def indel(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def sorted_tokens(text: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(text, "\\s+"), lambda x: x != "")), " ")


def token_sort(a: Column, b: Column) -> Column:
    """``indel`` of the texts with their words in order."""
    return indel(sorted_tokens(a), sorted_tokens(b))
