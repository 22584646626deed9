"""Problem 9: sentence units of texts in any language, by a maximum-entropy classifier of candidates.

One scan of each text finds its certain breaks (blank lines, list markers after a complete line,
spaces between two Thai words) and its candidates: end marks with the quotes and brackets that close
after them.  A mark inside a matched pair of quotes or brackets, between digits, within a list
marker or before a comma is no candidate.  A candidate is written down as a few codes: a hash of
the token and mark before it, a hash of the token after it, and a packed code of marks, letter case,
digits, length, spacing and script.  Everything later works on these codes, in arrays.

Counts over all texts say how often a token with its mark ends a paragraph or list item, where the
end of a sentence is certain, and how often a token begins one.  They are kept in hashed tables of
fixed size (two rows of ``SLOTS``), so what goes to the driver is bounded whatever the vocabulary.

The classifier is trained on reliable boundaries only: marks whose token often ends paragraphs
before a token that often begins them are positive, marks of tokens that never do, or before tokens
that never begin a sentence, are negative.  Each labelled candidate is also shown with its counts
hidden, once those of either side, so that case, digits, length and script learn to stand in for
counts where a token is rare.  Labelled rows come from at most ``TRAIN_DOCS`` documents and number
at most ``TRAIN_ROWS``; the classifier has no word list.

Defined cases: null, empty and blank texts have no units; a paragraph without letters or digits is
one unit; positions are code points; a repeated doc_id gives the units of each of its rows; other
columns are ignored; an empty table gives no rows; unmatched quotes and brackets are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.workspace import Workspace

SLOTS = 1 << 16
#: Bounds of the training rows: documents (lowest hashes of doc_id) and labelled candidates.
TRAIN_DOCS, TRAIN_ROWS = 4000, 100_000
#: Occurrences from which on a token's counts are reliable.
SURE = 12

_BLANK = re.compile(r"\n(?:[^\S\n]*\n)+")
_LINE = re.compile(r"\n[^\S\n]*")
_MARKER = re.compile(r"(?:([•‣▪●◦*·–—-])|(\(?)(\d{1,3}|[A-Za-z]\d{0,2}|[ivxIVX]{2,5})([.)]))(?=\s)\s*")
_MARK = re.compile(r"[.!?…]+|[。！？．｡]+…*|[।॥؟۔።]+|(?<=[฀-๿])\s+(?=[฀-๿])")
_BRACKET = re.compile(r"[()\[\]{}«»“”„‚‘\"「」『』（）【】《》〈〉]")
_PAIRS = {"(": ")", "[": "]", "{": "}", "«": "»", "“": "”", "„": "“", "「": "」", "『": "』", "（": "）", "【": "】", "《": "》", "〈": "〉"}
_CLOSERS = frozenset(")]}»”“\"'’」』）】》〉")
_GLUE = frozenset(",;:)]}、，；：）%/")
_TOKEN = re.compile(r"[^\s.!?…。！？．｡।॥؟۔,;:，；：、()\[\]{}«»“”„\"「」『』（）]{1,14}(?:\.[^\W\d_]{1,3}\b)*")
_WORDLESS = re.compile(r"[\W_]*\Z")
_DIGITS = re.compile(r"\d+")
_IDEOGRAPHIC = re.compile(r"[぀-ヿ㐀-鿿豈-﫿가-힣]")
_OPENERS = "¿¡«“„\"'([{「『（‘"
END = 1 << 30


def _crc(text: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(text.encode("utf-8", "surrogatepass"))


@lru_cache(maxsize=None)
def _script(char: str) -> int:
    """0 none, 1 Latin, 2 Cyrillic or Greek, 3 ideographic or kana, 4 Indic, 5 Arabic or Hebrew, 6 Thai, 7 other."""
    if not char or not char.isalpha() and unicodedata.category(char)[0] != "M":
        return 0
    c = ord(char)
    for top, number in ((0x250, 1), (0x370, 7), (0x530, 2), (0x590, 7), (0x780, 5), (0x900, 7), (0xE00, 4), (0xE80, 6), (0x1E00, 7), (0x1F00, 1), (0x2000, 2), (0x2E80, 7), (0xA4D0, 3)):
        if c < top:
            return number
    return 3 if 0xAC00 <= c < 0xD7B0 or 0xF900 <= c < 0xFB00 else 5 if 0xFB50 <= c < 0xFF00 else 7


@lru_cache(maxsize=500_000)
def _before(token: str, mark: str, closers: str) -> tuple[int, int]:
    """Hash of what stands before, and its part of the packed code."""
    low = _DIGITS.sub("#", token.lower())
    last = token[-1:]
    script = _script(last)
    kind = 0 if not token else 1 if low == "#" and len(token) < 3 else 2 if low == "#" else 3 if not any(c.isalpha() or unicodedata.category(c)[0] == "M" for c in token) else 4
    if kind == 4:
        kind += (len(token) > 1) + (len(token) > 2) + (len(token) > 3) + (len(token) > 5)
    case = 0 if not token[:1].isupper() else 1 if token[1:].islower() or len(token) == 1 else 2
    inner = "." in token or "-" in token
    vowel = script != 1 or any(c in "aeiouyäöüéèêáíóúàâîôûæø" for c in low)
    m = 0 if mark == "." else 1 if len(mark) > 1 and set(mark) <= {".", "…"} or "…" in mark else 2 if mark[0] in "!?" else 3 if mark[0] in "。．｡" else 4 if mark[0] in "！？" else 5 if mark[0] in "؟۔" else 6
    code = m | bool(closers) << 3 | script << 4 | kind << 7 | case << 11 | inner << 13 | vowel << 14
    # Neither counts for scripts without word spaces: the last two letters.
    return _crc(f"{low}\0{m}\0{closers}"), code


@lru_cache(maxsize=500_000)
def _after(token: str, first: str) -> tuple[int, int]:
    """Hash of the token that follows, and its part of the packed code."""
    lead = token[:1] or first
    kind = 1 if lead.isdigit() else 2 if lead.islower() else 3 if lead.isupper() or lead.istitle() else 4 if lead.isalpha() else 0
    opened = first in _OPENERS and bool(first)
    mixed = token[1:] != token[1:].lower() and not token.isupper()
    return _crc(_DIGITS.sub("#", token)), kind | opened << 3 | _script(token[:1]) << 4 | mixed << 7


def _next_token(text: str, at: int, end: int) -> str:
    while at < end and text[at] in _OPENERS:
        at += 1
    m = _TOKEN.match(text, at, end)
    token = m[0] if m else ""
    return token[:2] if _script(token[:1]) == 3 else token


def _closed(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Outermost matched pairs of quotes and brackets, as (position after the opener, of the closer)."""
    stack: list[tuple[str, int]] = []
    spans: list[tuple[int, int]] = []
    for m in _BRACKET.finditer(text, start, end):
        c, at = m[0], m.start()
        if c == '"':
            open_at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == '"'), None)
            if open_at is None:
                if at == start or not text[at - 1].isalnum():
                    stack.append(('"', at))
                continue
        else:
            open_at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == c), None)
            if open_at is None:
                if c in _PAIRS:
                    stack.append((_PAIRS[c], at))
                continue
        first = stack[open_at][1]
        del stack[open_at:]
        while spans and spans[-1][0] > first:
            spans.pop()
        spans.append((first + 1, at))
    return spans


class Scan:
    """Flattened breaks of many texts: the end of each piece, the start of the next, and codes."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.before: list[int] = []
        self.after: list[int] = []
        self.code: list[int] = []

    def text(self, text: str) -> None:
        at, size = 0, len(text)
        while at < size:
            m = _BLANK.search(text, at)
            end = m.start() if m else size
            self.paragraph(text, at, end)
            at = m.end() if m else size

    def paragraph(self, text: str, start: int, end: int) -> None:
        while start < end and text[start].isspace():
            start += 1
        while end > start and text[end - 1].isspace():
            end -= 1
        if start == end:
            return
        if _WORDLESS.match(text, start, end):
            self.starts.append(start)
            self._close(text, start, end, "", "", "")
            return
        at, body, style = start, start, None
        m = _MARKER.match(text, start, end)
        if m:
            body, style = m.end(), _style(m)
        for line in _LINE.finditer(text, start, end):
            m = _MARKER.match(text, line.end(), end)
            if not m:
                continue
            mine, last = _style(m), line.start()
            while last > at and text[last - 1].isspace():
                last -= 1
            if last <= body or not (_complete(text, body, last) or style is not None and mine[0] == style[0] and mine[1] == style[1] + 1):
                continue
            self.piece(text, at, body, last)
            at, body, style = line.end(), m.end(), mine
        self.piece(text, at, body, end)

    def piece(self, text: str, start: int, body: int, end: int) -> None:
        """A stretch of text between certain breaks; nothing divides before ``body``."""
        spans = _closed(text, start, end) if _BRACKET.search(text, start, end) else ()
        inside = 0
        self.starts.append(start)
        last, closers, mark, token = body, "", "", ""
        for m in _MARK.finditer(text, body, end):
            a, b = m.span()
            while inside < len(spans) and spans[inside][1] < a:
                inside += 1
            c = b
            if text[a].isspace():
                if not (inside < len(spans) and spans[inside][0] <= a):
                    self._break(text, a, b, end, END, 0, 0)
                continue
            if inside < len(spans) and spans[inside][0] <= a:
                close = spans[inside][1]
                if text[b:close].strip():
                    continue
                c = close + 1
            while c < end and text[c] in _CLOSERS:
                c += 1
            n = text[c] if c < end else ""
            if n in _GLUE and n or n == "-" and text[c - 1] in ".…" or n.isdigit() and mark_is_point(text, a, b):
                continue
            if c == b and text[b - 1] == "." and b - a == 1 and n and (n == "_" or n in "@\\&#=+~"):
                continue
            mark, closers = text[a:b], text[b:c].strip()
            token = _token_before(text, max(body, a - 16), a)
            if c >= end:
                last = c
                break
            q = c
            while q < end and text[q].isspace():
                q += 1
            if q >= end:
                break
            first = text[q]
            if first in _GLUE:
                continue
            h, code = _before(token, mark, closers)
            g, more = _after(_next_token(text, q, end), first)
            space = 0 if q == c else 2 if "\n" in text[c:q] else 1
            self.ends.append(c)
            self.starts.append(q)
            self.before.append(h)
            self.after.append(g)
            self.code.append(code | more << 15 | space << 24)
        if last < end:
            mark = ""
        self._close(text, body, end, token if mark else "", mark, closers)

    def _break(self, text: str, a: int, b: int, end: int, code: int, h: int, g: int) -> None:
        self.ends.append(a)
        self.starts.append(b)
        self.before.append(h)
        self.after.append(_after(_next_token(text, b, end), text[b])[0])
        self.code.append(code)

    def _close(self, text: str, body: int, end: int, token: str, mark: str, closers: str) -> None:
        """The certain end of a piece; ``after`` holds what its body began with."""
        self.ends.append(end)
        h, code = _before(token, mark, closers) if mark else (0, 0)
        self.before.append(h)
        self.after.append(_after(_next_token(text, body, end), text[body] if body < end else "")[0])
        self.code.append(END | code)


def mark_is_point(text: str, a: int, b: int) -> bool:
    return text[a] in ".．" and b - a == 1


def _style(m: re.Match) -> tuple[str, int]:
    """What kind of marker, and its number."""
    if m[1]:
        return m[1], -2
    number = re.search(r"\d+", m[3])
    return f"{m[2]}{'' if m[3].isdigit() else m[3][0] if number else 'x'}{m[4]}", int(number[0]) if number else ord(m[3][0])


def _complete(text: str, start: int, last: int) -> bool:
    """Whether a line that ends at ``last`` may end a sentence: an end mark, or Thai writing."""
    while last > start and text[last - 1] in _CLOSERS:
        last -= 1
    return last > start and (text[last - 1] in ".!?…。！？．｡।॥؟۔።" or _script(text[last - 1]) == 6 or _script(text[last - 1]) == 3)


def _token_before(text: str, low: int, at: int) -> str:
    """The unbroken run of text before a mark, without quotes and brackets around it."""
    while at > low and text[at - 1].isspace():
        at -= 1
    if at > low and _script(text[at - 1]) == 3:
        return text[max(low, at - 2):at]
    first = at
    while first > low and at - first < 14 and not text[first - 1].isspace():
        first -= 1
    return text[first:at].strip("()[]{}«»“”„\"'’‘「」『』（）").lstrip("-–—")


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, counts, ids = Scan(), [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            n = len(out.ends)
            if text:
                out.text(text)
            if len(out.ends) > n:
                counts.append(len(out.ends) - n)
                ids.append(doc)
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.array(counts, np.int64))]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.array(x, np.uint32 if k > 1 else np.int32).view(np.int32)))
                 for k, x in enumerate((out.starts, out.ends, out.before, out.after, out.code))]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *lists], names=["doc_id", "starts", "ends", "before", "after", "code"])


PIECES = "doc_id long, starts array<int>, ends array<int>, before array<int>, after array<int>, code array<int>"


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    lists = batch.column(name)
    offsets = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]


def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = h.view(np.uint32)
    return h & np.uint32(SLOTS - 1), (h * np.uint32(0x9E3779B1)) >> np.uint32(16)


def _general(code: np.ndarray) -> np.ndarray:
    """Mark, closers and script before: the counts used where a token is rare."""
    return (code & 0x7F).astype(np.int64)


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per table and slot: certain occurrences and all.  Tables 0, 1 are what stands before, 2, 3 what follows, 4 general."""
    sure, every = np.zeros((5, SLOTS), np.int64), np.zeros((5, SLOTS), np.int64)
    for batch in batches:
        before, after, code = (_flat(batch, n) for n in ("before", "after", "code"))
        certain = (code & END) != 0
        marked = before != 0
        for k, slot in enumerate(_slots(before)):
            sure[k] += np.bincount(slot[certain & marked], minlength=SLOTS)
            every[k] += np.bincount(slot[marked], minlength=SLOTS)
        for k, slot in enumerate(_slots(after)):
            sure[2 + k] += np.bincount(slot[certain], minlength=SLOTS)
            every[2 + k] += np.bincount(slot, minlength=SLOTS)
        g = _general(code)
        sure[4] += np.bincount(g[certain & marked], minlength=SLOTS)
        every[4] += np.bincount(g[marked], minlength=SLOTS)
    k, s = np.nonzero(every)
    yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(s.astype(np.int32)), pa.array(sure[k, s]), pa.array(every[k, s])],
                                     names=["k", "slot", "sure", "every"])


class Counts:
    """Counts of all texts, in arrays."""

    def __init__(self, rows: list) -> None:
        self.sure, self.every = np.zeros((5, SLOTS), np.int64), np.zeros((5, SLOTS), np.int64)
        for r in rows:
            self.sure[r["k"], r["slot"]], self.every[r["k"], r["slot"]] = r["sure"], r["every"]

    def of(self, h: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        one, two = _slots(h)
        first = self.every[table, one] <= self.every[table + 1, two]
        return (np.where(first, self.sure[table, one], self.sure[table + 1, two]),
                np.where(first, self.every[table, one], self.every[table + 1, two]))


def _bins(sure: np.ndarray, every: np.ndarray) -> np.ndarray:
    """0: too rare to say; 1: never certain; then by falling rarity of being certain."""
    share = (sure + 0.1) / (every + 1.0)
    return np.where(every < SURE, np.where(sure == 0, 0, 7), np.where(sure == 0, 1, 2 + np.searchsorted([0.002, 0.02, 0.1, 0.3], share)))


#: Sizes of the feature groups; each candidate has one feature of each.
_SIZES = (512, 8 * 5 * 64, 8 * 64, 64, 512, 64 * 16, 8 * 8)


def features(before: np.ndarray, after: np.ndarray, code: np.ndarray, counts: Counts, hide: int = 0) -> np.ndarray:
    """(candidates, groups) feature numbers.  ``hide`` 1: without the counts before, 2: after."""
    e, s = _bins(*counts.of(before, 0)), _bins(*counts.of(after, 2))
    if hide == 1:
        e = np.zeros_like(e)
    if hide == 2:
        s = np.zeros_like(s)
    g = _general(code)
    general = _bins(counts.sure[4, g], counts.every[4, g])
    more, space = code >> 15 & 0x1FF, code >> 24 & 3
    case, mark, closed = more & 7, code & 7, code >> 3 & 1
    kind = code >> 7 & 15
    groups = (
        g * 4 + space,
        (mark * 5 + case) * 64 + e * 8 + s,
        general * 64 + case * 8 + (more >> 3 & 1) * 4 + space,
        e * 8 + s,
        kind * 32 + (code >> 11 & 3) * 8 + case,
        (code >> 4 & 7) * 128 + (more >> 4 & 7) * 16 + (code >> 13 & 3) * 4 + (more >> 7 & 1) * 2 + closed,
        s * 8 + case,
    )
    at, out = 0, np.empty((len(code), len(groups)), np.int32)
    for i, (x, size) in enumerate(zip(groups, _SIZES)):
        out[:, i] = at + np.minimum(x, size - 1)
        at += size
    return out


def labels(before: np.ndarray, after: np.ndarray, code: np.ndarray, counts: Counts) -> np.ndarray:
    """1 reliable boundary, 0 reliably none, -1 not reliable."""
    (es, et), (ss, st) = counts.of(before, 0), counts.of(after, 2)
    case = code >> 15 & 7
    never = (es == 0) & (et >= SURE)
    within = (ss == 0) & (st >= SURE)
    often = (es >= 3) & (es >= 0.03 * et)
    begins = (ss >= 3) & (ss >= 0.03 * st)
    out = np.full(len(code), -1)
    out[never | within] = 0
    out[often & begins & (case != 1)] = 1
    return out


def fit(x: np.ndarray, y: np.ndarray, steps: int = 300, decay: float = 1e-4) -> np.ndarray:
    """Maximum-entropy weights: the regularised likelihood climbed with per-weight steps."""
    w, seen = np.zeros(sum(_SIZES) + 1), np.full(sum(_SIZES) + 1, 1e-8)
    if not len(y):
        return w
    y = y.astype(np.float64)
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(w[x].sum(axis=1) + w[-1], -30, 30)))
        d = (p - y) / len(y)
        grad = np.bincount(x.ravel(), np.repeat(d, x.shape[1]), minlength=len(w)) + decay * w / x.shape[1]
        grad[-1] = d.sum()
        seen += grad * grad
        w -= 0.3 * grad / np.sqrt(seen)
    return w


def _sampler(counts: Counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, after, code = (_flat(batch, n) for n in ("before", "after", "code"))
            free = (code & END) == 0
            before, after, code = before[free], after[free], code[free]
            y = labels(before, after, code, counts)
            sure = y >= 0
            yield pa.RecordBatch.from_arrays([pa.array(before[sure]), pa.array(after[sure]), pa.array(code[sure]), pa.array(y[sure].astype(np.int32))],
                                             names=["before", "after", "code", "y"])

    return run


def train(pieces: DataFrame, counts: Counts) -> np.ndarray:
    few = pieces.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    rows = few.mapInArrow(_sampler(counts), "before int, after int, code int, y int").limit(TRAIN_ROWS).toArrow()
    before, after, code, y = (np.ascontiguousarray(rows.column(n).to_numpy()) for n in ("before", "after", "code", "y"))
    x = np.concatenate([features(before, after, code, counts, hide) for hide in (0, 1, 2)])
    return fit(x, np.tile(y, 3))


def _decider(counts: Counts, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            starts, ends, before, after, code = (_flat(batch, n) for n in ("starts", "ends", "before", "after", "code"))
            keep = (code & END) != 0
            free = np.flatnonzero(~keep)
            x = features(before[free], after[free], code[free], counts)
            keep[free] = weights[x].sum(axis=1) + weights[-1] > 0
            doc = np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), np.diff(batch.column("ends").offsets.to_numpy()))
            begin = starts[np.concatenate([[True], keep[:-1]])]
            yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(begin.astype(np.int64)), pa.array(ends[keep].astype(np.int64))],
                                             names=["doc_id", "start_char", "end_char"])

    return run


def sentence_units(documents: DataFrame) -> DataFrame:
    """(doc_id, start_char, end_char) of the sentence units of all texts."""
    ws = Workspace(documents.sparkSession, "sentences")
    pieces = ws.save(documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(scan, PIECES), "pieces")
    slots = (pieces.select("before", "after", "code").mapInArrow(count, "k int, slot int, sure long, every long")
             .groupBy("k", "slot").agg(F.sum("sure").alias("sure"), F.sum("every").alias("every")))
    counts = Counts(slots.collect())  # at most 5 * SLOTS rows
    return pieces.mapInArrow(_decider(counts, train(pieces, counts)), "doc_id long, start_char long, end_char long")
