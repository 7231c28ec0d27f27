"""Operator 13: maximal periodic runs of words, by Lyndon arrays.

The words of a text are ranked by sorting them, which needs comparisons only.
For each of two opposite orders of the ranks one scan from left to right finds
the next smaller suffix of every word (its Lyndon factor) and how far the two
suffixes agree, after Ellert and Fischer, "Linear Time Runs over General Ordered
Alphabets" (2021): extensions that are known already are never matched again,
be it along a chain of smaller suffixes or within the stretch that was matched
last, so that each word is matched once at the right end of what was inspected.
A run with a period of ``p`` words has a Lyndon factor of ``p`` words in one of
the orders; such factors are extended to both sides. No suffix array, no suffix
tree and no fingerprints are used.

Only runs that hold their period three times count. Each of their words occurs
three times in them, so words that occur less often in their stretch cut it up
first; what is left over is short in plain prose.

Rows are independent: each is worked on whole by one task, repeated rows give
repeated results, an empty table none. Null and empty texts have no words. Texts
of any length are taken whole. Columns beyond doc_id and text aren't read and
may have any name.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has so many words, and so many periods, at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Stretches are cut up at rare words so many times; then they are searched as they are.
CUTS = 4

Found = tuple[int, int, int]


def ranks(words: list[bytes]) -> np.ndarray:
    """The place of each word among the distinct words in order."""
    order = sorted(range(len(words)), key=words.__getitem__)
    out = np.zeros(len(words), np.int64)
    if order:
        out[order] = np.cumsum([0, *(words[a] != words[b] for a, b in pairwise(order))])
    return out


def lyndon(s: list[int]) -> tuple[list[int], list[int]]:
    """Of each suffix the next smaller one (``len(s)``: none), and how many words the two share.

    The stretch from ``near`` to ``far`` was last found to repeat what lies ``gap``
    words before. What was compared there tells what a comparison within it gives,
    up to ``far``; beyond, words are matched one by one, and ``far`` moves on.
    """
    n = len(s)
    after, shared = [n] * n, [0] * n  # next smaller suffix, to the right
    before, behind = [-1] * n, [0] * n  # previous smaller suffix, to the left
    near = far = gap = 0
    for r in range(1, n):
        at, known = r - 1, 0
        while True:
            k, sure = known, False
            if r < far and at >= near:  # both lie where the last match told all
                a, b = at - gap, r - gap
                old = shared[a] if after[a] == b else behind[b] if before[b] == a else -1
                if old >= 0:
                    if r + old < far:
                        k, sure = old, True
                    elif k < far - r:
                        k = far - r
            if not sure:
                while r + k < n and s[at + k] == s[r + k]:
                    k += 1
                if r + k >= far:
                    near, far, gap = r, r + k, r - at
            if r + k < n and s[at + k] < s[r + k]:
                before[r], behind[r] = at, k
                break
            after[at], shared[at] = r, k
            # on to the previous smaller suffix; unless as much is shared, the shorter match decides
            while True:
                up, own = before[at], behind[at]
                if up < 0 or own == k:
                    break
                at = up
                if own < k:  # there the suffix at ``at`` is the smaller one
                    before[r], behind[r] = at, own
                    break
                after[at], shared[at] = r, k
            if up < 0 or own < k:
                break
            at, known = up, k
    return after, shared


def _found(s: list[int], least: int, periods: int) -> Iterator[Found]:
    """(start, length, period) of the runs whose Lyndon factors this order gives; some twice."""
    after, shared = (np.array(x, np.int64) for x in lyndon(s))
    period = after - np.arange(len(s))
    at = np.flatnonzero(shared >= (periods - 2) * period)
    end = after[at] + shared[at]
    order = np.lexsort((at, period[at], end))
    at, end = at[order], end[order]
    first = np.ones(len(at), bool)
    first[1:] = (end[1:] != end[:-1]) | (period[at][1:] != period[at][:-1])
    for i, stop in zip(at[first].tolist(), end[first].tolist()):
        p, start = int(period[i]), i
        while start and s[start - 1] == s[start - 1 + p]:
            start -= 1
        if stop - start >= max(least, periods * p):
            yield start, stop - start, p


def _stretches(codes: np.ndarray, least: int, periods: int) -> Iterator[tuple[int, int]]:
    """Where runs may lie: stretches of words that each occur ``periods`` times within it."""
    todo = [(0, len(codes), 0)]
    while todo:
        a, b, depth = todo.pop()
        if b - a < least:
            continue
        if depth == CUTS:
            yield a, b
            continue
        _, at, n = np.unique(codes[a:b], return_inverse=True, return_counts=True)
        rare = np.flatnonzero(n[at] < periods)
        if not len(rare):
            yield a, b
            continue
        cuts = np.concatenate([[a - 1], a + rare, [b]])
        long = np.flatnonzero(np.diff(cuts) > least)
        todo += [(int(cuts[i]) + 1, int(cuts[i + 1]), depth + 1) for i in long]


def runs_of(words: list[bytes], least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[Found]:
    """(start, length, period) of every maximal run, in order of start and period; ``periods`` is 3 or more."""
    codes = ranks(words)
    out = []
    for a, b in _stretches(codes, least, periods):
        piece = codes[a:b].tolist()
        out += [(a + i, n, p) for order in (piece, [-c for c in piece]) for i, n, p in _found(order, least, periods)]
    out.sort()
    return [x for i, x in enumerate(out) if not i or x != out[i - 1]]


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of one document in ten (by checksum of the id), with a repeated passage written over their end."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def collapse(words: list[bytes], found: list[Found]) -> list[bytes]:
    """Words without those that a run holds after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    return words if keep.all() else [words[i] for i in np.flatnonzero(keep)]


def _best(found: list[Found]) -> Found | None:
    """The run of the greatest exponent; ties go to the smallest start, then period."""
    best = None
    for x in found:
        if best is None or x[1] * best[2] > best[1] * x[2]:
            best = x
    return best


SCHEMA = "doc_id long, n_words long, n_runs long, runs array<struct<start: long, length: long, period: long>>, start long, length long, period long, exponent_milli long, runs_sha256 string, text string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def detect(docs: DataFrame, modified: bool = False) -> DataFrame:
    """doc_id, its runs, the greatest of them, and the text without repetitions (words joined by one space).

    ``modified`` first writes a repeated passage over one document in ten.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            columns: list[list] = [[] for _ in range(9)]
            for doc_id, text in zip(ids, batch["text"]):
                words = (text.as_py() or "").encode().split()
                if modified:
                    words = planted(words, doc_id)
                found = runs_of(words)
                start, length, period = _best(found) or (None, None, None)
                listed = "".join(f"{i},{n},{p}\n" for i, n, p in found)
                values = len(words), len(found), found, start, length, period, length and 1000 * length // period, hashlib.sha256(listed.encode()).hexdigest(), b" ".join(collapse(words, found)).decode()
                for column, value in zip(columns, values):
                    column.append(value)
            runs = pa.array([[dict(zip(("start", "length", "period"), x)) for x in found] for found in columns[2]], _RUNS)
            arrays = [batch["doc_id"], *(pa.array(c, pa.int64()) for c in columns[:2]), runs, *(pa.array(c, pa.int64()) for c in columns[3:7]), *(pa.array(c, pa.string()) for c in columns[7:])]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_runs", "runs", "start", "length", "period", "exponent_milli", "runs_sha256", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, SCHEMA)
