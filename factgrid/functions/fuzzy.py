"""Best fuzzy place of a quote in a text, in Arrow batches: a small kernel that Spark runs over rows.

The score of a stretch is 200 * common / (both lengths), common being the longest common subsequence with the shorter string. Before a
subsequence is looked for, counts tell how much a stretch can score at most: how many characters it has in common with the shorter string in any
order and, where a least score is asked for, how many of its q-grams occur in the shorter string, since each character that is put in or left out
spoils at most q of them. Stretches are tried from the highest bound down, until no bound is left above the best score.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

#: Characters of the q-grams that are counted.
Q = 3


def places(short: str) -> dict[str, int]:
    """For each character, the bits of where it is."""
    where: dict[str, int] = {}
    for i, c in enumerate(short):
        where[c] = where.get(c, 0) | 1 << i
    return where


def common(where: dict[str, int], size: int, other: str) -> int:
    """Length of the longest common subsequence with the string of that size and these places, bit-parallel."""
    full = (1 << size) - 1
    row = full
    for c in other:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    out = codes[: len(codes) - q + 1].astype(np.uint64)
    for i in range(1, q):
        out = out << np.uint64(21) | codes[i : len(codes) - q + 1 + i]
    return out


def _within(marks: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many marks lie in each start..end."""
    total = np.concatenate([[0], np.cumsum(marks)])
    start = np.minimum(start, len(marks))
    return total[np.maximum(end, start)] - total[start]


def align(quote: str, text: str, least: float = 0.0) -> tuple[float, int, int]:
    """(score 0-100, start, end): the stretch of the longer string most like the shorter one, the first of equals; the span is in text.

    Where no stretch scores `least` or more, (0.0, 0, 0) or the best there is.
    """
    short, long = (quote, text) if len(quote) <= len(text) else (text, quote)
    if not short:
        return (100.0 if not long else 0.0), 0, 0
    at = long.find(short)
    if at >= 0:
        best = (100.0, at, at + len(short))
    else:
        best = _best(short, long, least)
    return best if len(quote) <= len(text) else (best[0], 0, len(text) if best[0] else 0)


def _best(short: str, long: str, least: float) -> tuple[float, int, int]:
    n, a, b = len(short), _codes(short), _codes(long)
    first = np.arange(-n + 1, len(long))
    start, end = np.maximum(first, 0), np.minimum(first + n, len(long))
    size = n + end - start
    # only stretches that end (at the left border: begin) in a character of the shorter string can be best
    ok = np.isin(b, a)[np.where(end < len(long), end - 1, start)]
    if least:
        needed = np.ceil(least * size / 200 - 1e-9)
        spoilt = Q * (size - 2 * needed)  # by what is put in and left out, at most
        ok &= needed <= end - start
        if n >= Q and len(long) >= Q:
            known = np.isin(_grams(b, Q), _grams(a, Q))
            ok &= _within(known, start, end - Q + 1) >= end - start - Q + 1 - spoilt
    which = np.flatnonzero(ok)
    if not len(which):
        return 0.0, 0, 0
    start, end, size = start[which], end[which], size[which]
    lo = int(start.min())
    shared, piece = np.zeros(len(which), np.int64), b[lo : int(end.max())]
    for c, k in Counter(a.tolist()).items():
        shared += np.minimum(k, _within(piece == c, start - lo, end - lo))
    bound = 200.0 * shared / size
    where, best, rank = places(short), (0.0, 0, 0), len(which)
    for i in np.argsort(-bound, kind="stable").tolist():
        if bound[i] < best[0] or bound[i] == 0 or bound[i] < least:
            break
        if bound[i] == best[0] and i > rank:
            continue
        score = 200.0 * common(where, n, long[start[i] : end[i]]) / int(size[i])
        if score > best[0] or (score == best[0] and i < rank and score > 0):
            best, rank = (score, int(start[i]), int(end[i])), i
    return best


def _kernel(least: float):
    @F.pandas_udf(StructType([StructField("score", DoubleType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))
    def kernel(quote: pd.Series, text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([align(q or "", t or "", least) for q, t in zip(quote, text)], columns=["score", "start", "end"])

    return kernel


#: align() of two columns.
alignment = _kernel(0.0)


def alignment_from(least: float):
    """align() of two columns where only scores from `least` on count: much faster where most pairs are unlike."""
    return _kernel(least)
