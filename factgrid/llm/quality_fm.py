"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score is w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j; the pairwise part is computed in linear
time as half of sum_f (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2. It is fitted on the driver over the
features of a bounded sample of labelled rows, and applied to every whole text in Arrow batches.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks

WORD_BITS = 15
FACTORS = 8
#: Labelled rows that the model is fitted on, at most; all distinct hashed words of them count.
MOST_ROWS = 6_000
#: Features that a step of the fit looks at together; a batch of rows with more is summed up in parts.
MOST_TOGETHER = 200_000
#: Words whose feature a Python worker keeps; beyond that it forgets them all.
MOST_KNOWN = 300_000
STEPS = 12
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_SPACE = b"\t\n\v\f\r "
_MARKS = b"!#$%&*|@^~+=<>/\\_{}[]"
STATISTICS = ("log_words", "word_length", "letters", "upper", "digits", "marks", "ends", "distinct", "short", "log_lines", "line_words", "same_lines", "common_mark", "log_n_chars")
BINS = 8


def statistics(text: bytes, words: list[bytes], distinct: int, n_chars: int | None) -> tuple[float, ...]:
    """Structure statistics, and the table's own n_chars (the text's bytes where it is null)."""
    size = max(1, len(text))
    count = lambda drop: (len(text) - len(text.translate(None, drop))) / size
    n = max(1, len(words))
    lines = text.split(b"\n")
    marks = text.translate(None, _LETTERS + _DIGITS + _SPACE + b".,")
    ends = len(re.findall(rb"[^\w\s.,\x80-\xff](?=\s|$)", text)) / n
    most = max((marks.count(bytes([c])) for c in set(marks)), default=0)
    return (
        np.log1p(len(words)), (size - len(words)) / n, count(_LETTERS), count(_UPPER), count(_DIGITS), count(_MARKS), ends, distinct / n,
        sum(map((4).__gt__, map(len, words))) / n, np.log1p(len(lines)), n / len(lines), 1 - len(set(lines)) / len(lines), most / size, np.log1p(len(text) if n_chars is None else max(0, n_chars)),
    )


class Words(dict):
    """The feature of a word: a hash of its bytes in lower case."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_KNOWN:
            self.clear()
        self[word] = f = zlib.crc32(word) & ((1 << WORD_BITS) - 1)
        return f


def features(texts: list[bytes], n_chars: list[int | None], known: Words) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct word features of each text, and the statistics as rows."""
    hashed, rows = [], []
    for t, n in zip(texts, n_chars):
        words = t.lower().split()
        own = np.unique(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        hashed.append(own)
        rows.append(statistics(t, words, len(own), n))
    return hashed, np.array(rows).reshape(-1, len(STATISTICS))


class Machine:
    """Weights over 2^WORD_BITS words and BINS bins of each statistic."""

    def __init__(self, edges: np.ndarray, seed: int = 0):
        self.edges = edges  # statistic x inner bounds of its bins
        size = (1 << WORD_BITS) + len(edges) * BINS
        self.w0, self.w, self.v = 0.0, np.zeros(size), np.random.default_rng(seed).normal(0, 0.01, (size, FACTORS))

    def design(self, hashed: list[np.ndarray], stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features, their values and the row each starts at: words share a norm of 1, a statistic's bin is 1."""
        binned = [(1 << WORD_BITS) + k * BINS + np.searchsorted(e, stats[:, k]) for k, e in enumerate(self.edges)]
        binned = np.stack(binned, 1)
        index = np.concatenate([x for i, h in enumerate(hashed) for x in (binned[i], h)])
        value = np.concatenate([x for h in hashed for x in (np.ones(len(self.edges)), np.full(len(h), 1 / np.sqrt(max(1, len(h)))))])
        sizes = np.array([len(h) + len(self.edges) for h in hashed])
        return index, value, np.cumsum(sizes) - sizes

    def margin(self, index, value, first) -> tuple[np.ndarray, np.ndarray]:
        vx = self.v[index] * value[:, None]
        s = np.add.reduceat(vx, first)
        pairs = 0.5 * (s**2 - np.add.reduceat(vx**2, first)).sum(1)
        return self.w0 + np.add.reduceat(self.w[index] * value, first) + pairs, s

    def score(self, hashed: list[np.ndarray], stats: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(*self.design(hashed, stats))[0], -30, 30)))


def fit(hashed: list[np.ndarray], stats: np.ndarray, y: np.ndarray, steps: int = STEPS, rate: float = 0.1, decay: float = 1e-4, seed: int = 0) -> Machine:
    """AdaGrad on the log loss, classes weighted equally, in a fixed order; no rows give a machine that scores 0.5."""
    edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T if len(stats) else np.zeros((len(STATISTICS), BINS - 1))
    m = Machine(edges, seed)
    if len(set(y.tolist())) < 2:
        m.w0 = 0.0 if not len(y) else (3.0 if y[0] else -3.0)
        return m
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    gw, gv, g0 = np.full(m.w.shape, 1e-3), np.full(m.v.shape, 1e-3), 1e-3
    rng, n = np.random.default_rng(seed), len(m.w)
    for _ in range(steps):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 256):
            rows = order[at : at + 256]
            dw, dv, many, e_sum = np.zeros(n), np.zeros((n, FACTORS)), np.zeros(n, np.int64), 0.0
            sizes = np.cumsum([len(hashed[i]) + len(edges) for i in rows])
            for part in np.split(rows, np.flatnonzero(np.diff(sizes // MOST_TOGETHER)) + 1):
                index, value, first = m.design([hashed[i] for i in part], stats[part])
                z, s = m.margin(index, value, first)
                e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) * weight[part] / len(rows)
                row = np.repeat(np.arange(len(part)), np.diff([*first, len(index)]))
                ex = e[row] * value
                many += np.bincount(index, minlength=n)
                dw += np.bincount(index, ex, n)
                for f in range(FACTORS):
                    dv[:, f] += np.bincount(index, ex * (s[row, f] - m.v[index, f] * value), n)
                e_sum += e.sum()
            seen = np.flatnonzero(many)
            dw, dv = dw[seen] + decay * m.w[seen], dv[seen] + decay * m.v[seen]
            gw[seen] += dw**2
            gv[seen] += dv**2
            g0 += e_sum**2
            m.w[seen] -= rate * dw / np.sqrt(gw[seen])
            m.v[seen] -= rate * dv / np.sqrt(gv[seen])
            m.w0 -= rate * e_sum / np.sqrt(g0)
    assert n == len(m.w)
    return m


def fold(doc_id: Column, parts: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def _inputs(docs: DataFrame) -> DataFrame:
    n_chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("bytes"), n_chars.alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = MOST_ROWS, held_out: int = 1, parts: int = 3) -> Machine:
    """Fitted on at most most_rows labelled documents, picked by a hash of their id; ids whose crc32 mod parts is held_out are never read."""
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), parts) != held_out))
    own = own.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    sample = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = _inputs(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "bytes", "n_chars", "y")  # at most most_rows rows
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("words", pa.list_(pa.int16())), ("stats", pa.list_(pa.float64()))])

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for part, texts in chunks(batches):
            hashed, stats = features(texts, part.column(2).to_pylist(), known)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), pa.array([h.astype(np.int16) for h in hashed], pa.list_(pa.int16())), pa.array(list(stats), pa.list_(pa.float64()))], schema=schema)

    got: pd.DataFrame = rows.mapInArrow(describe, "doc_id long, y int, words array<smallint>, stats array<double>").orderBy("doc_id").toPandas()
    stats = np.array(got["stats"].tolist()).reshape(-1, len(STATISTICS))
    return fit([np.asarray(x, np.int16) for x in got["words"]], stats, got["y"].to_numpy(float))


def quality(docs: DataFrame, labels: DataFrame, machine: Machine | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; score is the probability of label 1.

    Inputs are the text and n_chars alone. Null and empty texts are scored by their statistics. Labels
    that are null or name no document are ignored; of a doc_id labelled twice the larger label counts.
    Without labels every score is 0.5. Repeated rows get a row each; an empty table gives none.
    """
    model = docs.sparkSession.sparkContext.broadcast(machine or train(docs, labels))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for part, texts in chunks(batches):
            s = model.value.score(*features(texts, part.column(2).to_pylist(), known))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = _inputs(docs).mapInArrow(score, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents predicted to be of label 1, with all their columns, in one pass over the texts."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    bytes_at, n_at = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def good(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            texts = [(x or "").encode() for x in batch.column(bytes_at).to_pylist()]
            n = batch.column(n_at).to_pylist() if n_at is not None else [None] * len(texts)
            s = [model.value.score(*features(texts[i : i + 200], n[i : i + 200], known)) for i in range(0, len(texts), 200)]
            yield batch.filter(pa.array(np.concatenate(s) >= 0.5)) if s else batch

    return docs.mapInArrow(good, docs.schema)
