"""Substring deduplication by level-wise doubling of repeated word windows.

Levels are windows of 12, 25 and 50 words (halves of the length asked for). Within each full window one window of the first length stands
for it, the one with the smallest hash, so equal stretches pick equal windows and few are kept. Those that only one document has are
dropped; the repeated ones are extended to windows of twice the length around them, again one for each full window, and so on. A level
without survivors ends the job. On the last level the full windows themselves are compared: each goes, with its hash, to a task that
owns windows around its survivor, which finds the smallest document of each. Two windows are equal if their own hash and that of the survivor
inside are, 128 bits together.

A window that many documents of a batch share is settled within the batch: only its smallest document there is sent on. The
windows around one survivor have one owner; those around a survivor that many documents have are dealt to several.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, release, stored, text_bytes
from .shingles import Words, mixed, windows

WINDOW = 50
#: Words of a window of the first level, at least.
SHORTEST = 12
#: Owners among which the full windows around a survivor that more than COMMON documents have are dealt, by their hash.
OWNERS = 4
COMMON = 256
#: Windows that a task compares at a time; the windows of one owner's key are compared together.
MOST_AT_ONCE = 200_000
#: Repeats that a task gathers by document before it sends them on.
MOST_FOUND = 2_000_000


def levels(window: int) -> list[int]:
    """The lengths, each about twice the one before."""
    out = [window]
    while out[0] // 2 >= SHORTEST:
        out.insert(0, out[0] // 2)
    return out


def sliding_min(h: np.ndarray, span: int) -> np.ndarray:
    """The least of each `span` neighbours, by windows of twice the width in each step."""
    out, width = h, 1
    while width < span:
        step = min(width, span - width)
        out = np.minimum(out[:-step], out[step:])
        width += step
    return out


class Picks:
    """A text's windows of each level that stand for its full windows."""

    def __init__(self, words: np.ndarray, window: int):
        self.words, self.window = words, window
        self.starts = np.arange(max(0, len(words) - window + 1))  # of the full windows that are still candidates
        self.at, self.length, self.hashes = self.starts, 0, np.zeros(0, np.uint64)

    def extend(self, length: int) -> np.ndarray:
        """Goes on to a greater length: for each candidate the window of that length with the smallest hash (the first of equals) that holds its last pick; returns their hashes."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        h = windows(self.words, length)
        if not self.length:
            inside = self.window - length + 1
            at = self.starts + sliding_window_view(h, inside).argmin(1)
        else:
            low = np.maximum(self.starts, self.at + self.length - length)
            high = np.minimum(self.starts + self.window - length, self.at)
            each = np.minimum(low[:, None] + np.arange(min(length - self.length, self.window - length) + 1), high[:, None])
            at = each[np.arange(len(each)), h[each].argmin(1)]
        self.at, self.length, self.hashes = at, length, h[at]
        return self.hashes

    def keep(self, alive: np.ndarray) -> None:
        """Leaves the candidates whose last pick is repeated."""
        here = np.isin(self.hashes, alive)
        self.starts, self.at, self.hashes = self.starts[here], self.at[here], self.hashes[here]


def _rows(docs: DataFrame) -> DataFrame:
    """Rows are told apart by doc_id and tid, a hash of the text; those equal in both are alike."""
    return docs.select("doc_id", F.xxhash64("text").alias("tid"), text_bytes())


def described(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, tid, n_words, kept_sha256 of all words, and the hashes of its picks of the first level."""
    first = levels(window)[0]

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for part, texts in chunks(batches):
            n, sha, found = [], [], []
            for t in texts:
                words = t.split()
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                found.append(np.unique(sliding_min(windows(known.of(words), first), window - first + 1)).view(np.int64) if len(words) >= window else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(sha), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "tid", "n_words", "kept_sha256", "picks"])

    return _rows(docs).mapInArrow(describe, "doc_id long, tid long, n_words long, kept_sha256 string, picks array<long>")


def _picked(text: bytes, alive: list[np.ndarray], window: int, known: Words) -> Picks:
    """The candidates that are left after the levels whose survivors are given."""
    picks = Picks(known.of(text.split()), window)
    for length, own in zip(levels(window), alive):
        picks.extend(length)
        picks.keep(own)
    return picks


def _survivors(part: pa.RecordBatch, i: int) -> list[np.ndarray]:
    return [x.values.to_numpy().view(np.uint64) for x in part.column(3)[i].values]


def _next_level(flagged: DataFrame, window: int, level: int) -> DataFrame:
    """doc_id, tid, picks of the level (from 0), around the survivors of those before."""
    length = levels(window)[level]

    def extend(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for part, texts in chunks(batches):
            found = [np.unique(_picked(t, _survivors(part, i), window, known).extend(length)).view(np.int64) for i, t in enumerate(texts)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "tid", "picks"])

    return flagged.select("doc_id", "tid", "bytes", "alive").mapInArrow(extend, "doc_id long, tid long, picks array<long>")


def _extended(flagged: DataFrame, window: int) -> DataFrame:
    """(key, tid, doc_id, at, hashes): full windows around the last survivors, at their owner `key`; without hashes, `at` are windows known to be repeats."""

    def extend(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for part, texts in chunks(batches, limit=16 << 20):
            key, full, row, at = [], [], [], []
            for i, t in enumerate(texts):
                picks = _picked(t, _survivors(part, i), window, known)
                own = windows(picks.words, window)[picks.starts]
                owners = np.where(np.isin(picks.hashes, part.column(4)[i].values.to_numpy().view(np.uint64)), np.uint64(OWNERS), np.uint64(1))
                key.append(mixed(picks.hashes + own % owners) if len(picks.hashes) else own)
                full.append(own)
                row.append(np.full(len(own), i))
                at.append(picks.starts)
            key, full, row, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (key, full, row, at))
            doc, tid = (part.column(k).to_numpy() for k in (0, 1))
            order = np.lexsort((at, doc[row], key, full)) if len(row) else np.zeros(0, np.int64)
            key, full, row, at = key[order], full[order], row[order], at[order]
            least = _least(doc[row], full, key)
            repeat = doc[row] > least
            yield _lists(doc[row[repeat]], tid[row[repeat]], doc[row[repeat]], at[repeat], None)
            yield _lists(key[~repeat].view(np.int64), tid[row[~repeat]], doc[row[~repeat]], at[~repeat], full[~repeat])

    return flagged.select("doc_id", "tid", "bytes", "alive", "common").mapInArrow(extend, "key long, tid long, doc_id long, at binary, hashes binary")


def _least(doc: np.ndarray, full: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For windows sorted by hash, key and document, the smallest document of each one's equals."""
    if not len(doc):
        return doc
    head = np.flatnonzero(np.concatenate([[True], (full[1:] != full[:-1]) | (key[1:] != key[:-1])]))
    return np.repeat(doc[head], np.diff([*head, len(doc)]))


def _lists(key: np.ndarray, tid: np.ndarray, doc: np.ndarray, at: np.ndarray, full: np.ndarray | None) -> pa.RecordBatch:
    """A row for each (key, document, text), with its windows."""
    order = np.lexsort((at, tid, doc, key))
    key, tid, doc, at = key[order], tid[order], doc[order], at[order].astype(np.int32)
    change = np.flatnonzero((np.diff(key) != 0) | (np.diff(doc) != 0) | (np.diff(tid) != 0)) + 1
    head = np.concatenate([[0], change]) if len(key) else np.zeros(0, np.int64)
    ends = [*head[1:], len(key)]
    places = pa.array([at[a:b].tobytes() for a, b in zip(head, ends)], pa.binary())
    hashes = pa.array([full[order[a:b]].tobytes() for a, b in zip(head, ends)], pa.binary()) if full is not None else pa.nulls(len(head), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(key[head], pa.int64()), pa.array(tid[head], pa.int64()), pa.array(doc[head], pa.int64()), places, hashes], names=["key", "tid", "doc_id", "at", "hashes"])


def _repeats(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tid, at) of the windows that a smaller document has too; rows come sorted by key, and those of a key are compared together."""
    waiting: list[pa.RecordBatch] = []
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        done = batch.filter(batch.column(4).is_null())
        if done.num_rows:
            yield pa.RecordBatch.from_arrays([done.column(2), done.column(1), done.column(3)], names=["doc_id", "tid", "at"])
        batch = batch.filter(batch.column(4).is_valid())
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
        if cut or (waiting and waiting[-1].column(0)[-1].as_py() != keys[-1]):
            waiting.append(batch.slice(0, cut))
            size += batch.column(3).nbytes
            if size > 4 * MOST_AT_ONCE:
                found.append(_compare(waiting))
                waiting, size = [], 0
                if sum(len(at) for *_, at in found) > MOST_FOUND:
                    yield _by_document(found)
                    found = []
            batch = batch.slice(cut)
        waiting.append(batch)
    if waiting:
        yield _by_document([*found, _compare(waiting)])


def _by_document(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    doc, tid, at = (np.concatenate(x) for x in zip(*found))
    out = _lists(doc, tid, doc, at, None)
    return pa.RecordBatch.from_arrays([out.column(2), out.column(1), out.column(3)], names=["doc_id", "tid", "at"])


def _compare(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_id, tid and place of each window of the parts that a smaller document has too."""
    parts = [p for p in parts if p.num_rows]
    key, tid, doc = (np.concatenate([p.column(k).to_numpy() for p in parts]) for k in (0, 1, 2))
    places = [np.frombuffer(x, np.int32) for p in parts for x in p.column(3).to_pylist()]
    full = np.concatenate([np.frombuffer(x, np.uint64) for p in parts for x in p.column(4).to_pylist()])
    row, at = np.repeat(np.arange(len(tid)), [len(x) for x in places]), np.concatenate(places)
    order = np.lexsort((doc[row], key[row], full))
    row, at = row[order], at[order]
    repeat = doc[row] > _least(doc[row], full[order], key[row])
    return doc[row[repeat]], tid[row[repeat]], at[repeat]


def _covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + window, -1)
    return np.cumsum(step)[:n] > 0


def repeated(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """What is known of every row (see described), and doc_id, tid, bytes, at of the rows that lose words."""
    scan, row = stored(described(docs, window), "described"), ["doc_id", "tid"]
    picks, flagged = scan.where("doc_id is not null").select(*row, "picks"), None
    for level in range(len(levels(window)) - 1):
        each = picks.select(*row, F.explode("picks").alias("pick"))
        twice = each.groupBy("pick").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n"))
        twice = twice.where("least < most").select("pick", F.when(F.col("n") > COMMON, F.col("pick")).alias("often"))
        hit = each.join(twice, "pick").groupBy(*row).agg(F.collect_set("pick").alias("now"), F.collect_set("often").alias("common"))  # a text's own at most
        if flagged is None:
            flagged = _rows(docs).join(hit, row).dropDuplicates(row).select(*row, "bytes", F.array("now").alias("alive"), "common")
        else:
            flagged = flagged.drop("common").join(hit, row).select(*row, "bytes", F.concat("alive", F.array("now")).alias("alive"), "common")
        flagged = stored(flagged, f"survivors{level}")
        release(docs.sparkSession)
        if flagged.isEmpty():
            break
        if level + 2 < len(levels(window)):
            picks = stored(_next_level(flagged, window, level + 1), f"picks{level + 1}")
    if flagged is None:  # a window too short to halve: all full windows are compared
        flagged = _rows(docs).where("doc_id is not null").dropDuplicates(row).select(*row, "bytes", F.array().cast("array<array<long>>").alias("alive"), F.array().cast("array<long>").alias("common"))
    at = _extended(flagged, window).repartition("key").sortWithinPartitions("key").mapInArrow(_repeats, "doc_id long, tid long, at binary")
    return scan, flagged.select(*row, "bytes").join(at.groupBy(*row).agg(F.collect_list("at").alias("at")), row)


def cleaned(losing: DataFrame, window: int, with_text: bool = False) -> DataFrame:
    """doc_id, tid, n_removed, kept_sha256, and the kept text if asked for, of rows that lose words."""

    def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            n, sha, kept = [], [], []
            for t, at in zip(texts, part.column(3).to_pylist()):
                words = t.split()
                gone = _covered(len(words), np.concatenate([np.frombuffer(x, np.int32) for x in at]), window)
                text = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                n.append(int(gone.sum()))
                sha.append(hashlib.sha256(text).hexdigest())
                kept.append(text.decode("utf-8") if with_text else None)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(sha), pa.array(kept, pa.string())], names=["doc_id", "tid", "n_removed", "kept_sha256", "text"])

    return losing.select("doc_id", "tid", "bytes", "at").mapInArrow(clean, "doc_id long, tid long, n_removed long, kept_sha256 string, text string")


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every document.

    A word goes if a window of `window` consecutive words that covers it also starts in a document with a smaller
    doc_id. Windows are judged on the input; texts of any length are taken whole. Null and empty texts have no words and the digest of the
    empty string. Rows with the same doc_id don't count as earlier for each other; rows with a null doc_id neither lose words
    nor make others lose any. An empty table gives no rows; other columns are ignored.
    """
    scan, losing = repeated(docs, window)
    changed = cleaned(losing, window).select("doc_id", "tid", "n_removed", F.col("kept_sha256").alias("sha"))
    return scan.select("doc_id", "tid", "n_words", "kept_sha256").join(changed, ["doc_id", "tid"], "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("sha", "kept_sha256").alias("kept_sha256"))
