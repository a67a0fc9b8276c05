"""Vector codes: product quantisation of integer vectors by active-entry Lloyd rounds.

Vectors become whole numbers and are cut into parts; each part position has a codebook. Between rounds a table keeps every
part's entry and its exact distance. After an update of the codebooks, a part whose entry stayed where it was need only look at
the entries that moved: all others are as far as before, so the stored distance stands for them. Parts whose entry moved
look at all. Distances are whole numbers below 2 ** 53, so ties are exact; the lower index wins them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Whole numbers beyond it are taken as it, so that squares and sums stay exact.
LARGEST = 1 << 20
#: Components that a task turns into distances at a time.
AT_ONCE = 1 << 19
#: Over how many keys the rows of a label are spread when they meet its sum.
SALTS = 32


def whole_numbers(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """vec_id, label, x: the floors of scale times each component, of vectors that have only finite ones and can be cut into parts."""
    v = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    limits = lambda x: F.least(F.greatest(x, F.lit(float(-LARGEST))), F.lit(float(LARGEST)))
    x = F.transform("v", lambda c: F.floor(limits(c * scale)).cast("int"))
    return v.where(F.col("v").isNotNull() & ~bad & (F.size("v") % parts == 0)).select("vec_id", "label", x.alias("x"))


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries, exact: in floats where they stay below 2 ** 53, which they do up to 2,048 components."""
    kind = np.float64 if x.shape[1] < 2048 else np.int64
    x, e = x.astype(kind), entries.astype(kind)
    return ((x * x).sum(1)[:, None] - 2 * (x @ e.T) + (e * e).sum(1)).astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, the lower index on ties, and its distance."""
    d = distances(x, book)
    near = d.argmin(1)
    return near, d[np.arange(len(d)), near]


def renewed(x: np.ndarray, book: np.ndarray, moved: np.ndarray, near: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """nearest() once the entries marked in moved have changed, from what it was before."""
    near, dist = near.copy(), dist.copy()
    which = np.flatnonzero(moved)
    if not len(which):
        return near, dist
    stays = ~moved[near]
    if stays.any():
        best, d = nearest(x[stays], book[which])
        best = which[best]
        old, far = near[stays], dist[stays]
        closer = (d < far) | ((d == far) & (best < old))
        near[stays], dist[stays] = np.where(closer, best, old), np.where(closer, d, far)
    if not stays.all():
        near[~stays], dist[~stays] = nearest(x[~stays], book)
    return near, dist


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), width)


def assigned(rows: DataFrame, books: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """vec_id, label, x, near, dist: every part's entry and distance. books: part, entry, component. moved: entries that changed since near and dist of the rows; None for a first time."""
    parts, _, width = books.shape
    label = rows.schema["label"].dataType.simpleString()
    size = max(1, AT_ONCE // max(1, parts * width))

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, size):
                batch = whole.slice(at, size)
                x = _matrix(batch.column(2), parts * width).reshape(batch.num_rows, parts, width)
                if moved is None:
                    found = [nearest(x[:, p], books[p]) for p in range(parts)]
                else:
                    near, dist = _matrix(batch.column(3), parts), _matrix(batch.column(4), parts)
                    found = [renewed(x[:, p], books[p], moved[p], near[:, p], dist[:, p]) for p in range(parts)]
                new = [np.stack([f[k] for f in found], 1).ravel() for k in (0, 1)]
                ends = np.arange(0, parts * (batch.num_rows + 1), parts, dtype=np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(t))) for v, t in zip(new, (np.int32, np.int64))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *lists], names=["vec_id", "label", "x", "near", "dist"])

    return rows.mapInArrow(assign, f"vec_id long, label {label}, x array<int>, near array<int>, dist array<long>")


def updated(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks with each entry replaced by the floors of its parts' means. Tasks add up first; one row for each component of the codebooks comes to the driver."""
    parts, entries, width = books.shape

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), parts * width).reshape(-1, width)
            cell = (_matrix(batch.column(1), parts) + np.arange(parts) * entries).ravel()
            n += np.bincount(cell, minlength=len(n))
            order = np.argsort(cell, kind="stable")
            used, first = np.unique(cell[order], return_index=True)
            total[used] += np.add.reduceat(x[order], first, axis=0) if len(used) else 0
        used = np.flatnonzero(n)
        place = np.arange(width)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, width)), pa.array(np.tile(place, len(used))), pa.array(total[used].ravel()), pa.array(np.repeat(n[used], width))], names=["cell", "place", "total", "n"])

    if not width:
        return books
    sums = state.select("x", "near").mapInArrow(add, "cell long, place long, total long, n long").groupBy("cell", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = books.reshape(parts * entries, width).copy()
    for r in sums.collect():
        out[r["cell"], r["place"]] = r["total"] // r["n"]
    return out.reshape(books.shape)


def first_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """Those parts of the vectors with the smallest vec_ids; of equal ids by their numbers, null ids last; fewer entries where there are fewer vectors."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    x = np.array([r["x"] for r in first], np.int64)
    return x.reshape(len(first), parts, x.shape[1] // parts).transpose(1, 0, 2)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(rows: DataFrame, dims: int, parts: int, entries: int, rounds: int) -> DataFrame:
    """vec_id, label, code, error, codebooks_sha256 of vectors that all have dims components."""
    books, moved, state = first_books(rows, parts, entries), None, rows
    for k in range(rounds + 1):
        state = stored(assigned(state, books, moved), f"assigned{dims}-{k}")
        if k < rounds:
            new = updated(state, books)
            books, moved = new, (new != books).any(2)
    digits = F.array_join(F.transform("near", lambda i: F.lpad(F.lower(F.hex(i)), 2, "0")), "")
    error = F.aggregate("dist", F.lit(0).cast("long"), lambda a, d: a + d)
    return state.select("vec_id", "label", digits.alias("code"), error.alias("error"), F.lit(digest(books)).alias("codebooks_sha256"))


def with_label_error(codes: DataFrame) -> DataFrame:
    """label_error beside each row: the errors of its label added up. A label's rows meet the sum under several keys, so a hot label isn't one task's."""
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    sums = stored(sums, "labels").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = codes.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")).alias("c")
    on = F.col("c.label").eqNullSafe(F.col("s.of")) & (F.col("c.salt") == F.col("s.salt"))
    return salted.join(sums.alias("s"), on).select("c.vec_id", "c.code", "c.error", "s.label_error", "c.codebooks_sha256")


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every vector that is kept.

    Left out are vectors that are null or hold null or non-finite components, and those whose length isn't a multiple of `parts`. Vectors
    of another length have codebooks of their own; an empty vector has code 0 throughout and error 0. Components beyond
    LARGEST / scale are taken as that. A null vec_id comes after all others, and equal ids by their vectors; each row is coded. Null
    labels are one label. An empty table gives no rows. Other columns are ignored.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: from 1 to 256 entries")
    rows = stored(whole_numbers(vectors, parts, scale), "numbers")
    lengths = sorted(r[0] for r in rows.select(F.size("x")).distinct().collect())  # one row for each length of vector
    if not lengths:
        return rows.selectExpr("vec_id", "'' AS code", "0L AS error", "0L AS label_error", "'' AS codebooks_sha256")
    codes = reduce(DataFrame.union, [coded(rows.where(F.size("x") == n), n, parts, entries, rounds) for n in lengths])
    return with_label_error(stored(codes, "codes"))
