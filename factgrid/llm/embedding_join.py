"""Embedding near-duplicates by an exact metric range join.

Unit vectors with cosine >= c are at Euclidean distance <= r = sqrt(2 - 2c). Pivots, a sample of the
vectors, partition them: a vector's home is the cell of its nearest pivot. The triangle inequality sets
with which other cells it must also be compared. A pair is looked at once, by the vector of the higher cell.

Cells are cut into blocks of bounded size, each of which is written once, to a file in the shared folder.
A unit of work is a pair of runs of blocks; its task reads both from there, so that nothing is copied for
each cell that a vector may link into: what lies on disk and is shuffled grows as the input does, though
the products grow as its square. Units that the pivots rule out for each of their blocks aren't made.

Equal vectors are one class first, with a count, so a vector that a third of all rows hold costs as
much as one. A unit returns counts and a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factgrid.storage import Folder

from .common import components, release, shared_dir, stored

THRESHOLD = 0.9
#: Vectors of a block, about.
BLOCK = 2_000
#: Most blocks and bytes of a run; a task holds one run and a block beside it.
RUN, RUN_BYTES = 8, 16 << 20
#: Classes in a cell, about; and the most pivots, which every task holds.
CELL = 2_000
MOST_PIVOTS = 1_024
#: Most tasks of the comparison.
TASKS = 1_024
#: Slack on distances and their squares, far above rounding (a distance near 0 is off by the root of that of a product, some 2e-8): at worst a vector is compared without need.
SLACK = 1e-6


def unit_rows(column: Iterable[bytes], kind: str) -> np.ndarray:
    v = np.stack([np.frombuffer(x, kind) for x in column]).astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@dataclass
class Layout:
    """The pivots, and how blocks are numbered through: cell i has those from starts[i] on; run k has `run` blocks from k * run on."""

    pivots: np.ndarray
    starts: np.ndarray
    run: int
    reach: float
    kind: str

    def cell(self, block: int) -> int:
        return int(np.searchsorted(self.starts, block, "right")) - 1

    def met(self, unit: np.ndarray, home: int, cells: np.ndarray) -> np.ndarray:
        """Whether each of these vectors, at home in one cell, may link into each of `cells`.

        With y in cell j within reach of x: d(x, p_j) <= d(y, p_j) + reach <= d(y, p_i) + reach <= d(x, p_i) + 2 reach;
        for Euclidean distances the plane between two pivots gives a closer bound, and both must hold.
        """
        d = np.sqrt(np.maximum(2 - 2 * unit @ self.pivots[cells].T, 0))
        own = np.sqrt(np.maximum(2 - 2 * unit @ self.pivots[home], 0))[:, None]
        apart = np.sqrt(np.maximum(2 - 2 * self.pivots[cells] @ self.pivots[home], 0))
        return (d - own <= 2 * self.reach + SLACK) & (d**2 - own**2 <= 2 * self.reach * apart + SLACK)


@dataclass
class Block:
    number: int
    cls: np.ndarray
    weight: np.ndarray
    unit: np.ndarray

    def __post_init__(self):
        self.short = self.unit.astype(np.float32)

    @classmethod
    def read(cls, folder: Folder, number: int, kind: str) -> Block | None:
        data = folder.read(f"{number}.npz")
        if data is None:  # no class was dealt to it
            return None
        with np.load(io.BytesIO(data)) as f:
            return cls(number, f["cls"], f["weight"].astype(float), unit_rows(f["vector"], kind))


def homes(classes: DataFrame, pivots: np.ndarray, kind: str) -> DataFrame:
    """(cell, cls, weight, vector): each class in the cell of its nearest pivot."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                cell = (unit_rows(part.column(2).to_pylist(), kind) @ shared.value.T).argmax(1)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *part.columns], names=["cell", "cls", "weight", "vector"])

    return classes.select("cls", "weight", "vector").mapInArrow(deal, "cell int, cls long, weight long, vector binary")


def forest(near: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """(row, column) links that connect whatever the matrix connects; same: rows and columns are the same vectors."""
    seen_a = np.zeros(near.shape[0], bool)
    seen_b = seen_a if same else np.zeros(near.shape[1], bool)
    links = []
    for first in np.flatnonzero(near.any(1)):
        todo = [] if seen_a[first] else [(first, True)]
        seen_a[first] = True
        while todo:
            i, row = todo.pop()
            new = np.flatnonzero((near[i] & ~seen_b) if row else (near[:, i] & ~seen_a))
            (seen_b if row else seen_a)[new] = True
            links += [(i, j) if row else (j, i) for j in new.tolist()]
            todo += [(j, same or not row) for j in new.tolist()]
    return links


def _spanning(links: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of the links, those that connect what wasn't connected by the ones before."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = x = above.get(y, y)
        return x

    kept = []
    for a, b in links:
        if (x := top(a)) != (y := top(b)):
            above[x] = y
            kept.append((a, b))
    return kept


def _near(a: Block, b: Block, rows: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a, rows of b and which of them link in double precision. Single precision, with more slack than its rounding, leaves out the others first."""
    slack = 2.0**-22 * (a.unit.shape[1] + 8)
    maybe = a.short[rows] @ b.short.T >= np.float32(threshold - slack)
    of_a, of_b = rows[maybe.any(1)], np.flatnonzero(maybe.any(0))
    if a is b:
        of_a = of_b = np.union1d(of_a, of_b)
        x = a.unit[of_a]
        near = x @ x.T >= threshold
        near &= near.T
        np.fill_diagonal(near, False)
        return of_a, of_b, near
    return of_a, of_b, a.unit[of_a] @ b.unit[of_b].T >= threshold


def _compare(folder: Folder, at: Layout, threshold: float, left: int, right: int) -> pa.RecordBatch:
    """A unit's rows (cls, n, to): how many vectors each class links to on the other side, and links that connect them."""
    numbers = lambda k: range(k * at.run, (k + 1) * at.run)
    ours = [b for k in numbers(left) if (b := Block.read(folder, k, at.kind))]
    n = {b.number: (b.cls, np.zeros(len(b.cls))) for b in ours}
    links: list[tuple[int, int]] = []
    for k in numbers(right):
        b = next((x for x in ours if x.number == k), None) if left == right else Block.read(folder, k, at.kind)
        if b is None:
            continue
        n.setdefault(k, (b.cls, np.zeros(len(b.cls))))
        cell = at.cell(k)
        for a in ours:
            if a.number < k:
                continue
            home = at.cell(a.number)
            rows = np.arange(len(a.cls)) if home == cell else np.flatnonzero(at.met(a.unit, home, np.array([cell]))[:, 0])
            of_a, of_b, near = _near(a, b, rows, threshold)
            if not near.any():
                continue
            n[a.number][1][of_a] += near @ b.weight[of_b]
            if a is not b:
                n[k][1][of_b] += a.weight[of_a] @ near
            ia, ib = a.cls[of_a].tolist(), b.cls[of_b].tolist()
            links += [(ia[i], ib[j]) for i, j in forest(near, a is b)]
        links = _spanning(links)
    cls, count = (np.concatenate([x[i] for x in n.values()] or [np.zeros(0)]) for i in (0, 1))
    some, pairs = np.flatnonzero(count), np.array(links, np.int64).reshape(-1, 2)
    columns = [(cls[some], pairs[:, 0]), (count[some], np.zeros(len(pairs))), (np.full(len(some), -1), pairs[:, 1])]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in columns], names=["cls", "n", "to"])


def _linked(classes: DataFrame, n: int, dims: int, kind: str, threshold: float, block: int, cell: int, name: str) -> DataFrame:
    """(cls, n, to) of all units: rows with n > 0 count links, the others are links of spanning forests."""
    spark = classes.sparkSession
    sample = classes.orderBy(F.xxhash64("vector"), "cls").limit(int(min(MOST_PIVOTS, max(1, n // cell)))).select("vector").toPandas()
    pivots = unit_rows(sample["vector"], kind)
    dealt = homes(classes, pivots, kind)
    sizes = {r["cell"]: r["count"] for r in dealt.groupBy("cell").count().collect()}  # at most MOST_PIVOTS rows
    inner = [-(-sizes.get(i, 0) // block) for i in range(len(pivots))]
    run = max(1, min(RUN, RUN_BYTES // (block * dims * 8)))
    layout = Layout(pivots, np.cumsum([0, *inner])[:-1], run, float(np.sqrt(2 - 2 * threshold)) + SLACK, kind)
    path, shared = f"{shared_dir(spark)}/blocks{name}", spark.sparkContext.broadcast(layout)

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Puts a block into its file; (left, right) of the units that have something to compare for it."""
        out, at, number = io.BytesIO(), shared.value, int(key[0])
        np.savez(out, cls=rows["cls"].to_numpy(), weight=rows["weight"].to_numpy(), vector=np.array(rows["vector"].tolist(), f"V{len(rows['vector'].iloc[0])}"))
        Folder(path).write(f"{number}.npz", out.getvalue())
        home = at.cell(number)
        below = np.flatnonzero(np.append(at.met(unit_rows(rows["vector"], kind), home, np.arange(home)).any(0), True))
        ends = np.append(at.starts, np.iinfo(np.int64).max)
        runs = {k for c in below for k in range(int(at.starts[c]) // at.run, (min(int(ends[c + 1]) - 1, number)) // at.run + 1) if ends[c + 1] > at.starts[c]}
        return pd.DataFrame({"left": number // at.run, "right": sorted(runs)}).astype("int32")

    places = spark.createDataFrame([(i, int(s), k) for i, (s, k) in enumerate(zip(layout.starts, inner)) if k], "cell int, start int, inner int")
    number = (F.col("start") + F.pmod(F.xxhash64("cls"), F.col("inner"))).cast("int").alias("number")
    numbered = dealt.join(F.broadcast(places), "cell").select(number, "cls", "weight", "vector")
    units = stored(numbered.groupBy("number").applyInPandas(write, "left int, right int").distinct(), f"units{name}")
    release(spark)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder(path)
        for batch in batches:
            for left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield _compare(folder, shared.value, threshold, left, right)

    tasks = units.repartition(max(1, min(TASKS, units.count())))
    return stored(tasks.mapInArrow(compare, "cls long, n long, to long"), f"joined{name}")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, cell: int = CELL) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors that are null, zero or hold null or non-finite components link with nothing: n_links 0 and a component
    of their own; so do vectors of different lengths with each other. Equal vectors link. Each row is a vector of its own, also where its vec_id is
    null or on several rows: it has the links of its own vector alone. component_id is the smallest vec_id that isn't null of the rows reachable, so it is null only
    where none has one; kept compares it with vec_id, null being equal to null. An empty table gives no rows; labels and other columns are ignored.
    """
    single = isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType)
    kind = "<f4" if single else "<f8"  # floats are kept as such on disk
    own = vectors.select("vec_id", "embedding" if single else F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.coalesce(F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
    ok = F.col("embedding").isNotNull() & ~bad & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    packed = _packed(own.where(ok), kind)
    equal = packed.groupBy("vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    classes = stored(equal.withColumn("cls", F.monotonically_increasing_id()), "classes")  # a class has a number of its own, whatever ids its rows have
    release(vectors.sparkSession)
    digest = F.unhex(F.sha2("vector", 256)).alias("digest")  # rows meet their classes by it, so that vectors aren't shuffled again
    member = packed.select("vec_id", digest).join(classes.select(digest, "cls", "weight", "least"), "digest").drop("digest")
    joined = []
    for size, n in classes.groupBy(F.octet_length("vector")).agg(F.count("*")).collect():  # one row for each length of vector
        dims = size // np.dtype(kind).itemsize
        joined.append(_linked(classes.where(F.octet_length("vector") == size), n, dims, kind, threshold, block, cell, str(dims)))
    release(vectors.sparkSession)
    rest = own.where(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if joined:
        links = reduce(DataFrame.union, joined)
        by = links.where("n > 0").groupBy("cls").agg(F.sum("n").alias("n"))
        comp = components(links.where("to >= 0").select(F.col("cls").alias("src"), F.col("to").alias("dst")), "embedding")
        of = comp.withColumnRenamed("node", "cls").join(classes.select("cls", "least"), "cls")
        of = of.select("cls", "component").join(of.groupBy("component").agg(F.min("least").alias("smallest")), "component").select("cls", "smallest")
        found = member.join(by, "cls", "left").join(of.withColumn("linked", F.lit(True)), "cls", "left")
        component = F.when(F.col("linked"), F.col("smallest")).otherwise(F.col("least"))
        rest = found.select("vec_id", (F.coalesce(F.col("n"), F.lit(0)) + F.col("weight") - 1).alias("n_links"), component.alias("component_id")).union(rest)
    return rest.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _packed(own: DataFrame, kind: str) -> DataFrame:
    """vec_id and the vector's numbers as little-endian bytes, which numpy reads without copying; 0.0 for -0.0."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(x.values.to_numpy(zero_copy_only=False).astype(kind) + 0.0).astype(kind).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["vec_id", "vector"])

    return own.mapInArrow(pack, T.StructType([own.schema["vec_id"], T.StructField("vector", T.BinaryType())]))
