"""Token ids in binary files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Ids are counted and ranked, the most frequent first. A rank takes one to four bytes; two bits in a control byte tell how many, so
four ranks share one. Control bytes and data bytes lie apart, and a reader finds all ranks of a block at once: a table has, for each
of the 256 control bytes, the four lengths; their running sum says where each rank begins.

A folder of files: `ranks` is a Parquet table (rank, id, n), `shards` has files of blocks in ascending order of doc_id. A block is

    magic "RVB1", shard u32, block u32, documents u64, control bytes u64, data bytes u64, CRC-32 of the rest u32,
    for each document doc_id i64, null flag u8 and number of ids u64 (three arrays), control bytes, data bytes, line feed

in little-endian numbers. Each document begins a control byte of its own; what is left of its last one stands for ranks of 0, a zero byte each.
Shards are written by Spark's own writer, a block a record, so commits and retries are Spark's, on any storage it can write to.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import chunks, shared_dir, stored, text_bytes
from .packing import END_ID, encoder

#: Ids of a shard, about: a task reads and writes one.
SHARD_IDS = 16_000_000
#: Ids of a block; a longer document is a block of its own.
BLOCK_IDS = 1_000_000
#: Shards whose ids are added up together; the sums of such runs are added up in one task.
RUN = 1_024
MAGIC = b"RVB1"
_HEAD = struct.Struct("<4sIIQQQI")
_PLACES = np.arange(4)
#: The lengths of the four ranks of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> (2 * _PLACES)) & 3).astype(np.uint8) + 1
#: What is kept of four bytes read at a rank's place, by its length.
_MASK = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of the ranks."""
    padded = np.zeros(-(-len(ranks) // 4) * 4, "<u4")
    padded[: len(ranks)] = ranks
    code = (padded > 0xFF).astype(np.uint8) + (padded > 0xFFFF) + (padded > 0xFFFFFF)
    control = (code.reshape(-1, 4) << (2 * _PLACES).astype(np.uint8)).sum(1).astype(np.uint8)
    data = padded.view(np.uint8).reshape(-1, 4)[_PLACES <= code[:, None]]
    return control.tobytes(), data.tobytes()


def decode(control: np.ndarray, data: np.ndarray) -> np.ndarray:
    """All ranks, those of the padding too."""
    length = LENGTHS[control].ravel()
    ends = np.cumsum(length, dtype=np.int64)
    if (ends[-1] if len(ends) else 0) != len(data):
        raise ValueError("control bytes and data bytes don't agree")
    at = ends - length
    wide = np.concatenate([data, np.zeros(3, np.uint8)])
    words = np.ndarray(len(data), "<u4", wide.data, strides=(1,)) if len(data) else np.zeros(0, "<u4")  # four bytes from every place
    return words[at] & _MASK[length]


def block(shard: int, number: int, docs: list[int | None], sizes: list[int], control: bytes, data: bytes) -> bytes:
    body = b"".join((np.array([d or 0 for d in docs], "<i8").tobytes(), np.array([d is None for d in docs], np.uint8).tobytes(), np.array(sizes, "<u8").tobytes(), control, data))
    return _HEAD.pack(MAGIC, shard, number, len(docs), len(control), len(data), zlib.crc32(body)) + body


def blocks(content: bytes) -> Iterator[tuple[int, list[int | None], np.ndarray, np.ndarray, np.ndarray]]:
    """(shard, doc_ids, numbers of ids, control bytes, data bytes) of each block of a file."""
    at = 0
    while at < len(content):
        magic, shard, _, n, n_control, n_data, crc = _HEAD.unpack_from(content, at)
        at += _HEAD.size
        body = memoryview(content)[at : at + 17 * n + n_control + n_data]
        if magic != MAGIC or zlib.crc32(body) != crc:
            raise ValueError("a damaged block")
        docs = [None if gone else d for d, gone in zip(np.frombuffer(body, "<i8", n).tolist(), np.frombuffer(body, np.uint8, n, 8 * n).tolist())]
        yield shard, docs, np.frombuffer(body, "<u8", n, 9 * n).astype(np.int64), np.frombuffer(body, np.uint8, n_control, 17 * n), np.frombuffer(body, np.uint8, n_data, 17 * n + n_control)
        at += len(body) + 1


def encoded(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, row (another for each row), n_ids, crc, ids (unsigned 16- or 32-bit numbers, whichever hold them, with the width before them)."""
    kinds = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_ids", pa.int64()), ("crc", pa.int64()), ("ids", pa.binary())])

    def ids(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        with encoder(tokenizer) as words:
            for part, texts in chunks(batches):
                found = [words.encode(t) + end for t in texts]
                numbers = [np.frombuffer(x, "<u4") for x in found]
                narrow = [b"\2" + x.astype("<u2").tobytes() if x.max() < 1 << 16 else b"\4" + x.tobytes() for x in numbers]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(map(len, numbers), pa.int64()), pa.array(map(zlib.crc32, found), pa.int64()), pa.array(narrow, pa.binary())], schema=kinds)

    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), text_bytes())
    return rows.mapInArrow(ids, "doc_id long, row long, n_ids long, crc long, ids binary")


def _numbers(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, f"<u{ids[0]}", offset=1)


def _together(arrays: Iterable[np.ndarray], size: int) -> Iterator[np.ndarray]:
    """The arrays in their order, joined to about `size` numbers."""
    held, n = [], 0
    for x in arrays:
        held.append(x)
        n += len(x)
        if n >= size:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def ranked(ids: DataFrame) -> DataFrame:
    """(id, n) of every id that occurs: at most one row for each id of the vocabulary. Tasks add up first."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for numbers in _together((_numbers(x.as_py()) for batch in batches for x in batch.column(0)), BLOCK_IDS):
            own = np.bincount(numbers, minlength=len(total))
            own[: len(total)] += total
            total = own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    return ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS, block_ids: int = BLOCK_IDS) -> None:
    """The ids of all documents below path. Null doc_ids come first; equal ones follow each other by the CRC-32 of their ids, then in any order."""
    spark = docs.sparkSession
    ids = encoded(docs, tokenizer, end_id)
    folder = f"{shared_dir(spark)}/ids"
    ids.write.option("compression", "zstd").parquet(folder)
    ids = spark.read.schema(ids.schema).parquet(folder)
    counts = sorted(((r["n"], r["id"]) for r in ranked(ids).collect()), key=lambda x: (-x[0], x[1]))  # as many as the vocabulary has ids, at most
    spark.createDataFrame([(k, i, n) for k, (n, i) in enumerate(counts)], "rank int, id long, n long").coalesce(1).write.parquet(f"{path}/ranks")
    rank = np.zeros(max((i for _, i in counts), default=0) + 1, np.uint32)
    rank[[i for _, i in counts]] = np.arange(len(counts))
    shared = spark.sparkContext.broadcast(rank)  # by id: as long as the vocabulary
    shards = max(1, -(-sum(n for n, _ in counts) // shard_ids))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = TaskContext.get().partitionId(), 0
        rows: list[tuple[int | None, np.ndarray]] = []
        held = 0
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = _numbers(raw.as_py())
                if rows and held + len(own) > block_ids:
                    yield framed(shard, number, rows)
                    rows, number, held = [], number + 1, 0
                rows.append((doc, own))
                held += len(own)
        if rows:
            yield framed(shard, number, rows)

    def framed(shard: int, number: int, rows: list[tuple[int | None, np.ndarray]]) -> pa.RecordBatch:
        """A block; all its documents are encoded at once, each padded to whole control bytes."""
        sizes = [len(own) for _, own in rows]
        ranks, at = np.zeros(sum(-(-n // 4) * 4 for n in sizes), np.uint32), 0
        for n, (_, own) in zip(sizes, rows):
            ranks[at : at + n] = shared.value[own]
            at += -(-n // 4) * 4
        return pa.RecordBatch.from_arrays([pa.array([block(shard, number, [doc for doc, _ in rows], sizes, *encode(ranks))], pa.binary())], names=["block"])

    order = [F.col("doc_id").asc_nulls_first(), "crc", "n_ids", "row"]
    dealt = ids.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "ids")
    dealt.mapInArrow(write, "block binary").select(F.col("block").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{path}/shards")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """shard, before (ids before the document in its shard), doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers), from the files alone."""
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()  # as many as the vocabulary has ids, at most
    shared = spark.sparkContext.broadcast(np.array([r["id"] for r in ranks], "<u4"))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                before = 0
                for shard, docs, sizes, control, data in blocks(content.as_py()):
                    ids = shared.value[decode(control, data)]
                    first = np.cumsum((sizes + 3) // 4 * 4) - (sizes + 3) // 4 * 4
                    crcs = [zlib.crc32(ids[i : i + n]) for i, n in zip(first.tolist(), sizes.tolist())]
                    starts = before + np.cumsum(sizes) - sizes
                    before += int(sizes.sum())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), shard, np.int64)), pa.array(starts), pa.array(docs, pa.int64()), pa.array(sizes), pa.array(crcs, pa.int64())], names=["shard", "before", "doc_id", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/shards").select("content")
    return files.mapInArrow(read, "shard long, before long, doc_id long, n_tokens long, ids_crc32 long")


def shard_starts(rows: DataFrame) -> DataFrame:
    """(shard, first): ids of all shards before it, added up in runs of shards."""
    sums = stored(rows.groupBy("shard").agg(F.max(F.col("before") + F.col("n_tokens")).alias("n")), "shard_sums").withColumn("run", F.floor(F.col("shard") / RUN))
    by = sums.groupBy("run").agg(F.sum("n").alias("n"))
    by = by.select("run", (F.sum("n").over(Window.orderBy("run")) - F.col("n")).alias("earlier"))  # a row for RUN shards
    within = F.sum("n").over(Window.partitionBy("run").orderBy("shard")) - F.col("n")
    return sums.withColumn("within", within).join(by, "run").select("shard", (F.col("within") + F.col("earlier")).alias("first"))


def token_files(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Writes the ids of all documents, reads the files and returns doc_id, start, n_tokens, ids_crc32.

    A null or empty text is end_id alone. Texts of any length are encoded whole; a task holds one of them, or a batch. Each row gives one, also where
    doc_id is null (they come first) or repeated (in the order of the ids' CRC-32). An empty table gives no rows. Other columns are ignored.
    """
    path = path or f"{shared_dir(docs.sparkSession)}/tokens"
    write_files(docs, path, tokenizer, end_id, shard_ids, block_ids)
    rows = stored(read_files(docs.sparkSession, path), "read")
    return rows.join(shard_starts(rows), "shard").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
