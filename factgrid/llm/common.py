"""Helpers shared by the corpus operators: shared folders, stored steps, text batches, components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIR_KEY = "spark.checkpoint.dir"
#: Bytes of text that a Python helper turns into words at a time; a longer text is taken alone.
CHUNK_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the shared folder the cluster names; local sessions without one get a temporary one."""
    base = spark.conf.get(DIR_KEY, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {DIR_KEY} to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(DIR_KEY, base)
    return f"{base.rstrip('/')}/factgrid/{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of finished steps: it does so once the driver has collected their plans.

    Without a JVM beside this process (Spark Connect) the server's own collections do it later.
    """
    gc.collect()
    if jvm := getattr(getattr(spark, "_sc", None), "_jvm", None):
        jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(col: str = "text") -> Column:
    """The text in UTF-8 as binary; Python then splits and lowers it without decoding it."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary").alias("bytes")


def chunks(batches: Iterable[pa.RecordBatch], text: str = "bytes", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about `limit` bytes of text each, so that memory doesn't follow the batch size."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        texts = [x or b"" for x in column.to_pylist()]
        start = size = 0
        for i, t in enumerate(texts):
            if size and size + len(t) > limit:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t)
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of the edges (src, dst); component is the smallest node reachable.

    Alternating large-star and small-star rounds until only stars are left: no node points to two others or is pointed to while it
    points itself. What a round leaves is written to the shared folder. Nothing is collected but one count a round. The number of rounds
    follows the logarithm of the longest chain; edges that are stars already take none. Edges to itself or null are left out.
    """
    e = stored(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), name)
    for i in count():
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(e.select("v", F.lit(0), F.lit(1)))
        busy = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out = 1 and into = 1)")
        if not busy.agg(F.count("*")).first()[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("x"))
        e = stored(small.select(F.col("x.a").alias("u"), F.col("x.b").alias("v")).where("u <> v").distinct(), f"{name}{i}")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
