"""Exact deduplication over an extendible-hash index on shared files.

The index has one entry for each distinct text. Its directory starts with one bucket over the whole range of 64-bit keys and
doubles, one more leading bit at a time, until no bucket holds more than `capacity` keys; a bucket that fits keeps its
shallower local depth and is shared by several directory cells. Keys are counted before any text moves.

Then each row goes to the task that owns its bucket, a contiguous range of keys. The owner chains the texts of a key that differ
in bytes, and finds of each text's copies which stays and how many there are. A key with very many rows is hot: its copies are
combined in the tasks that read them, so that its owner gets one row from each.

Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_dir

#: Keys of a bucket.
CAPACITY = 1_024
#: The directory has at most 2 ** MAX_DEPTH cells, so it can be broadcast at any input size; beyond 2 ** MAX_DEPTH * CAPACITY keys buckets grow.
MAX_DEPTH = 20
#: A key is hot from so many rows on, or from this share of all rows on where that is more: at most 1 / HOT_SHARE keys are.
HOT_ROWS, HOT_SHARE = 1_000, 1e-5


def with_key(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("key"))


def cell(key: str, depth: int = MAX_DEPTH) -> Column:
    """The leading bits of the key."""
    return F.shiftrightunsigned(F.col(key), 64 - depth) if depth else F.lit(0).cast("long")


def directory(cells: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(cell, bucket, local_depth) for each cell of the fully doubled directory; cells: (cell, n), the keys of each that has any."""
    levels = (
        cells.select(F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth"), "cell", "n")
        .groupBy("depth", F.expr(f"shiftright(cell, {max_depth} - depth)").alias("prefix"))
        .agg(F.sum("n").alias("n"))
    )
    split = levels.where(F.col("n") > capacity).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"))
    halves = levels.withColumn("above", F.expr("shiftright(prefix, 1)")).join(split, ["depth", "above"], "left_semi")
    leaves = halves.select("depth", "prefix", "n").union(levels.where("depth = 0").select("depth", "prefix", "n")).where((F.col("n") <= capacity) | (F.col("depth") == max_depth))
    first = F.expr(f"shiftleft(prefix, {max_depth} - depth)")
    last = F.expr(f"shiftleft(prefix + 1, {max_depth} - depth) - 1")
    return leaves.select(first.alias("bucket"), F.col("depth").alias("local_depth"), F.explode(F.sequence(first, last)).alias("cell"))


def write_index(docs: DataFrame, path: str, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The index as files under `path`, an entry per distinct text: bucket, local_depth, key, chain, text_sha256, keep_id, group_size."""
    spark, keyed = docs.sparkSession, with_key(docs)
    keyed.groupBy("key").agg(F.count("*").alias("n")).write.parquet(f"{path}/keys")
    keys = spark.read.parquet(f"{path}/keys")
    keys.groupBy(cell("key", max_depth).alias("cell")).agg(F.count("*").alias("n"), F.sum("n").alias("rows")).write.parquet(f"{path}/cells")
    cells = spark.read.parquet(f"{path}/cells")
    n, rows = cells.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    depth = min(max_depth, math.ceil(math.log2(max(1, n / capacity))) + 3)  # keys spread evenly, so that no bucket splits much further
    cells = cells.groupBy(F.shiftright("cell", max_depth - depth).alias("cell")).agg(F.sum("n").alias("n"))
    directory(cells, capacity, depth).write.parquet(f"{path}/directory")

    owner = F.broadcast(spark.read.parquet(f"{path}/directory"))  # at most 2 ** max_depth rows
    placed = keyed.withColumn("cell", cell("key", depth)).join(owner, "cell").select("bucket", "local_depth", "key", "text", "doc_id")
    hot = F.broadcast(keys.where(F.col("n") > max(hot_rows, math.ceil(rows * HOT_SHARE))).select("key"))  # at most 1 / HOT_SHARE rows
    entry = ["bucket", "local_depth", "key", "text"]
    alone = placed.join(hot, "key", "left_anti").select(*entry, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    combined = placed.join(hot, "key", "left_semi").groupBy(*entry).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # from here on each bucket is in one task: equal bytes are one entry, others of the same key its chain
    owned = alone.unionByName(combined).repartition("bucket").groupBy(*entry).agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    hashed = owned.select("bucket", "local_depth", "key", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size")
    chained = Window.partitionBy("bucket", "key").orderBy("text_sha256")
    hashed.withColumn("chain", F.row_number().over(chained)).write.parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, bucket, local_depth, chain.

    Texts are equal when their UTF-8 bytes are; null counts as empty; texts of any length are compared whole. The largest doc_id of equal
    texts stays. Other columns are ignored. A doc_id on several rows gets a row for each, and all rows
    with the largest doc_id count as kept. An empty table gives an empty result; a null doc_id is
    never the one that stays unless all of its group are null (keep_id is then null, kept false).
    """
    index = write_index(docs, shared_dir(docs.sparkSession), capacity, max_depth, hot_rows)
    keys = with_key(docs).select("doc_id", "key", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    return keys.join(index, ["key", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256", "bucket", "local_depth", "chain",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: for each distinct text one row, of its largest doc_id, null only where all are.

    Of rows equal in text and doc_id the first by the other columns stays; all but one of them go before the shuffle.
    """
    index = write_index(docs, shared_dir(docs.sparkSession))
    text = F.coalesce(F.col("text"), F.lit(""))
    own = {"_no_id": F.col("doc_id").isNull(), "_id": F.coalesce(F.col("doc_id"), F.lit(0).cast("long")), "_key": F.xxhash64(text), "_sha256": F.sha2(text.cast("binary"), 256)}
    others = [f.name for f in docs.schema if f.name not in ("doc_id", "text") and f.dataType.typeName() not in ("map", "variant")]
    rank = F.row_number().over(Window.partitionBy(*own).orderBy(F.col("text").isNull(), *others))  # with a limit of 1 in each task
    once = docs.withColumns(own).withColumn("_rank", rank).where("_rank = 1")
    stay = index.select(F.col("keep_id").isNull().alias("_no_id"), F.coalesce("keep_id", F.lit(0).cast("long")).alias("_id"), F.col("key").alias("_key"), F.col("text_sha256").alias("_sha256"))
    return once.join(stay, list(own), "left_semi").select(docs.columns)
