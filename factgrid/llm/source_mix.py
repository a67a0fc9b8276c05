"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are dealt into permuted blocks by a hash of their id and text. A source's target, as a
number of block draws (whole passes over its blocks, then part of a pass), is its exact quota. The
tree halves the output shards level by level: of a node's draws, a uniformly random subset of fixed
size goes to the left half, so the counts by source are a multivariate-hypergeometric sample and
every level's counts add up to the quotas. A leaf is a shard; it takes the next undrawn blocks of each
source's permutation, so shards are disjoint, and orders its documents by a hash.

Only DataFrame functions are used. Documents are never gathered by source: sums by (source, cell of
the hash) find where a target ends, first in coarse cells, then within the one cell where it falls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

SHARE = 1.5
MOST = 2.0
WEIGHTS = (3, 1, 2)
SHARDS = 16
#: Documents in a cell of the hash, about, and bits of the hash for coarse cells and for the finer cells within one, at most.
CELL = 256
BITS = 12
#: Blocks of all sources together, at most; with that many draws the tree's tables stay small at any input size.
MAX_BLOCKS = 16_384
WORD = r"[^\x20\x09-\x0D]+"


def key(seed: int = 0) -> Column:
    """A hash of a document's id and text; null ids and repeated ones spread by their texts."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit("")), F.lit(seed))


def sized(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, source, size (words), key."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), key(seed).alias("key"))


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """source, source_size, n_docs, target from (source, size); one row per source, so its windows are small.

    Filling by weight with a limit per source: with sources ordered by limit / weight, the first ones
    reach their limits and the others get what is left by weight.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int") + 1)
    one = by.withColumn("rank", rank).withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(most))
    before = Window.orderBy(F.col("limit") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # the level once all sources at their limits are set aside: the first that its source doesn't reach
    open_level = F.when(F.col("limit") / F.col("weight") >= F.col("level"), F.col("level"))
    return (
        one.withColumn("level", level).withColumn("open", F.first(open_level, ignorenulls=True).over(Window.orderBy(F.col("limit") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .select("source", "source_size", "n_docs", F.coalesce(F.least("limit", F.col("open") * F.col("weight")), F.col("limit")).alias("target"))
    )


def _located(sizes: DataFrame, p: DataFrame) -> DataFrame:
    """The documents with their source's row of p, h (the key's leading 32 bits), and c1 and c2, the coarse cell of h and the finer one within it."""
    joined = sizes.withColumn("h", F.shiftrightunsigned("key", 32)).withColumnRenamed("source", "s").join(p, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    fine = F.expr("shiftright(h, cast(32 - b1 - b2 as int)) & (shiftleft(1L, cast(b2 as int)) - 1)")
    return joined.withColumns({"c1": F.expr("shiftright(h, cast(32 - b1 as int))"), "c2": fine})


def _cut(located: DataFrame, cell: str, taken: Column) -> DataFrame:
    """Per source, the cell in which the sum reaches what the part pass is to take, and the sum before it."""
    sums = located.groupBy("source", "rest", cell, taken.alias("taken")).agg(F.sum("size").alias("n"))
    sums = sums.withColumn("before", F.col("taken") + F.sum("n").over(Window.partitionBy("source").orderBy(cell)) - F.col("n"))
    found = sums.where((F.col("rest") > 0) & (F.col("before") <= F.col("rest")) & (F.col("before") + F.col("n") > F.col("rest")))
    return found.select(F.col("source").alias("s"), F.col(cell).alias(f"cut_{cell}"), F.col("before").alias(f"before_{cell}"))


def plan(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """Per source: target, passes (whole ones), cut_c1 and cut_c2 (cells where the part pass ends), extra (keys taken in that cell),
    blocks (that its documents are dealt into) and draws (whole passes over them and the blocks of the part pass: its exact quota).

    Every cell before the cut is drawn. Within the cut's finer cell, documents are taken in the order of their hash
    if they fit, then one more if that comes nearer: the sum misses the target by less than the smallest document left there.
    """
    b = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n_docs") / F.lit(CELL))).cast("int"))
    t = targets(sizes, share, most, weights).withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    t = t.withColumns({"rest": F.col("target") - F.col("passes") * F.col("source_size"), "b1": F.least(b, F.lit(BITS)), "b2": F.least(F.greatest(b - BITS, F.lit(0)), F.lit(BITS))})
    share_of = F.floor(F.col("source_size") * MAX_BLOCKS / F.greatest(F.lit(1), F.sum("source_size").over(Window.partitionBy())))
    p = stored(t.withColumn("blocks", F.greatest(F.lit(1), F.least("n_docs", share_of)).cast("int")).drop("n_docs"), "targets")
    p = stored(p.join(_cut(_located(sizes, p), "c1", F.lit(0)), F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "coarse")
    inside = _located(sizes, p).where(F.col("c1") == F.col("cut_c1"))
    p = stored(p.join(_cut(inside, "c2", F.col("before_c1")), F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "fine")
    last = _located(sizes, p).where((F.col("c1") == F.col("cut_c1")) & (F.col("c2") == F.col("cut_c2")))
    last = last.groupBy("source", "key", "rest", "before_c2").agg(F.sum("size").alias("size"))  # equal rows are one
    docs = F.array_sort(F.collect_list(F.struct("key", "size")))  # a finer cell's, about CELL
    fits = F.aggregate(
        "docs", F.struct("room", F.array().cast("array<bigint>").alias("keys")),
        lambda acc, x: F.when(x["size"] <= acc["room"], F.struct((acc["room"] - x["size"]).alias("room"), F.concat(acc["keys"], F.array(x["key"])).alias("keys"))).otherwise(acc),
    )
    cell = last.groupBy(F.col("source").alias("s")).agg(docs.alias("docs"), (F.first("rest") - F.first("before_c2")).alias("room")).withColumn("fits", fits)
    over = F.array_min(F.transform(F.filter("docs", lambda x: ~F.array_contains("fits.keys", x["key"])), lambda x: F.struct(F.abs(x["size"] - F.col("fits.room")).alias("off"), x["key"].alias("key"))))
    extra = cell.withColumn("over", over).select("s", F.when(F.col("over.off") < F.col("fits.room"), F.concat("fits.keys", F.array("over.key"))).otherwise(F.col("fits.keys")).alias("extra"))
    p = p.join(extra, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "before_c1", "before_c2")
    before = F.expr("shiftleft(cut_c1, cast(32 - b1 as int)) + shiftleft(cut_c2, cast(32 - b1 - b2 as int)) - 1")
    last_h = F.greatest(before, F.array_max(F.transform("extra", lambda k: F.shiftrightunsigned(k, 32))))  # of the part pass; without a cut it's empty
    return stored(p.withColumn("draws", (F.col("passes") * F.col("blocks") + F.coalesce(block(last_h) + 1, F.lit(0))).cast("int")), "plan")


def block(h: Column) -> Column:
    return F.floor(h / F.lit(float(1 << 32)) * F.col("blocks")).cast("int")


def dealt(sizes: DataFrame, shards: int = SHARDS, seed: int = 0, **kinds) -> DataFrame:
    """The plan with shard_of, the shard of each of a source's draws in their order."""
    p = plan(sizes, **kinds)
    leaves = tree(p.where("draws > 0").select("source", "blocks", "draws"), shards, seed)
    by = leaves.groupBy(F.col("source").alias("s")).agg(F.map_from_entries(F.collect_list(F.struct("draw", "shard"))).alias("m"))
    p = p.join(by, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    return stored(p.select("*", F.when(F.col("draws") > 0, F.transform(F.sequence(F.lit(0), F.col("draws") - 1), lambda k: F.element_at("m", k))).alias("shard_of")).drop("m"), "dealt")


def _drawn(docs: DataFrame, p: DataFrame) -> DataFrame:
    """docs (with source and key), their source's row of p, and in, the shard of each copy of the document that is drawn."""
    d = _located(docs, p)
    c1, cut1, c2, cut2 = (F.col(x) for x in ("c1", "cut_c1", "c2", "cut_c2"))
    part = (c1 < cut1) | ((c1 == cut1) & ((c2 < cut2) | ((c2 == cut2) & F.array_contains("extra", F.col("key")))))
    n = F.col("passes") + F.coalesce(part, F.lit(False)).cast("int")  # without a cut the part pass is empty
    own = F.transform(F.slice(F.sequence(F.lit(0), F.col("passes").cast("int")), F.lit(1), n.cast("int")), lambda c: F.get("shard_of", F.col("block") + c * F.col("blocks")))
    return d.withColumn("block", block(F.col("h"))).withColumn("in", F.filter(F.coalesce(own, F.array().cast("array<int>")), lambda x: x.isNotNull()))


def assigned(docs: DataFrame, seed: int = 0, shards: int = SHARDS, **kinds) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies of each document, in (the shard of each copy), block and key."""
    sizes = stored(sized(docs, seed), "sizes")
    d = _drawn(sizes, dealt(sizes, shards, seed, **kinds))
    return d.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.size("in")).cast("long").alias("taken"), F.size("in").alias("copies"), "in", "block", "key")


def tree(quotas: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """(source, draw, shard): which shard takes the source's draw-th block; quotas: (source, blocks, draws).

    Level by level: of a node's draws, the first half of a random order (by hash) goes left, in proportion to the shards
    there; only counts by source are kept. Then leaves take draws of a source in order.
    """
    node = quotas.select("source", F.lit(0).alias("node"), F.col("draws").alias("n"))
    levels = max(0, (shards - 1).bit_length())
    for level in range(levels):
        below = 1 << (levels - level - 1)
        first = F.col("node") * F.lit(2 * below)
        inside = F.greatest(F.lit(0), F.least(F.lit(shards), first + 2 * below) - first)
        left = F.greatest(F.lit(0), F.least(F.lit(shards), first + below) - first)
        ticket = node.select("node", "source", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i")).withColumn("r", F.xxhash64("node", "source", "i", F.lit(seed), F.lit(level)))
        w = Window.partitionBy("node")
        goes = F.row_number().over(w.orderBy("r", "source", "i")) <= F.ceil(F.count("*").over(w) * left / inside)
        node = ticket.select("source", (F.col("node") * 2 + F.when(goes, 0).otherwise(1)).alias("node")).groupBy("source", "node").agg(F.count("*").alias("n"))
    node = stored(node, "leaves")
    end = F.sum("n").over(Window.partitionBy("source").orderBy("node"))
    return node.withColumn("end", end).select("source", F.col("node").alias("shard"), F.explode(F.sequence((F.col("end") - F.col("n")).cast("int"), (F.col("end") - 1).cast("int"))).alias("draw"))


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = 0, **kinds) -> DataFrame:
    """The mix itself, a row per taken copy: doc_id, source, size, copy, shard, place (order within the shard)."""
    a = assigned(docs, seed, shards, **kinds).select("doc_id", "source", "size", "key", F.posexplode("in").alias("copy", "shard"))
    return a.select("doc_id", "source", "size", "copy", "shard", F.xxhash64("key", "copy", F.lit(seed)).alias("place"))


def mixed_rows(docs: DataFrame, shards: int = SHARDS, seed: int = 0, **kinds) -> DataFrame:
    """(row, copy, shard, place): the documents' rows as structs of all their columns, once for each taken copy; a row is never joined by its id."""
    p = dealt(stored(sized(docs, seed), "sizes"), shards, seed, **kinds)
    d = _drawn(docs.select(F.struct("*").alias("row"), "source", key(seed).alias("key")), p)
    d = d.select("row", "key", F.posexplode("in").alias("copy", "shard"))
    return d.select("row", "copy", "shard", F.xxhash64("key", "copy", F.lit(seed)).alias("place"))


def shuffled(mixed: DataFrame) -> DataFrame:
    """mixed_rows in the order of the shards, shuffled within each."""
    return mixed.repartition("shard", F.pmod("place", F.lit(64))).sortWithinPartitions("shard", "place")


def write_shards(docs: DataFrame, path: str, **kinds) -> None:
    """The taken copies with their columns (but one named shard), a folder per shard, shuffled within it."""
    columns = [F.col("row")[c].alias(c) for c in docs.columns if c != "shard"]
    shuffled(mixed_rows(docs, **kinds)).select("shard", *columns).write.partitionBy("shard").parquet(path)


def source_mix(docs: DataFrame, seed: int = 0, **kinds) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document, drawn or not.

    size is the number of words, 0 for a null text; a null source is a source of its own, ordered last.
    taken counts the copies in the blocks that the tree deals to shards. Rows equal in doc_id and text are drawn together. Equal seeds and tables give equal results. An empty
    table gives an empty result; documents without words take nothing. Other columns are ignored.
    """
    return assigned(docs, seed, **kinds).select("doc_id", "size", "source_size", "target", "taken", "copies")
