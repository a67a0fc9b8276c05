"""N-gram Jaccard self-join by grouped prefix filtering.

A document's set is its distinct hashed word shingles. Sets are ordered by how often a shingle's bucket of a fixed-size count
table was seen, rare ones first, so that shingles of widely shared passages come last. Two sets that are similar enough share a
shingle in their prefixes. Equal sets are one class; classes with the same prefix and size are one group, and only groups
are posted under the shingles of their prefix.

Documents that are linked through others need no test of their own. So each posted shingle first links its groups to one
of them. What remains are pairs of groups whose components differ, and for these the prefix filter is applied once more, to
the shingles that are still posted: a pair has to share so many of them that the first one it shares, by their number of
groups, lies near the front of both. That leaves out the widely posted shingles. Each pair of groups that is found goes on if the
bitmaps of its sets (bits that differ stand for a different shingle each) and the shingles shared in the prefixes allow enough in
common; then it is expanded to its members' pairs, and their whole sets decide. No link between different components is left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import chunks, components, release, stored, text_bytes
from .shingles import Words, windows

SHINGLE = 5
PERCENT = 80
#: Buckets of the count table; its size doesn't grow with the input.
TABLE_BITS = 18
_PARTS = 32
#: 64-bit words of a set's bitmap; a bit tells whether an odd number of the set's shingles fall on it.
BITMAP = 8
#: Rounds that link each posted shingle's groups to one of them before the rest is looked at.
ROUNDS = 2
#: Groups that a group remembers to have been tested with, so that the last join needn't emit them; others are left out after it.
REMEMBERED = 8


def shingle_sets(texts: list[bytes], known: Words, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text with fewer words is one shingle, one without words none."""
    out = []
    for t in texts:
        words = t.lower().split()  # lowers A-Z alone, splits at ASCII white space alone
        out.append(np.unique(windows(known.of(words), min(size, len(words)))) if words else np.zeros(0, np.uint64))
    return out


def count_table(docs: DataFrame, size: int = SHINGLE, bits: int = TABLE_BITS) -> np.ndarray:
    """In how many documents each of 2 ** bits buckets of shingles was seen, over all documents."""
    width = (1 << bits) // _PARTS

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = Words(), np.zeros(1 << bits, np.int64)
        for _, texts in chunks(batches):
            table += np.bincount((np.concatenate(shingle_sets(texts, known, size)) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        if table.any():
            parts = table.reshape(_PARTS, width)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(_PARTS, dtype=np.int32)), pa.array([x.tobytes() for x in parts], pa.binary())], names=["part", "counts"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[part] = sums.get(part, 0) + np.frombuffer(counts, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "counts"])

    kinds = "part int, counts binary"
    rows = docs.select(text_bytes()).mapInArrow(count, kinds).repartition(_PARTS, "part").mapInArrow(add, kinds).collect()  # 2 ** bits numbers
    table = np.zeros((_PARTS, width), np.int64)
    for part, counts in rows:
        table[part] = np.frombuffer(counts, np.int64)
    return table.ravel()


def features(docs: DataFrame, table: np.ndarray, size: int, percent: int) -> DataFrame:
    """doc_id, n (set size), sig and pkey (128-bit hashes of the set and of the prefix), prefix (shingles in the table's order), bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(table)  # 2 ** TABLE_BITS numbers
    bits = len(table).bit_length() - 1

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for part, texts in chunks(batches):
            sets = shingle_sets(texts, known, size)
            prefixes, maps = [], []
            for s in sets:
                maps.append(np.packbits(np.bincount((s % np.uint64(64 * BITMAP)).astype(np.int64), minlength=64 * BITMAP) & 1).view(np.int64))
                keep = len(s) - (len(s) * percent + 99) // 100 + 1 if len(s) else 0
                seen = shared.value[(s >> np.uint64(64 - bits)).astype(np.int64)]
                prefixes.append(s[np.lexsort((s, seen))[:keep]].view(np.int64))
            columns = [
                part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([xxhash.xxh3_128_digest(p.tobytes()) for p in prefixes], pa.binary()), pa.array(prefixes, pa.list_(pa.int64())),
                pa.array(maps, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "sig", "pkey", "prefix", "bitmap"])

    return docs.select("doc_id", text_bytes()).mapInArrow(describe, "doc_id long, n long, sig binary, pkey binary, prefix array<long>, bitmap array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """(id, shingles) of the wanted ids: of several texts with one doc_id, the one that stands for the class."""

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for part, texts in chunks(batches):
            raw = [s.tobytes() for s in shingle_sets(texts, known, size)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([xxhash.xxh3_128_digest(r) for r in raw], pa.binary()), pa.array(raw, pa.binary())], names=["id", "sig", "shingles"])

    own = docs.select("doc_id", text_bytes()).join(wanted.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    found = own.mapInArrow(sets, "id long, sig binary, shingles binary")
    return found.join(members.select(F.col("cls").alias("id"), "sig"), ["id", "sig"], "left_semi").dropDuplicates(["id", "sig"]).select("id", "shingles")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(src, dst) of the pairs (a, b) that are similar enough."""

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k).to_pylist() for k in (2, 3))
            good = []
            for x, y in zip(a, b):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                same = int((y[at] == x).sum())
                good.append(100 * same >= percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["src", "dst"]).filter(pa.array(good, pa.bool_()))

    left = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    both = left.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(verify, "src long, dst long")


class Sizes:
    """What set sizes allow: fits, whether sets of these sizes can be similar enough; needed, how many shingles their prefixes must share."""

    def __init__(self, percent: int):
        self.percent = percent

    def fits(self, x: Column, y: Column) -> Column:
        return (x * 100 >= y * self.percent) & (y * 100 >= x * self.percent)

    def common(self, x: Column, y: Column) -> Column:
        return F.ceil((x + y) * self.percent / (100 + self.percent))

    def needed(self, x: Column, y: Column) -> Column:
        """Of two sorted sets, the shingles that they share lie in both prefixes or behind one of them."""
        behind = lambda n: F.ceil(n * self.percent / 100) - 1
        return self.common(x, y) - F.greatest(behind(x), behind(y))


def _spans(members: DataFrame, comp: DataFrame | None) -> DataFrame:
    """(gid, n, lo, hi): set size, and the least and the greatest component of a group's classes; without components each class is one."""
    if comp is not None:
        members = members.join(comp, F.col("cls") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "cls"))
    else:
        members = members.withColumn("comp", F.col("cls"))
    return members.groupBy("gid").agg(F.max("n").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))


def _to_hubs(posts: DataFrame, spans: DataFrame, sizes: Sizes, k: int) -> DataFrame:
    """(gid, to, shared): groups and the one that stands for a shingle they share, another in each round, where components differ.

    First it is a group most of whose prefix others have too, which is likelier to be what they were copied from.
    """
    now = posts.drop("n").join(spans, "gid")
    order = [F.xxhash64("lo", F.lit(k)), F.xxhash64("gid", F.lit(k))] if k else [-F.col("common") / F.col("n")]
    key = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), F.col("gid").alias("to"))
    hubs = now.groupBy("shingle").agg(F.min(key)["to"].alias("to"))
    sides = spans.select(F.col("gid").alias("to"), F.col("n").alias("n_to"), F.col("lo").alias("lo_to"), F.col("hi").alias("hi_to"))
    apart = ~((F.col("lo") == F.col("hi")) & (F.col("lo") == F.col("lo_to")) & (F.col("lo") == F.col("hi_to")))
    shared = now.join(hubs, "shingle").where("gid <> to").groupBy("gid", "to", "n", "lo", "hi").agg(F.count("*").alias("shared")).join(sides, "to")
    enough = apart & sizes.fits(F.col("n"), F.col("n_to")) & (2 * F.col("shared") >= sizes.needed(F.col("n"), F.col("n_to")))
    return shared.where(enough).select("gid", "to", "shared")


def _open_posts(posts: DataFrame, spans: DataFrame, asked: DataFrame) -> DataFrame:
    """Postings of the shingles that hold several components, with their rank among the group's (those with few groups first) and their number.

    main marks the groups of a shingle's largest component, which needn't meet each other.
    """
    now = posts.select("gid", "shingle").join(spans, "gid")
    by = now.groupBy("shingle", "lo", "hi").agg(F.count("*").alias("c"))
    most = F.max(F.when(F.col("lo") == F.col("hi"), F.struct("c", "lo")))
    by = by.groupBy("shingle").agg(F.sum("c").alias("groups"), F.min("lo").alias("low"), F.max("hi").alias("high"), most["lo"].alias("largest")).where("low < high")
    left = now.join(by.select("shingle", "groups", "largest"), "shingle").withColumn("main", F.coalesce((F.col("lo") == F.col("hi")) & (F.col("lo") == F.col("largest")), F.lit(False)))
    own = Window.partitionBy("gid")  # a document's prefix at most
    left = left.withColumn("rank", F.row_number().over(own.orderBy("groups", "shingle"))).withColumn("posted", F.count("*").over(own)).drop("groups", "largest")
    return left.join(asked, "gid", "left")


def _open_pairs(left: DataFrame, sizes: Sizes) -> DataFrame:
    """(a, b): pairs of groups in different components that may share as many posted shingles as they must."""
    x, y = left.where("not main").alias("x"), left.alias("y")
    n = F.col("x.n"), F.col("y.n")
    once = F.col("y.main") | (F.col("x.gid") < F.col("y.gid"))
    apart = ~((F.col("x.lo") == F.col("x.hi")) & (F.col("x.lo") == F.col("y.lo")) & (F.col("x.lo") == F.col("y.hi")))
    # of the c shingles that a pair shares, the first lies before the last c - 1 of either
    front = lambda s: F.col(f"{s}.rank") <= F.col(f"{s}.posted") - sizes.needed(*n) + 1
    new = lambda s, t: ~F.coalesce(F.array_contains(F.col(f"{s}.asked"), F.col(f"{t}.gid")), F.lit(False))
    met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & once & apart & sizes.fits(*n) & front("x") & front("y") & new("x", "y") & new("y", "x"))
    return met.select(F.least("x.gid", "y.gid").alias("a"), F.greatest("x.gid", "y.gid").alias("b")).distinct()


def _enough(pairs: DataFrame, groups: DataFrame, sizes: Sizes) -> DataFrame:
    """The pairs of groups whose sets, by the bitmaps, and prefixes may share enough."""
    side = lambda s: groups.select(*(F.col(c).alias(t) for c, t in (("gid", s), ("n", f"n_{s}"), ("bitmap", f"m_{s}"), ("alone", f"alone_{s}"), ("prefix", f"p_{s}"))))
    both, n = pairs.join(side("a"), "a").join(side("b"), "b"), (F.col("n_a"), F.col("n_b"))
    differ = sum((F.bit_count(F.col("m_a")[i].bitwiseXOR(F.col("m_b")[i])) for i in range(BITMAP)), F.lit(0))
    close = ~F.col("alone_a") | ~F.col("alone_b") | (differ + 2 * sizes.common(*n) <= n[0] + n[1])
    return both.where(close & (F.size(F.array_intersect("p_a", "p_b")) >= sizes.needed(*n))).select("a", "b")


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def near_documents(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id for every document.

    A-Z is lowered; words lie between ASCII white space. Documents link when 100 * intersection >= percent * union of
    their sets, which is tested on whole numbers, so a tie links. Null and empty texts have an empty set and link with nothing.
    Texts of any length are taken whole, and a task holds one batch of them. component_id is the smallest doc_id reachable. Rows with
    the same doc_id count as one document: it has the links of each of its texts to equal ones and, of the classes that it is the smallest
    doc_id of, those of the one with the smallest hash. Rows with a null doc_id link with nothing. An empty table gives no rows; other columns are ignored.
    """
    spark, sizes = docs.sparkSession, Sizes(percent)
    known = stored(features(docs, count_table(docs, size), size, percent), "features")
    full = known.where("n > 0 and doc_id is not null")
    classes = stored(full.groupBy("sig", "n", "pkey").agg(F.min("doc_id").alias("cls")), "sets")
    member = stored(full.select("doc_id", "sig").join(classes.select("sig", "cls"), "sig").select("doc_id", "cls"), "members")
    nodes = classes.groupBy("cls").agg(F.min(F.struct("sig", "n", "pkey")).alias("s")).select("cls", "s.*")
    by = nodes.groupBy("pkey", "n").agg(F.min("cls").alias("gid"), F.count("*").alias("size"))
    members = stored(nodes.join(by, ["pkey", "n"]).select("cls", "sig", "gid", "n", "size"), "classes")
    heads = members.where("cls = gid").select(F.col("cls").alias("doc_id"), "sig", (F.col("size") == 1).alias("alone"))
    groups = full.join(heads, ["doc_id", "sig"]).dropDuplicates(["doc_id", "sig"]).select(F.col("doc_id").alias("gid"), "n", "prefix", "bitmap", "alone")
    groups, members = stored(groups, "groups"), members.select("cls", "sig", "gid", "n")
    release(spark)
    each = groups.select("gid", "n", F.explode("prefix").alias("shingle"))
    several = each.groupBy("shingle").agg(F.count("*").alias("c")).where("c > 1").select("shingle")
    posts = stored(each.join(several, "shingle", "left_semi"), "posts")
    posts = posts.join(posts.groupBy("gid").agg(F.count("*").alias("common")), "gid")
    posts = stored(posts, "ranked")
    release(spark)

    tested: list[DataFrame] = []
    sets: list[DataFrame] = []
    asked: list[DataFrame] = []
    comp = None
    for k in range(rounds + 1):
        spans = stored(_spans(members, comp), f"spans{k}")
        if k < rounds:
            hubs = stored(_to_hubs(posts, spans, sizes, k), f"hubs{k}")
            asked.append(hubs.join(groups.where("alone").select(F.col("gid").alias("to")), "to", "left_semi"))
            pairs = _ordered(hubs.join(members.select("cls", "gid"), "gid"), "cls", "to")
            pairs = pairs if k else pairs.union(_ordered(members.where("cls <> gid"), "gid", "cls"))
        else:
            first = F.slice(F.sort_array(F.collect_set(F.struct("shared", "to")), asc=False), 1, REMEMBERED)
            few = reduce(DataFrame.union, asked).groupBy("gid").agg(F.transform(first, lambda s: s["to"]).alias("asked")) if asked else posts.select("gid", F.array("gid").alias("asked")).limit(0)
            left = stored(_open_posts(posts, spans, few), "open")
            found = stored(_open_pairs(left, sizes), "met")
            found = stored(_enough(found, groups, sizes), "enough")
            now = members.select("cls", "gid") if comp is None else members.join(comp, F.col("cls") == F.col("node"), "left").select("cls", "gid", F.coalesce("component", "cls").alias("comp"))
            now = now if comp is not None else now.withColumn("comp", F.col("cls"))
            side = lambda s: now.select(F.col("gid").alias(s), F.col("cls").alias(f"cls_{s}"), F.col("comp").alias(f"comp_{s}"))  # noqa: B023, E731
            pairs = _ordered(found.join(side("a"), "a").join(side("b"), "b").where("comp_a <> comp_b"), "cls_a", "cls_b").union(_inner(now))
        pairs = pairs.distinct()
        pairs = stored(pairs.join(reduce(DataFrame.union, tested), ["a", "b"], "left_anti") if tested else pairs, f"pairs{k}")
        tested.append(pairs)
        wanted = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
        wanted = wanted.join(reduce(DataFrame.union, sets).select("id"), "id", "left_anti") if sets else wanted
        wanted = stored(wanted, f"wanted{k}")
        release(spark)
        sets.append(stored(_sets(docs, wanted, members, size), f"sets{k}"))
        release(spark)
        links = stored(_verified(pairs, reduce(DataFrame.union, sets), percent), f"links{k}")
        comp = components(links if comp is None else links.union(comp), f"components{k}-")
        release(spark)
    out = member.join(comp, F.col("cls") == F.col("node"), "left").select("doc_id", F.coalesce("component", "cls").alias("component_id")).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return known.select("doc_id", "n").join(out, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _inner(now: DataFrame) -> DataFrame:
    """(a, b): pairs of classes of one group whose components still differ."""
    several = now.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("gid")
    g = now.join(several, "gid", "left_semi")
    x, y = g.alias("x"), g.alias("y")
    return x.join(y, (F.col("x.gid") == F.col("y.gid")) & (F.col("x.cls") < F.col("y.cls")) & (F.col("x.comp") != F.col("y.comp"))).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each component, with all their columns; rows without a doc_id stay.

    Of rows with the doc_id that stays all do.
    """
    ids = near_documents(docs).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(ids, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
