"""Retrieval: the pages of a claim's own booklet that are most like it."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from factgrid.functions.text import passage, query, unit
from factgrid.storage import Folder, stored

# fixed value: pages that a claim is compared with
TOP_K = 5
#: Pages of a booklet, or claims of it, that a task holds at a time.
BLOCK = 2_000


def _best_of(k: int, out: pa.Schema):
    """For blocks of claims and pages of one booklet: each claim's k best pages of the block."""

    def best(claims: pa.Table, pages: pa.Table) -> pa.Table:
        if not claims.num_rows or not pages.num_rows:
            return out.empty_table()
        order = pages.column("page").to_pylist()
        pages = pages.take(sorted(range(len(order)), key=lambda i: (order[i] is not None, order[i])))  # so that of equal scores the first page comes first
        pages = pages.slice(0, k) if pages.column("size")[0].as_py() <= k else pages
        if pages.column("size")[0].as_py() <= k:
            row, col = np.indices((claims.num_rows, pages.num_rows)).reshape(2, -1)
            score = pa.nulls(len(row), pa.float64())
        else:
            vectors = [t.column("vec").to_pylist() for t in (claims, pages)]
            width = max((len(v) for side in vectors for v in side if v is not None), default=0)
            c, p = (_matrix(side, width) for side in vectors)
            product = np.einsum("ij,kj->ik", c, p)  # the same sum for equal vectors, wherever they stand, which blocked products don't promise
            product = np.where(np.isnan(product), -np.inf, product)
            col = np.argsort(-product, axis=1, kind="stable")[:, :k]
            row = np.repeat(np.arange(len(c)), col.shape[1])
            col = col.ravel()
            found = product[row, col]
            score = pa.array(found, mask=np.isneginf(found))
        return pa.Table.from_arrays([claims.column("request").take(pa.array(row)).combine_chunks(), pages.column("page").take(pa.array(col)).combine_chunks(), score], schema=out)

    return best


def _matrix(rows: list, width: int) -> np.ndarray:
    """Vectors as rows; null ones, those of another length, and null components are NaN."""
    return np.array([[np.nan] * width if r is None or len(r) != width else [np.nan if x is None else x for x in r] for r in rows], np.float64).reshape(len(rows), width)


def top_pages(claims: DataFrame, pages: DataFrame, k: int = TOP_K, block: int = BLOCK) -> DataFrame:
    """(request, page, rank, score): claims(request, path, vec), pages(path, page, vec); a booklet of k pages or fewer comes whole, in page order, without scores.

    A booklet's pages and its claims are dealt into blocks, however many it has; a task multiplies a block of one with a block of the other and keeps
    each claim's k best pages, so k rows a claim and block are shuffled, not a row for each pair. Pages without a vector come last.
    """
    blocks = lambda df: df.groupBy("path").agg(F.count("*").alias("size")).select("path", "size", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    of_pages, of_claims = blocks(pages), blocks(claims)
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    deal = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    page_side = pages.join(of_pages, "path").join(of_claims.select("path", F.col("blocks").alias("others")), "path")
    page_side = page_side.select("path", deal("page", F.col("blocks")).alias("pb"), spread(F.col("others")).alias("cb"), "page", "size", F.col("vec").cast("array<double>").alias("vec"))
    claim_side = claims.join(of_claims.select("path", "blocks"), "path").join(of_pages.select("path", F.col("blocks").alias("others")), "path")
    claim_side = claim_side.select(F.col("path").alias("of"), spread(F.col("others")).alias("pb"), deal("request", F.col("blocks")).alias("cb"), "request", F.col("vec").cast("array<double>").alias("vec"))
    kinds = claims.select("request").schema[0].dataType, pages.select("page").schema[0].dataType
    out = pa.schema([("request", to_arrow_type(kinds[0])), ("page", to_arrow_type(kinds[1])), ("score", pa.float64())])
    best = claim_side.groupBy("of", "pb", "cb").cogroup(page_side.groupBy("path", "pb", "cb")).applyInArrow(_best_of(k, out), f"request {kinds[0].simpleString()}, page {kinds[1].simpleString()}, score double")
    rank = F.row_number().over(Window.partitionBy("request").orderBy(F.desc("score"), "page"))  # k rows a block
    return best.select("request", "page", "score", rank.alias("rank")).where(F.col("rank") <= k)


def first_evidence(quotes: DataFrame, retrieved: DataFrame, most: int = 5) -> DataFrame:
    """(request, page, text, place): quotes in order, then retrieved pages that aren't quoted word by word, best first; `most` in all."""
    rest = retrieved.join(quotes.select("request", "page", "text"), ["request", "page", "text"], "left_anti")
    both = quotes.select("request", "page", "text", F.lit(0).alias("kind"), F.col("place").alias("at")).unionByName(rest.select("request", "page", "text", F.lit(1).alias("kind"), F.col("rank").alias("at")))
    place = F.row_number().over(Window.partitionBy("request").orderBy("kind", "at"))
    return both.select("request", "page", "text", place.alias("place")).where(F.col("place") <= most)


def hashed_ngrams(size: int = 256, n: int = 3) -> Callable[[list[str]], np.ndarray]:
    """An embedder without a model: counts of character n-grams by hash. It stands in where no model can be loaded."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), np.float32)
        for row, t in zip(out, texts):
            low = t.lower()
            np.add.at(row, [zlib.crc32(low[i : i + n].encode()) % size for i in range(len(low) - n + 1)], 1)
        return out

    return embed


def embedded(texts: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], column: str = "text", batch: int = 4) -> DataFrame:
    """texts with `vec`, of length 1: each distinct text is embedded once. load makes the embedder, once in each Python worker's task."""

    @F.pandas_udf("array<float>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = load()
        for part in parts:
            own = part.tolist()
            yield pd.Series([v for at in range(0, len(own), batch) for v in embed(own[at : at + batch])], dtype=object)

    once = texts.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_v", vectors(column))
    return texts.join(once.withColumn("vec", unit(F.col("_v"))).drop("_v"), column, "left")


def page_vectors(pages: DataFrame, load, batch: int = 4) -> DataFrame:
    """(path, page, vec): the index of all booklets, one row a page."""
    return embedded(pages.select("path", "page", passage(F.col("text")).alias("text")), load, "text", batch).select("path", "page", "vec")


def stored_index(pages: DataFrame, folder: str, load, model: str, batch: int = 4, built: int = 0) -> DataFrame:
    """(path, page, vec, built) of pages(path, page, text) from an index kept below folder; only booklets that are new or have changed are embedded.

    A booklet is known by a digest of all its pages' numbers and texts and of the model's name, which is kept beside its vectors; a changed one replaces
    its own part of the index alone, by dynamic partition overwrite, so a job that fails leaves each booklet as it was or as it is to be. built marks the rows of this build.
    Booklets that aren't asked for stay in the index. Without a path there is no booklet: such pages are left out.
    """
    spark = pages.sparkSession
    pages = pages.where("path is not null")
    one = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "page", "text"))
    print_of = F.sha2(F.concat_ws(":", F.lit(model), F.count("*"), one(1), one(2), F.sum(F.xxhash64(F.lit(3), "page", "text").cast("decimal(38,0)"))), 256)
    now = stored(pages.groupBy("path").agg(print_of.alias("content")), "contents")
    schema = "path string, page int, vec array<float>, content string, built int, booklet string"
    read = lambda: spark.read.schema(schema).parquet(folder)
    there = bool(Folder(folder).names(any_kind=True))
    todo = now.join(read().select("path", "content").distinct(), ["path", "content"], "left_anti") if there else now
    fresh = page_vectors(pages.join(todo, "path", "left_semi"), load, batch).join(todo, "path")
    rows = fresh.select("path", F.col("page").cast("int").alias("page"), F.col("vec").cast("array<float>").alias("vec"), "content", F.lit(built).alias("built"), F.sha1("path").alias("booklet"))
    rows.repartition("booklet").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("booklet").parquet(folder)
    return read().join(now, ["path", "content"], "left_semi").select("path", "page", "vec", "built")


def claim_vectors(requests: DataFrame, load, batch: int = 4) -> DataFrame:
    """(line_no, vec) of requests(line_no, claim, vote), vote being its title; equal queries are embedded once."""
    return embedded(requests.select("line_no", query(F.col("claim"), F.col("vote")).alias("text")), load, "text", batch).select("line_no", "vec")


def chunks(requests: DataFrame, pages: DataFrame, vectors: DataFrame | None = None, claims: DataFrame | None = None, k: int = TOP_K) -> tuple[DataFrame, DataFrame | None]:
    """(request, chunk, page, paragraph, text), numbered from 0 in reading order, and the retrieved pages (request, page, rank, text) if any.

    A request with a passage has that one chunk, without a page. One with a booklet has its k pages most like the claim, or, without vectors, all.
    """
    b = requests.where("task = 'B'").select(F.col("line_no").alias("request"), F.lit(0).alias("chunk"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("paragraph"), F.col("reference_text").alias("text"))
    a = requests.where("task = 'A'").select(F.col("line_no").alias("request"), F.col("booklet_path").alias("path"))
    own, retrieved = a.join(pages, "path").select("request", "page", "text"), None
    if vectors is not None and claims is not None:
        asked = a.join(claims.select(F.col("line_no").alias("request"), "vec"), "request")
        best = top_pages(asked, vectors, k).select("request", "page", "rank")
        own = retrieved = own.join(best, ["request", "page"])
    number = F.row_number().over(Window.partitionBy("request").orderBy("page")) - 1
    listed = own.select("request", number.alias("chunk"), "page", F.lit(None).cast("string").alias("paragraph"), "text")
    return listed.unionByName(b), retrieved
