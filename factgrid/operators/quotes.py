"""Quotes joined with the chunks they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factgrid.functions import text
from factgrid.functions.fuzzy import alignment, alignment_from

MIN_SCORE = 90.0
_WORD = r"[\p{L}\p{N}]"


def widened(whole: Column, start: Column, end: Column) -> Column:
    """whole[start:end], with the words that its borders cut made whole."""
    head, inner, tail = F.substring(whole, F.lit(1), start), F.substring(whole, start + 1, end - start), F.substring(whole, end + 1, F.length(whole))
    before = F.when(inner.rlike(f"^{_WORD}"), F.regexp_extract(head, f"({_WORD}*)$", 1)).otherwise("")
    after = F.when(inner.rlike(f"{_WORD}$"), F.regexp_extract(tail, f"^({_WORD}*)", 1)).otherwise("")
    return F.concat(before, inner, after)


def first_hits(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """(request, place, chunk, page, quote): where each quote was found, as the chunk has it.

    citations(request, place, chunk, quote), chunks(request, chunk, page, text). The chunk that is cited comes first, then the others
    in order; the first with a stretch at least MIN_SCORE like the quote wins. Quotes that are too short have no place. Only quotes that
    the cited chunk doesn't hold meet a request's other chunks, and of those none behind the first that holds the quote word by word.
    """
    asked = citations.select("request", "place", F.col("chunk").alias("cited"), F.col("quote").alias("wanted")).where(F.length(text.strip(F.col("wanted"))) >= text.MIN_QUOTE_CHARS)
    held = chunks.select("request", "chunk", "page", "text")
    cited = asked.join(held.withColumnRenamed("request", "_of"), (F.col("request") == F.col("_of")) & (F.col("cited") == F.col("chunk"))).drop("_of")
    probed = cited.withColumn("hit", alignment_from(MIN_SCORE)("wanted", "text")).where(F.col("hit.score") >= MIN_SCORE)
    both = asked.join(probed.select("request", "place"), ["request", "place"], "left_anti").join(held, "request").where(~F.col("chunk").eqNullSafe(F.col("cited")))
    each = Window.partitionBy("request", "place")
    exact = F.min(F.when(F.contains("text", "wanted"), F.col("chunk"))).over(each)
    near = both.withColumn("exact", exact).where("exact is null or chunk <= exact").drop("exact").withColumn("hit", alignment_from(MIN_SCORE)("wanted", "text")).where(F.col("hit.score") >= MIN_SCORE)
    first = probed.unionByName(near).withColumn("n", F.row_number().over(each.orderBy("chunk"))).where("n = 1")
    return first.select("request", "place", "chunk", "page", widened(F.col("text"), F.col("hit.start"), F.col("hit.end")).alias("quote"))


def best_chunks(texts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(request, chunk, page, text): the chunk most like any of a request's texts, the lowest of equals; without texts the first."""
    asked = texts.where(F.length(text.strip(F.col("text"))) >= text.MIN_QUOTE_CHARS).select("request", F.col("text").alias("wanted")).distinct()
    held = chunks.select("request", "chunk", "page", "text")
    whole = F.contains("text", "wanted") | ((F.length("text") > 0) & F.contains("wanted", "text"))
    first = held.join(asked, "request").where(whole).groupBy("request").agg(F.min("chunk").alias("first"))  # nothing is more like a text than what holds it
    exact = held.join(first, "request").where(F.col("chunk") == F.col("first")).drop("first")
    rest = held.join(first, "request", "left_anti").join(asked, "request", "left").withColumn("score", alignment("wanted", "text")["score"])
    each = Window.partitionBy("request").orderBy(F.desc("score"), "chunk")
    near = rest.withColumn("n", F.row_number().over(each)).where("n = 1").select(*held.columns)
    return exact.dropDuplicates(["request"]).unionByName(near)


def evidence_hits(gold: DataFrame, quotes: DataFrame, min_score: float = MIN_SCORE, max_chars: int = text.EVIDENCE_CHARS) -> DataFrame:
    """(id, hit): whether one of a case's quotes, those longer than max_chars aside, is at least min_score like its gold passage, gold(id, passage), quotes(id, quote)."""
    asked = gold.select("id", text.normalized(F.col("passage")).alias("p")).join(quotes.select("id", text.normalized(F.col("quote")).alias("q")), "id", "left")
    good = (F.length("q") > 0) & (F.length("q") <= max_chars) & (F.length("p") > 0) & (alignment_from(min_score)("q", "p")["score"] >= min_score)
    return asked.withColumn("good", good).groupBy("id").agg(F.coalesce(F.bool_or("good"), F.lit(False)).alias("hit"))
