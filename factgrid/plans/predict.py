"""The whole plan: requests, chunks and a model's stored answers give predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgrid.functions import text
from factgrid.operators import answers, quotes, retrieval


def prompts(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """(request, payload): the JSON a model gets; requests(request, claim, vote), chunks(request, chunk, page, paragraph, text)."""
    each = F.struct("chunk", "page", "paragraph", "text")
    listed = chunks.groupBy("request").agg(F.array_sort(F.collect_list(each)).alias("chunks"))
    return requests.join(listed, "request").select("request", F.to_json(F.struct("vote", "claim", "chunks"), {"ignoreNullFields": "false"}).alias("payload"))


def predictions(requests: DataFrame, chunks: DataFrame, answered: DataFrame, retrieved: DataFrame | None = None) -> DataFrame:
    """(request, label, label_name, evidence, error): one row per request, requests(request, claim), answered(request, answer).

    Requests without an answer, or with one that can't be read, are neutral. Quotes that were found are the evidence; without any, a label
    other than neutral has the chunk most like the answer's passage. retrieved(request, page, rank, text) fills up to five, but not for neutral.
    """
    read = answers.parsed(requests.select("request").join(answered.select("request", "answer"), "request"))
    cited = read.select("request", F.posexplode("citations").alias("place", "c")).select("request", "place", "c.chunk", "c.quote")
    hits = quotes.first_hits(cited, chunks)
    lost = read.where("label <> 'NEUTRAL'").join(hits.select("request").distinct(), "request", "left_anti")
    words = lost.select("request", F.explode(F.concat(F.transform("citations", lambda c: c["quote"]), F.array("passage_says"))).alias("text"))
    best = quotes.best_chunks(words, chunks.join(lost.select("request"), "request", "left_semi"))
    kinds = lambda df, place, body, missed: df.select("request", "page", F.substring(body, 1, text.EVIDENCE_CHARS).alias("text"), place.alias("place"), F.lit(missed).alias("missed"))
    own = kinds(hits, F.col("place"), "quote", False).unionByName(kinds(best, F.lit(0), "text", True))
    if retrieved is None:
        rest = own.select("request", "page", "text", F.lit(0).alias("rank")).limit(0)
    else:
        rest = retrieved.join(read.where("label <> 'NEUTRAL'").select("request"), "request", "left_semi").select("request", "page", F.substring("text", 1, text.EVIDENCE_CHARS).alias("text"), "rank")
    shown = retrieval.first_evidence(own, rest).groupBy("request").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "page", "text"))), lambda e: F.struct(e["page"], e["text"])).alias("evidence"))
    missed = best.select("request", F.lit("no quote was found").alias("missed"))
    out = requests.select("request").join(read, "request", "left").join(shown, "request", "left").join(missed, "request", "left")
    name = F.lower(F.coalesce("label", F.lit("NEUTRAL")))
    number = F.array_position(F.array(*map(F.lit, text.LABELS)), name).cast("int") - 1
    none = F.array().cast("array<struct<page:int,text:string>>")
    error = F.coalesce("parse_error", "missed", F.when(F.col("label").isNull(), "no answer"))
    return out.select("request", number.alias("label"), name.alias("label_name"), F.coalesce("evidence", none).alias("evidence"), error.alias("error"))
