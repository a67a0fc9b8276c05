"""A prediction run: requests in, predictions under the contract out, whole or not at all."""

from __future__ import annotations

import os
import posixpath
import re
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgrid.functions.text import EVIDENCE_CHARS
from factgrid.operators import retrieval
from factgrid.plans import predict, prompt
from factgrid.sources import calls, predictions, requests
from factgrid.storage import stored

EVIDENCE = "array<struct<page:int,text:string>>"
#: What a predictor returns for each request, by line_no; a row that is missing or has a null label is neutral.
ANSWER = ("line_no", "label", "label_name", "evidence", "input_tokens", "output_tokens", "inference_time_ms", "error")


class Predictor(Protocol):
    def predict(self, requests: DataFrame) -> DataFrame:
        """A row per request with the columns of ANSWER. A case that fails has an error and a null label; only faults of the whole run are raised."""
        ...


class Neutral:
    """Every request is neutral, without evidence or cost."""

    def predict(self, requests: DataFrame) -> DataFrame:
        none = F.array().cast(EVIDENCE)
        return requests.select("line_no", F.lit(1).alias("label"), F.lit("neutral").alias("label_name"), none.alias("evidence"), *[F.lit(0).cast("long").alias(c) for c in ANSWER[4:7]], F.lit(None).cast("string").alias("error"))


class FromAnswers:
    """Predictions from a model's stored answers, answers(line_no, answer, input_tokens, output_tokens, api_time_ms), one for each call made.

    pages(path, page, text) are those of the booklets and vectors(path, page, vec) and claims(line_no, vec) their embeddings; without embeddings
    every page of a booklet is a chunk.
    """

    def __init__(self, answers: DataFrame, pages: DataFrame, vectors: DataFrame | None = None, claims: DataFrame | None = None, k: int = retrieval.TOP_K):
        self.answers, self.pages, self.vectors, self.claims, self.k = answers, pages, vectors, claims, k

    def chunks(self, requests: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        return retrieval.chunks(requests, self.pages, self.vectors, self.claims, self.k)

    def predict(self, requests: DataFrame) -> DataFrame:
        chunks, retrieved = self.chunks(requests)
        asked = requests.select(F.col("line_no").alias("request"), "claim").join(chunks.select("request").distinct(), "request", "left_semi")  # a claim without chunks is a failed case
        out = predict.predictions(asked, chunks, self.answers.select(F.col("line_no").alias("request"), "answer"), retrieved)
        cost = self.answers.select("line_no", "input_tokens", "output_tokens", F.col("api_time_ms").alias("inference_time_ms"))
        return out.withColumnRenamed("request", "line_no").join(cost, "line_no", "left").select(*ANSWER)


class FromModel:
    """Predictions from a model's answers to prompts of the requests' chunks, each payload asked once and kept in the folder `log`.

    connect makes a client in a task (calls.Client). A call that fails makes its requests neutral, without cost.
    """

    def __init__(self, pages: DataFrame, connect: Callable[[], calls.Client], model: str, log: str, vectors: DataFrame | None = None, claims: DataFrame | None = None, k: int = retrieval.TOP_K, in_flight: int = calls.IN_FLIGHT):
        self.pages, self.connect, self.model, self.log, self.vectors, self.claims, self.k, self.in_flight = pages, connect, model, log, vectors, claims, k, in_flight

    def asked(self, requests: DataFrame) -> DataFrame:
        """A row per request that has chunks: request, key and the columns of calls.ANSWER."""
        chunks, _ = retrieval.chunks(requests, self.pages, self.vectors, self.claims, self.k)
        told = requests.select(F.col("line_no").alias("request"), "claim", F.col("vote_title").alias("vote"))
        return calls.called(predict.prompts(told, chunks), self.log, self.connect, self.model, prompt.SYSTEM, in_flight=self.in_flight)

    def predict(self, requests: DataFrame) -> DataFrame:
        got = stored(self.asked(requests), "asked").withColumnRenamed("request", "line_no")
        good = got.where("error is null").select("line_no", "answer", "input_tokens", "output_tokens", "api_time_ms")
        out = FromAnswers(good, self.pages, self.vectors, self.claims, self.k).predict(requests)
        failed = got.where("error is not null").select("line_no", F.col("error").alias("failure"))
        return out.join(failed, "line_no", "left").withColumn("error", F.coalesce("failure", "error")).select(*ANSWER)


def judged(asked: DataFrame, answered: DataFrame) -> DataFrame:
    """(line_no, id, id_kind, task, raw, note): each request's prediction as JSON; failed cases are neutral and cost nothing."""
    failed = F.col("label").isNull()
    whole = lambda c: F.coalesce(F.when(~failed, F.col(c)), F.lit(0)).cast("long").alias(c)
    evidence = F.transform(F.coalesce(F.when(~failed, F.col("evidence")), F.array().cast(EVIDENCE)), lambda e: F.struct(e["page"].alias("page"), F.substring(e["text"], 1, EVIDENCE_CHARS).alias("text")))
    metrics = F.struct(whole("input_tokens"), whole("output_tokens"), F.bround(F.coalesce(F.when(~failed, F.col("inference_time_ms")), F.lit(0))).cast("long").alias("inference_time_ms"))
    both = asked.join(answered, "line_no", "left")
    body = F.struct(F.coalesce("label", F.lit(1)).alias("label"), F.coalesce("label_name", F.lit("neutral")).alias("label_name"), evidence.alias("evidence"), metrics.alias("metrics"))
    note = F.coalesce("error", F.when(failed, "no prediction"))
    raw = F.concat(F.lit('{"id":'), "id_json", F.lit(","), F.substring(F.to_json(body, {"ignoreNullFields": "false"}), 2, 2**31 - 1))  # an id of any length stays as it is
    return both.select("line_no", "id", "id_kind", "task", raw.alias("raw"), note.alias("note"))


def place(path: str) -> str:
    """A path or URI with its links, dots and relative beginning resolved."""
    local = re.sub("^file:/+", "/", path)
    return posixpath.normpath(path) if re.match("[A-Za-z][A-Za-z0-9+.-]+:", local) else os.path.realpath(local)


def run(spark: SparkSession, source: str | list[str], target: str, predictor: Predictor, resolve: bool = False) -> int:
    """Reads requests from one or more files, writes a line for each to the folder `target` in their order; returns how many.

    All requests are checked before any is predicted and all predictions before any is written, so a fault leaves no output.
    """
    if place(target) in map(place, [source] if isinstance(source, str) else source):
        raise ValueError("the output must not be the input")
    asked = requests.read_requests(spark, source, resolve)
    out = stored(predictions.checked(judged(asked, predictor.predict(asked))), "predictions")
    bad, n = out.agg(F.min(F.when(F.col("error").isNotNull(), F.struct("line_no", "error"))), F.count("*")).first()
    if bad:
        raise ValueError(f"prediction of line {bad['line_no']}: {bad['error']}")
    predictions.write_raw(out, target)
    return n
