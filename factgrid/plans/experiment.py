"""Experiments on single claims: cases with their own chunks, classified by a model, written for a judge, scored and logged."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factgrid.functions import jsonl
from factgrid.functions.text import EVIDENCE_CHARS, LABELS
from factgrid.operators import scoring, segmented
from factgrid.plans import predict, prompt
from factgrid.sources import calls, requests
from factgrid.storage import Folder, stored


def _cases(lines: DataFrame) -> DataFrame:
    """(row, id, claim, vote, label, chunks) of parsed lines with `row`: a case's number from 0 stands for an id that isn't given."""
    get = lambda path, of="string": F.try_variant_get("v", path, of)
    return lines.select("row", F.coalesce(get("$.id"), F.col("row").cast("string")).alias("id"), get("$.claim").alias("claim"), get("$.vote").alias("vote"), get("$.label", "int").alias("label"), get("$.chunks", "array<variant>").alias("chunks"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """The cases of JSONL files, in their order."""
    read = requests.lines(spark, path)
    order = [F.col("line_no")]
    placed = segmented.scanned(segmented.dealt(read.select("line_no", "raw"), order), order, {"before": segmented.running_count()})
    return _cases(jsonl.parsed(placed).withColumn("row", F.col("before").cast("long")))


def inline(spark: SparkSession, claim: str, chunks: list[str | dict], vote: str | None = None) -> DataFrame:
    """One case, of a claim and its chunks as they are given."""
    raw = json.dumps({"claim": claim, "chunks": chunks, "vote": vote}, ensure_ascii=False)
    return _cases(jsonl.parsed(spark.createDataFrame([(0, raw)], "row long, raw string")))


def chunks_of(cases: DataFrame) -> DataFrame:
    """(request, chunk, page, paragraph, text): a chunk is a text, or an object with text and perhaps page, and paragraph or else id."""
    each = cases.select(F.col("row").alias("request"), F.posexplode("chunks").alias("chunk", "c"))
    whole = jsonl.kind_of(F.col("c")).startswith("OBJECT")
    get = lambda path, of="string": F.when(whole, F.try_variant_get("c", path, of))
    named = F.array_contains(F.json_object_keys(F.to_json("c")), "paragraph")
    paragraph: Column = F.when(whole, F.when(named, get("$.paragraph")).otherwise(get("$.id")))
    return each.select("request", "chunk", get("$.page", "int").alias("page"), paragraph.alias("paragraph"), F.when(whole, get("$.text")).otherwise(F.try_variant_get("c", "$", "string")).alias("text"))


def classified(cases: DataFrame, connect: Callable[[], calls.Client], model: str, log: str, in_flight: int = calls.IN_FLIGHT) -> DataFrame:
    """cases with label_pred, label_name, evidence, input_tokens, output_tokens, local_ms and error. Equal payloads are one call, and its time is none of a case's own.

    A claim without text or chunks, a call that failed and an answer that can't be read are neutral, with an error; what a call cost counts even if its answer can't be read.
    """
    spark, chunks = cases.sparkSession, chunks_of(cases)
    told = cases.where(F.col("claim").rlike(r"(?U)\S")).select(F.col("row").alias("request"), "claim", "vote")
    asked = stored(calls.called(predict.prompts(told, chunks), log, connect, model, prompt.SYSTEM, in_flight=in_flight), "asked")
    out = predict.predictions(told, chunks, asked.where("error is null").select("request", "answer"))
    own = calls.local_ms(asked.where("worker is not null").select(F.col("request").alias("case"), "worker", "began", "finished"), calls.spans(spark, log).select("worker", "started", "ended"))
    cost = asked.select(F.col("request").alias("row"), "input_tokens", "output_tokens", F.col("error").alias("failed"))
    both = cases.drop("chunks").join(out.withColumnRenamed("request", "row").withColumnRenamed("label", "label_pred"), "row", "left").join(cost, "row", "left").join(own.withColumnRenamed("case", "row"), "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    none = F.array().cast("array<struct<page:int,text:string>>")
    error = F.coalesce("failed", "error", F.when(F.col("label_pred").isNull(), "no claim or no chunks"))
    return both.select("row", "id", "label", F.coalesce("label_pred", F.lit(1)).alias("label_pred"), F.coalesce("label_name", F.lit("neutral")).alias("label_name"), F.coalesce("evidence", none).alias("evidence"), *map(zero, ("input_tokens", "output_tokens", "local_ms")), error.alias("error"))


def write_judged(done: DataFrame, path: str) -> None:
    """A line for each case, in their order, as a judge takes them; ids are strings, and the time is the case's own."""
    evidence = F.transform(F.slice("evidence", 1, 5), lambda e: F.struct(e["page"].alias("page"), F.substring(e["text"], 1, EVIDENCE_CHARS).alias("text")))
    body = F.struct("id", F.col("label_pred").alias("label"), "label_name", evidence.alias("evidence"), F.struct("input_tokens", "output_tokens", F.col("local_ms").alias("inference_time_ms")).alias("metrics"))
    done.orderBy("row").select(F.to_json(body, {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)


def metrics(done: DataFrame) -> dict | None:
    """Scores over all three classes, the confusion matrix and token totals; None unless every case has a gold label. Ten rows come to the driver."""
    cells = {(r["label"], r["pred"]): r["n"] for r in done.groupBy("label", F.col("label_pred").alias("pred")).agg(F.count("*").alias("n")).collect()}
    if not cells or any(gold is None for gold, _ in cells):
        return None
    rows = done.select("label", F.col("label_pred").alias("pred"), F.lit("all").alias("of"))
    scores = scoring.class_scores(rows, "of")
    mean, f1 = scoring.mean_f1(scores, "of").first(), {LABELS[r["label"]]: r["f1"] for r in scores.collect()}
    total = calls.totals(done).first()
    return {"macro_f1": mean["mean_f1"], "f1": f1, "n": sum(cells.values()), "accuracy": mean["accuracy"], "confusion": [[cells.get((a, b), 0) for b in range(3)] for a in range(3)], "input_tokens": total["input_tokens"], "output_tokens": total["output_tokens"]}


def commit_of(folder: str) -> str | None:
    """The short commit of a folder's working tree, with -dirty where tracked files have changed; None where there is none."""
    git = lambda *args: subprocess.run(["git", *args], cwd=folder, check=True, capture_output=True, text=True).stdout.strip()
    try:
        return git("rev-parse", "--short", "HEAD") + ("-dirty" if git("status", "--porcelain", "--untracked-files=no") else "")
    except (OSError, subprocess.CalledProcessError):
        return None


def log_experiment(folder: str, name: str, figures: dict, note: str = "", commit: str | None = None, **more: object) -> dict:
    """Puts a record of the experiment into the folder, a file of its own, whose names sort by time."""
    now = datetime.now(timezone.utc)
    record = {"time": now.isoformat(timespec="seconds"), "name": name, "commit": commit, "prompt_version": prompt.VERSION, "metrics": figures, "note": note, **more}
    Folder(folder).write(f"{now:%Y%m%dT%H%M%S.%f}.json", (json.dumps(record, ensure_ascii=False) + "\n").encode())
    return record
