"""Predictions: the contract that each keeps, and the sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgrid.functions import jsonl
from factgrid.functions.text import EVIDENCE_CHARS, LABELS

# fixed value: the most items of evidence
MOST_EVIDENCE = 5


def checked(rows: DataFrame) -> DataFrame:
    """rows(id, id_kind, task, raw) with `error`, the first rule that the prediction in raw breaks, or null.

    Kinds count: 7 isn't "7", true isn't a number, a page key may be null but not missing.
    """
    v = jsonl.parsed(rows).withColumnRenamed("v", "_v")
    id_kind, ident = jsonl.ident(F.col("line"), F.col("_v"))
    v = v.withColumns({"_kind": id_kind, "_id": ident})
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get("_v", path, "variant")), F.lit("VOID"))
    get = lambda path, of: F.try_variant_get("_v", path, of)
    label = get("$.label", "int")
    name = F.element_at(F.array(*map(F.lit, LABELS)), label + 1)
    items = F.try_variant_get("_v", "$.evidence", "array<variant>")
    any_item = lambda test: F.coalesce(F.exists(items, lambda x: F.coalesce(test(x), F.lit(True))), F.lit(False))
    tokens = lambda key: (kind(f"$.metrics.{key}") == "BIGINT") & (get(f"$.metrics.{key}", "long") >= 0)
    time = kind("$.metrics.inference_time_ms")
    bad = F.coalesce(
        F.when(F.col("_v").isNull() | ~F.schema_of_variant("_v").startswith("OBJECT"), "not an object"),
        F.when((F.col("_kind") != F.col("id_kind")) | ~F.col("_id").eqNullSafe(F.col("id")), "id"),
        F.when((kind("$.label") != "BIGINT") | ~F.coalesce(label.between(0, 2), F.lit(False)), "label"),
        F.when(~get("$.label_name", "string").eqNullSafe(name), "label_name"),
        F.when(~kind("$.evidence").startswith("ARRAY") | (F.size(items) > MOST_EVIDENCE), "evidence"),
        F.when((F.col("task") == "A") & (label != 1) & (F.size(items) == 0), "evidence is missing"),
        F.when(any_item(lambda x: ~_page_good(x)), "evidence.page"), F.when(any_item(lambda x: ~_text_good(x)), "evidence.text"),
        *[F.when(~tokens(k), f"metrics.{k}") for k in ("input_tokens", "output_tokens")],
        F.when(~(time.isin("BIGINT", "DOUBLE", "FLOAT") | time.startswith("DECIMAL")) | ~F.coalesce(get("$.metrics.inference_time_ms", "double") >= 0, F.lit(False)), "metrics.inference_time_ms"),
    )
    return v.withColumn("error", bad).drop("_v", "line", "_kind", "_id")


def _page_good(item: Column) -> Column:
    page = F.try_variant_get(item, "$.page", "variant")
    there = F.coalesce(F.array_contains(F.json_object_keys(F.to_json(item)), "page"), F.lit(False))
    number = (F.schema_of_variant(page) == "BIGINT") & (F.try_variant_get(item, "$.page", "long") >= 1)
    empty = F.coalesce(F.schema_of_variant(page), F.lit("VOID")) == "VOID"
    return there & F.when(F.col("task") == "A", F.coalesce(number, F.lit(False))).otherwise(empty)


def _text_good(item: Column) -> Column:
    body = F.try_variant_get(item, "$.text", "string")
    is_text = F.schema_of_variant(F.try_variant_get(item, "$.text", "variant")) == "STRING"
    return F.coalesce(is_text & body.rlike(r"(?U)\S") & (F.length(body) <= EVIDENCE_CHARS), F.lit(False))


def write_lines(df: DataFrame, path: str, by: str = "line_no") -> None:
    """A JSON line per row in the order of `by`, null fields kept; the part files follow each other in that order."""
    body = [c for c in df.columns if c != by]
    df.orderBy(by).select(F.to_json(F.struct(*body), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)


def write_raw(df: DataFrame, path: str, by: str = "line_no") -> None:
    """Lines that are JSON already, in the order of `by`."""
    df.orderBy(by).select(F.col("raw").alias("value")).write.mode("errorifexists").text(path)


def log_run(report: DataFrame, path: str, name: str, commit: str | None = None, note: str = "") -> None:
    """Adds the report's rows to a log of experiments, with the time, a name and the commit."""
    report.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("time"), F.lit(name).alias("name"), F.lit(commit).cast("string").alias("commit"), F.lit(note).alias("note"), F.struct("*").alias("metrics")).write.mode("append").json(path)


def reusable(wanted: DataFrame, manifest: DataFrame, files: DataFrame) -> DataFrame:
    """wanted(url) with `reuse`: whether a stored file is a PDF and still what the manifest says; manifest(url, path, sha256), files(path, content)."""
    head = F.position(F.lit(b"%PDF-"), F.substring("content", 1, 1024)) > 0
    held = files.select("path", F.sha2("content", 256).alias("now"), head.alias("pdf"))
    good = manifest.join(held, "path").where("pdf and now = sha256").select("url").distinct().withColumn("reuse", F.lit(True))
    return wanted.join(good, "url", "left").withColumn("reuse", F.coalesce("reuse", F.lit(False)))
