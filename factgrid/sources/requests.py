"""Requests: JSONL under a strict contract, checked as a whole table before anything else runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factgrid.functions import jsonl
from factgrid.functions.text import LANGUAGES, resolved, vote_title
from factgrid.operators import segmented


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, file_line, line_no, raw, utf8) of the non-blank lines of one or more files.

    file_line counts a file's lines, blank ones too; line_no goes on from file to file, in the order of their paths, so it tells all lines apart.
    Files are read in splits, however large. A line's number is its place in the split behind the lines of the splits before.
    """
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw"))
    order = [F.col("path"), F.col("block")]
    sizes = segmented.dealt(read.groupBy("path", "block").agg(F.count("*").alias("n")), order)
    sizes = segmented.scanned(sizes, order, {"before": segmented.running_sum(F.col("n"))})
    sizes = sizes.select("path", "block", "before", (F.col("before") - F.min("before").over(Window.partitionBy("path"))).alias("in_file"))
    own = F.row_number().over(Window.partitionBy("path", "block").orderBy("at"))
    each = read.withColumn("own", own).join(sizes, ["path", "block"])
    utf8 = F.is_valid_utf8("raw")
    return each.where(F.col("raw").rlike(r"(?U)\S") | ~utf8).select("path", (F.col("in_file") + F.col("own")).alias("file_line"), (F.col("before") + F.col("own")).alias("line_no"), "raw", utf8.alias("utf8"))


def ruled(rows: DataFrame) -> DataFrame:
    """(line_no, raw) -> the request's columns and `error`, the first rule that the line breaks by itself, or null.

    Numbers and strings stay distinct: 7 and "7" are different ids. A key may be present and null, and of a repeated key the last one counts. Extra keys are
    ignored. id_json is the id as it is written in JSON, vote_title the vote's name for a model.
    """
    v = jsonl.parsed(rows).withColumn("keys", F.json_object_keys("line"))
    id_kind, ident = jsonl.ident(F.col("line"), F.col("v"))
    v = v.withColumns({"id_kind": id_kind, "id": ident})
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get("v", path, "variant")), F.lit("VOID"))
    text = lambda path: F.try_variant_get("v", path, "string")
    has = lambda key: F.coalesce(F.array_contains("keys", key), F.lit(False))
    filled = lambda path: (kind(path) == "STRING") & text(path).rlike(r"(?U)\S")
    spoken = lambda path: (kind(path) == "STRING") & text(path).isin(*LANGUAGES)
    bad = F.coalesce(
        F.when(F.col("v").isNull(), "not JSON"), F.when(~F.schema_of_variant("v").startswith("OBJECT"), "not an object"),
        *[F.when(~has(k), f"{k} is missing") for k in ("id", "vote", "claim")],
        F.when(~(filled("$.id") | (F.col("id_kind") == "BIGINT")), "id must be a non-empty string or an integer"),
        F.when(has("booklet") == has("reference"), "exactly one of booklet and reference"),
        F.when(~kind("$.claim").startswith("OBJECT") | ~filled("$.claim.text"), "claim.text"), F.when(~spoken("$.claim.language"), "claim.language"),
        F.when(has("booklet"), F.when(~filled("$.booklet.path") | F.contains(text("$.booklet.path"), F.lit("\0")), "booklet.path").when(~spoken("$.booklet.language"), "booklet.language")),
        F.when(has("reference"), F.when(~filled("$.reference.text"), "reference.text").when(~spoken("$.reference.language"), "reference.language")),
    )
    vote = F.try_variant_get("v", "$.vote", "variant")
    nameless = kind("$.vote").startswith("OBJECT") & (F.coalesce(text("$.vote.title"), F.lit("")) == "") & (F.coalesce(text("$.vote.name"), F.lit("")) == "")
    title = F.when(nameless, jsonl.dumped_vote(F.col("line"), nameless)).otherwise(vote_title(vote))
    return v.select(
        "line_no", *[c for c in ("path", "file_line") if c in rows.columns], "id_kind", "id", F.when(F.col("id_kind") == "STRING", F.to_json(F.try_variant_get("v", "$.id", "variant"))).otherwise(F.col("id")).alias("id_json"),
        F.try_variant_get("v", "$.vote", "variant").alias("vote"), title.alias("vote_title"), text("$.claim.text").alias("claim"), text("$.claim.language").alias("claim_lang"),
        F.when(has("booklet"), "A").otherwise("B").alias("task"), F.coalesce(text("$.booklet.language"), text("$.reference.language")).alias("source_lang"),
        text("$.booklet.path").alias("booklet_path"), text("$.reference.text").alias("reference_text"), bad.alias("error"),
    )


def checked(rows: DataFrame) -> DataFrame:
    """ruled(rows), with an error also where an earlier line has the same id."""
    ids = Window.partitionBy("id_kind", "id").orderBy("line_no")
    return ruled(rows).withColumn("error", F.coalesce("error", F.when(F.row_number().over(ids) > 1, "duplicate id")))


def read_requests(spark: SparkSession, path: str | list[str], resolve: bool = False) -> DataFrame:
    """The requests of one or more files; fails with the earliest line's error, and on empty files.

    resolve: booklet_path becomes absolute, relative ones being in the folder of their own file.
    """
    read = lines(spark, path)
    rows = checked(read)
    at = lambda c, *more: F.min(F.when(c, F.struct("line_no", "path", "file_line", *more)))
    broken, first, n = read.agg(at(~F.col("utf8"))).crossJoin(rows.agg(at(F.col("error").isNotNull(), "error"), F.count("*"))).first()  # a row each
    if broken or first:
        line = broken or first
        raise ValueError(f"{line['path']}, line {line['file_line']}: {'not UTF-8' if broken else line['error']}")
    if not n:
        raise ValueError(f"{path}: no requests")
    if resolve:
        folder = F.regexp_replace(F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), "^file:/+", "/"), "/[^/]*$", "")
        rows = rows.withColumn("booklet_path", resolved(folder, F.col("booklet_path")))
    return rows.drop("error", "path", "file_line")
