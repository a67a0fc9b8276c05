"""The crawl's manifest: which files to fetch, where each URL was named, and what became of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgrid.functions.text import booklet_file, strip


def url_error(url: Column, truncated: Column | None = None) -> Column:
    """Why a cell holds no URL to fetch, or null."""
    cut = F.coalesce(truncated, F.lit(False)) if truncated is not None else F.lit(False)
    return F.when(cut, "truncated").when(~F.coalesce(url.rlike(r"(?U)\S"), F.lit(False)), "missing").when(~strip(url).rlike(r"^(?i)https?://([^/?#@]*@)?[^/?#:@]+"), "not an http URL")


def references(rows: DataFrame, url: str = "booklet_url", language: str = "reference_language") -> DataFrame:
    """(reference, url, language, error) of a paged dataset's rows (sources.paged): reference is config, split and row_index; error says why a row holds no URL to fetch."""
    v = rows.withColumn("_v", F.try_parse_json("row"))
    text = lambda key: F.when(F.schema_of_variant(F.try_variant_get("_v", f"$.{key}", "variant")) == "STRING", F.try_variant_get("_v", f"$.{key}", "string"))
    cut = F.coalesce(F.array_contains("truncated_cells", url), F.lit(False))
    return v.select(F.struct("config", "split", F.col("row_idx").alias("row_index")).alias("reference"), text(url).alias("url"), F.nullif(text(language), F.lit("")).alias("language"), url_error(text(url), cut).alias("error"))


def whole(found: DataFrame) -> DataFrame:
    """references() without error; a job over it fails at a row that has one, since a scan that lacks rows isn't one."""
    at = F.concat_ws("/", "reference.config", "reference.split", F.col("reference.row_index").cast("string"))
    good = F.when(F.col("error").isNull(), True).otherwise(F.raise_error(F.concat(F.lit("row "), at, F.lit(": "), F.col("error"), F.lit(" URL"))).cast("boolean"))
    return found.where(good).drop("error")


def manifest(rows: DataFrame) -> DataFrame:
    """(url, path, languages, references) of rows(reference, url, language): a file for each URL, its languages in order, and all places that name it."""
    named = rows.where(url_error(F.col("url")).isNull()).withColumn("url", strip(F.col("url")))
    by = named.groupBy("url").agg(F.sort_array(F.collect_set("language")).alias("languages"), F.sort_array(F.collect_list("reference")).alias("references"))
    return by.select("url", F.concat(F.lit("pdf/"), booklet_file(F.col("url"))).alias("path"), "languages", "references")


def statuses(wanted: DataFrame, reuse: DataFrame, fetched: DataFrame) -> DataFrame:
    """wanted(url, ..) with status, bytes, sha256 and error: cached, downloaded, error or pending; reuse(url, reuse), fetched(url, content, error).

    What was fetched counts only with a PDF's head in its first 1024 bytes.
    """
    head = F.position(F.lit(b"%PDF-"), F.substring("content", 1, 1024)) > 0
    both = wanted.join(reuse, "url", "left").join(fetched.withColumnRenamed("error", "failed"), "url", "left")
    error = F.coalesce("failed", F.when(F.col("content").isNotNull() & ~head, "no PDF header"))
    status = F.when(F.coalesce("reuse", F.lit(False)), "cached").when(error.isNotNull(), "error").when(F.col("content").isNotNull(), "downloaded").otherwise("pending")
    return both.select(*[wanted[c] for c in wanted.columns], status.alias("status"), F.octet_length("content").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.when(status == "error", error).alias("error"))


def failures(entries: DataFrame) -> DataFrame:
    """(status, n) of a manifest's entries."""
    return entries.groupBy("status").agg(F.count("*").alias("n"))
