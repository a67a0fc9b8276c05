"""Pages of PDF files: an extractor gives line boxes, Spark makes the pages' texts of them.

An extractor is a function from a file's bytes to rows (page, line_no, left, top, page_width, text, has_form); which library it
uses is the caller's choice. A second one, (bytes, pages) -> rows (page, text), is asked about pages with forms alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgrid.functions import text
from factgrid.operators import layout, segmented

BOXES = "path string, page int, line_no int, left double, top double, page_width double, text string, has_form boolean, error string"
Extractor = Callable[[bytes], Iterable[tuple]]
SecondExtractor = Callable[[bytes, list[int]], Iterable[tuple]]


def files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, content) of the folder's files, not of folders below."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").load(folder).select("path", "content")


def line_boxes(files: DataFrame, extract: Extractor) -> DataFrame:
    """The boxes of each file; one that can't be read gives a row with its error alone."""

    def boxes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in BOXES.split(", ")]
        for part in parts:
            for path, content in zip(part["path"], part["content"]):
                try:
                    rows = [(path, *row, None) for row in extract(content)]
                except Exception as error:  # a file's fault is its own row's, not the task's
                    rows = [(path, *[None] * 7, f"{type(error).__name__}: {error}")]
                yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(boxes, BOXES)


def offsets(lines: DataFrame) -> DataFrame:
    """lines(path, page, line_no, text) with `offset`: where each line's first character that isn't blank stands in the page, two characters a line end."""
    order = [F.col("line_no")]
    placed = segmented.scanned(segmented.dealt(lines, order, ["path", "page"]), order, {"before": segmented.running_sum(F.length("text") + 2)}, ["path", "page"])
    blanks = F.length("text") - F.length(F.regexp_replace("text", r"(?U)^\s+", ""))
    return placed.withColumn("offset", F.col("before") + blanks).drop("before", segmented.STRETCH)


def pages(files: DataFrame, extract: Extractor, second: SecondExtractor | None = None) -> DataFrame:
    """(path, page, text, error): the pages that hold evidence, and a row with an error for each file that has none or can't be read."""
    boxes = line_boxes(files, extract)
    good = boxes.where("error is null")
    texts = layout.page_texts(good.where(F.col("text").rlike(r"(?U)\S")).drop("has_form", "error"))
    if second is not None:
        asked = good.where("has_form").groupBy("path").agg(F.sort_array(F.collect_set("page")).alias("pages"))

        def again(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for path, content, wanted in zip(part["path"], part["content"], part["pages"]):
                    try:
                        rows = [(path, *row) for row in second(content, list(wanted))]
                    except Exception:  # the first text stays
                        rows = []
                    yield pd.DataFrame(rows, columns=["path", "page", "second"])

        other = files.join(asked, "path").select("path", "content", "pages").mapInPandas(again, "path string, page int, second string")
        texts = texts.join(other, ["path", "page"], "left").select("path", "page", F.when(F.col("second").isNotNull(), text.choose_page(F.col("text"), F.col("second"))).otherwise(F.col("text")).alias("text"))
    kept = texts.withColumn("text", text.clean_page(F.col("text"))).where(~text.is_filler(F.col("text"))).withColumn("error", F.lit(None).cast("string"))
    failed = boxes.where("error is not null").select("path", "error")
    empty = files.select("path").join(kept.select("path").distinct(), "path", "left_anti").join(failed, "path", "left").select("path", F.coalesce("error", F.lit("no extractable text")).alias("error"))
    return kept.unionByName(empty, allowMissingColumns=True)
