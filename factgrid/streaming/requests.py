"""Requests as they arrive: each new file's lines under the contract, ids unique over a span of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factgrid.sources.requests import ruled

#: How long an id is remembered, at least, from the first request that had it.
REMEMBERED = "30 days"


def request_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the requests in a folder's JSONL files, with `error` for the rules a line breaks by itself; line_no is 0."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return ruled(lines.where(F.col("value").rlike(r"(?U)\S")).select(F.lit(0).cast("long").alias("line_no"), F.col("value").alias("raw")))


def first_of_id(stream: DataFrame, remembered: str = REMEMBERED) -> DataFrame:
    """The good requests with the time that they arrived, the first of each id alone; 7 and "7" are two ids.

    An id is in the state store until `remembered` has passed in the stream since it first arrived, so the state follows the rate of requests and not
    the stream's age; then the id may come again. The clock is the batches' own, so no request is late.
    """
    return stream.where("error is null").withColumn("arrived", F.current_timestamp()).withWatermark("arrived", remembered).dropDuplicatesWithinWatermark(["id_kind", "id"])


def keep(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what has arrived to Parquet, then ends; started again, it goes on from the checkpoint."""
    out = stream.withColumn("vote", F.to_json("vote")) if "vote" in stream.columns else stream
    return out.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
