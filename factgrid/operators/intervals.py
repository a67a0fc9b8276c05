"""Intervals and blocks over the ordered rows of a key, however many one key has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgrid.operators import segmented


def covered(spans: DataFrame, key: str, start: str = "start", end: str = "end", since: float | None = None, until: float | None = None) -> DataFrame:
    """(key, seconds): the length that the spans of a key cover together, clipped to since..until."""
    a = F.col(start) if since is None else F.greatest(F.col(start), F.lit(since))
    b = F.col(end) if until is None else F.least(F.col(end), F.lit(until))
    order = [F.col("a"), F.col("b")]
    s = segmented.dealt(spans.select(key, a.alias("a"), b.alias("b")), order, [key])
    s = segmented.scanned(s, order, {"before": segmented.running_max(F.col("b"))}, [key])
    new = F.greatest(F.lit(0), F.col("b") - F.greatest(F.col("a"), F.coalesce("before", F.col("a"))))
    return s.withColumn("new", new).groupBy(key).agg(F.sum("new").alias("seconds"))


def blocks(rows: DataFrame, key: str, by: str, gap: float) -> DataFrame:
    """rows with `block`: by descending `by`, a new block where the step is `gap` or more."""
    order = [-F.col(by)]
    s = segmented.dealt(rows, order, [key])
    s = segmented.scanned(s, order, {"above": segmented.previous(F.col(by))}, [key])
    s = s.withColumn("opens", F.coalesce((F.col("above") - F.col(by) >= gap).cast("int"), F.lit(0)))
    order.append(-F.col("opens"))  # of equal heights, the one that opens the block comes first
    s = segmented.scanned(s, order, {"earlier": segmented.running_sum(F.col("opens"))}, [key])
    return s.withColumn("block", F.col("earlier") + F.col("opens")).drop("above", "opens", "earlier", segmented.STRETCH)
