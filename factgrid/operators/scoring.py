"""Scores of predictions against gold labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paired(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """gold(id, label) with `pred`: -1 where there is no prediction, more than one, or no valid label."""
    n = predictions.groupBy("id").agg(F.count("*").alias("n"), F.first("label").alias("p"))
    valid = F.when((F.col("n") == 1) & F.col("p").isin(0, 1, 2), F.col("p")).otherwise(-1)
    return gold.join(n, "id", "left").select(*[gold[c] for c in gold.columns], valid.cast("int").alias("pred"))


def class_scores(pairs: DataFrame, by: str) -> DataFrame:
    """(by, label, precision, recall, f1, support, predicted) of the labels 0, 1, 2, one count of pairs per cell."""
    cells = pairs.groupBy(by, "label", "pred").agg(F.count("*").alias("n"))
    each = cells.select(by, F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("c"), "label", "pred", "n")
    total = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    sums = each.groupBy(by, "c").agg(total((F.col("label") == F.col("c")) & (F.col("pred") == F.col("c"))).alias("tp"), total(F.col("pred") == F.col("c")).alias("predicted"), total(F.col("label") == F.col("c")).alias("support"))
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    tp, p, s = F.col("tp"), F.col("predicted"), F.col("support")
    return sums.select(by, F.col("c").alias("label"), ratio(tp, p).alias("precision"), ratio(tp, s).alias("recall"), ratio(2 * tp, p + s).alias("f1"), "support", "predicted")


def macro_f1(scores: DataFrame, by: str) -> DataFrame:
    """(by, macro_f1, cases) over the classes that gold or valid predictions hold."""
    return scores.groupBy(by).agg(F.avg(F.when(F.col("support") + F.col("predicted") > 0, F.col("f1"))).alias("macro_f1"), F.sum("support").alias("cases"))


def mean_f1(scores: DataFrame, by: str) -> DataFrame:
    """(by, mean_f1, accuracy, cases) over all three classes, also those that neither gold nor predictions hold; without cases 0."""
    tp = F.sum(F.col("recall") * F.col("support"))
    n = F.sum("support")
    return scores.groupBy(by).agg(F.avg("f1").alias("mean_f1"), F.when(n > 0, F.round(tp) / n).otherwise(0.0).alias("accuracy"), n.alias("cases"))


def issues(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """(issue, n): unknown and duplicate ids, missing responses, invalid labels."""
    by = predictions.groupBy("id").agg(F.count("*").alias("n"), F.first("label").alias("p"))
    unknown = by.join(gold, "id", "left_anti").select(F.lit("unknown id").alias("issue"), "n")
    known = gold.select("id").join(by, "id", "left")
    twice = known.where("n > 1").select(F.lit("duplicate id").alias("issue"), (F.col("n") - 1).alias("n"))
    missing = known.where("n is null or n > 1").select(F.lit("missing or duplicate response").alias("issue"), F.lit(1).cast("long").alias("n"))
    invalid = known.where("n = 1 and (p is null or p not in (0, 1, 2))").select(F.lit("invalid label").alias("issue"), F.lit(1).cast("long").alias("n"))
    return unknown.union(twice).union(missing).union(invalid).groupBy("issue").agg(F.sum("n").alias("n"))
