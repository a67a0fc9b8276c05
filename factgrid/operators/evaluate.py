"""The evaluator: predictions against expected labels, by task and language pair, with evidence, usage and issues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgrid.functions import jsonl
from factgrid.functions.text import EVIDENCE_CHARS, LABELS
from factgrid.operators import quotes, scoring

# fixed values: the tasks' pass marks, how many items of evidence count, what a response reports of its cost
THRESHOLDS = {"A": 0.60, "B": 0.70}
MOST_QUOTES = 5
METRICS = ("input_tokens", "output_tokens", "inference_time_ms")


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _number(path: str) -> Column:
    """A number that isn't negative (true is none, NaN neither), else null."""
    v = F.try_variant_get("_v", path, "double")
    counts = _kind(F.try_variant_get("_v", path, "variant")).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return F.when(counts & ~F.isnan(v) & (v >= 0), v)


def responses(predictions: DataFrame) -> DataFrame:
    """(id, label, problem, quotes, input_tokens, output_tokens, inference_time_ms) of predictions(id, raw).

    label is -1 where problem says why it doesn't count. Of the evidence the first five places are looked at, then those without a text are
    left out. A metric that isn't a number of at least 0 is null.
    """
    v = jsonl.parsed(predictions).withColumnRenamed("v", "_v")
    label = F.try_variant_get("_v", "$.label", "int")
    valid = (_kind(F.try_variant_get("_v", "$.label", "variant")) == "BIGINT") & F.coalesce(label.between(0, 2), F.lit(False))
    named = F.try_variant_get("_v", "$.label_name", "string").eqNullSafe(F.element_at(F.array(*map(F.lit, LABELS)), F.when(valid, label + 1).otherwise(1)))
    problem = F.when(~valid, "invalid label").when(~named, "label_name does not match label")
    said = F.transform(F.slice(F.try_variant_get("_v", "$.evidence", "array<variant>"), 1, MOST_QUOTES), lambda x: F.when(_kind(F.try_variant_get(x, "$.text", "variant")) == "STRING", F.try_variant_get(x, "$.text", "string")))
    return v.select(
        "id", F.when(problem.isNull(), label).otherwise(-1).alias("label"), problem.alias("problem"), F.coalesce(F.filter(said, lambda q: q.isNotNull()), F.array().cast("array<string>")).alias("quotes"),
        *[_number(f"$.metrics.{m}").alias(m) for m in METRICS],
    )


def task_of(ident: Column, task: Column) -> Column:
    """The case's task, or else what its id ends in behind the last hyphen."""
    return F.coalesce(task, F.element_at(F.split(ident, "-"), -1))


def language_pair(task: Column, source: Column, claim: Column) -> Column:
    return F.concat(task, F.lit(" "), F.coalesce(source, F.lit("?")), F.lit("->"), F.coalesce(claim, F.lit("?")))


def paired(expected: DataFrame, predictions: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """A row per expected(id, label, reference): its task, pair (null without a case), label, pred and what its one response says.

    cases(id, task, source_lang, claim_lang). No response, or several, make pred -1 and `answered` false.
    """
    read = responses(predictions)
    once = read.groupBy("id").agg(F.count("*").alias("n"), F.first(F.struct(*read.columns[1:])).alias("r")).where("n = 1").select("id", "r.*", F.lit(True).alias("answered"))
    known = cases if cases is not None else expected.select("id").limit(0).withColumns({c: F.lit(None).cast("string") for c in ("task", "source_lang", "claim_lang")})
    both = expected.join(known.withColumnRenamed("task", "case_task"), "id", "left").join(once.withColumnRenamed("label", "pred"), "id", "left")
    task = task_of(F.col("id"), F.col("case_task"))
    return both.select(
        "id", task.alias("task"), F.when(F.col("case_task").isNotNull(), language_pair(task, F.col("source_lang"), F.col("claim_lang"))).alias("pair"), "label", "reference",
        F.coalesce("pred", F.lit(-1)).alias("pred"), F.coalesce("answered", F.lit(False)).alias("answered"), "problem", F.coalesce("quotes", F.array().cast("array<string>")).alias("quotes"), *METRICS,
    )


def evidence(rows: DataFrame, min_score: float = quotes.MIN_SCORE, max_chars: int = EVIDENCE_CHARS) -> DataFrame:
    """(task, evidence_cases, found, without_passage, evidence_score): task A's cases that aren't neutral whose quotes meet the gold passage; no score if any passage is missing."""
    own = rows.where((F.col("task") == "A") & (F.col("label") != 1))
    hits = quotes.evidence_hits(own.select("id", F.col("reference").alias("passage")), own.select("id", F.explode("quotes").alias("quote")), min_score, max_chars)
    by = own.join(hits, "id").groupBy("task").agg(F.count("*").alias("evidence_cases"), F.count_if("hit").alias("found"), F.count_if(F.col("reference").isNull()).alias("without_passage"))
    return by.withColumn("evidence_score", F.when(F.col("without_passage") == 0, F.col("found") / F.col("evidence_cases")))


def tasks(rows: DataFrame, min_score: float = quotes.MIN_SCORE, max_chars: int = EVIDENCE_CHARS) -> DataFrame:
    """(task, cases, macro_f1, accuracy, threshold, passes) and the columns of evidence(); tasks without a pass mark have null for both."""
    f1 = scoring.macro_f1(scoring.class_scores(rows, "task"), "task").select("task", "macro_f1")
    counted = rows.groupBy("task").agg(F.count("*").alias("cases"), F.avg((F.col("label") == F.col("pred")).cast("int")).alias("accuracy"))
    mark = reduce(lambda c, t: c.when(F.col("task") == t, THRESHOLDS[t]), THRESHOLDS, F.when(F.lit(False), 0.0))
    out = counted.join(f1, "task").withColumn("threshold", mark).withColumn("passes", F.col("macro_f1") >= F.col("threshold"))
    return out.join(evidence(rows, min_score, max_chars), "task", "left")


def pairs(rows: DataFrame) -> DataFrame:
    """(pair, macro_f1, cases) of the cases that are known."""
    return scoring.macro_f1(scoring.class_scores(rows.where(F.col("pair").isNotNull()), "pair"), "pair")


def usage(rows: DataFrame) -> DataFrame:
    """(metric, mean): what the valid responses report, over all expected cases; no rows without any case."""
    sums = rows.agg(F.count("*").alias("cases"), *[F.coalesce(F.sum(m), F.lit(0.0)).alias(m) for m in METRICS]).where("cases > 0")
    return sums.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), (F.col(m) / F.col("cases")).alias("mean")) for m in METRICS])).alias("x")).select("x.*")


def issues(rows: DataFrame, predictions: DataFrame) -> DataFrame:
    """(issue, n): what keeps responses from counting, and metrics that aren't numbers."""
    tagged = [(~F.col("answered"), "missing or duplicate response"), *[(F.col("problem") == p, p) for p in ("invalid label", "label_name does not match label")]]
    tagged += [(F.col("answered") & F.col(m).isNull(), f"invalid metrics.{m} (does not affect the score)") for m in METRICS]
    found = rows.select(F.explode(F.array_compact(F.array(*[F.when(test, issue) for test, issue in tagged]))).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))
    by = predictions.groupBy("id").agg(F.count("*").alias("n")).join(rows.select("id", F.lit(True).alias("known")), "id", "left")
    outside = by.where("known is null").select(F.lit("unknown id").alias("issue"), "n").union(by.where("known and n > 1").select(F.lit("duplicate id").alias("issue"), (F.col("n") - 1).alias("n")))
    return found.union(outside.groupBy("issue").agg(F.sum("n").alias("n")))


def confusion(rows: DataFrame, by: str) -> DataFrame:
    """(by, label, pred, n) for all nine pairs of labels, 0 where there are none."""
    grid = rows.select(by).distinct().select(by, F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("label")).select(by, "label", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("pred"))
    n = rows.groupBy(by, "label", "pred").agg(F.count("*").alias("n"))
    return grid.join(n, [by, "label", "pred"], "left").select(by, "label", "pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
