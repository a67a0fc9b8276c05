"""The evaluator from files to a report and a scorecard."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgrid.functions import jsonl
from factgrid.functions.text import EVIDENCE_CHARS, LABELS
from factgrid.operators import evaluate, quotes, scoring
from factgrid.storage import Folder, stored

# fixed value: what a report says where gold passages are missing
NO_PASSAGE = "add the gold passages to the expected labels"


def rows(spark: SparkSession, path: str) -> DataFrame:
    """raw, line and variant v of the lines of JSONL files that aren't blank; fails at a line that isn't a JSON object."""
    read = jsonl.parsed(spark.read.text(path).select(F.col("value").alias("raw")).where(F.col("value").rlike(r"(?U)\S")))
    good = F.when(F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)), True).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("raw", 1, 200))).cast("boolean"))
    return read.where(good)


def _text(path: str):
    return F.try_variant_get("v", path, "string")


def expected(spark: SparkSession, path: str) -> DataFrame:
    """(id, label, reference); of lines with the same id the last in the file's order counts."""
    own = rows(spark, path).select(_text("$.id").alias("id"), F.try_variant_get("v", "$.label", "int").alias("label"), _text("$.reference").alias("reference"), F.monotonically_increasing_id().alias("at"))
    last = own.groupBy("id").agg(F.max_by(F.struct("label", "reference"), "at").alias("r"))
    return last.select("id", "r.*")


def cases(spark: SparkSession, path: str) -> DataFrame:
    """(id, task, source_lang, claim_lang): task A where there is a booklet, else B; languages are null where they aren't given."""
    keys = F.json_object_keys("line")
    has = lambda k: F.array_contains(keys, k)
    source = F.when(has("reference"), _text("$.reference.language")).otherwise(_text("$.booklet.language"))
    own = rows(spark, path).select(_text("$.id").alias("id"), F.when(has("booklet"), "A").otherwise("B").alias("task"), source.alias("source_lang"), _text("$.claim.language").alias("claim_lang"), F.monotonically_increasing_id().alias("at"))
    last = own.groupBy("id").agg(F.max_by(F.struct("task", "source_lang", "claim_lang"), "at").alias("r"))
    return last.select("id", "r.*")


def report(paired: DataFrame, predictions: DataFrame, min_score: float = quotes.MIN_SCORE, max_chars: int = EVIDENCE_CHARS) -> dict:
    """All figures, of rows of evaluate.paired(). What comes to the driver is a few rows for each task, language pair, metric and kind of issue."""
    scores = scoring.class_scores(paired, "task")
    by_class: dict[str, dict] = {}
    for r in scores.orderBy("label").collect():
        by_class.setdefault(r["task"], {})[LABELS[r["label"]]] = {k: r[k] for k in ("precision", "recall", "f1", "support")}
    three = {r["task"]: r["mean_f1"] for r in scoring.mean_f1(scores, "task").collect()}
    tasks = {}
    for r in evaluate.tasks(paired, min_score, max_chars).orderBy("task").collect():
        one = {"cases": r["cases"], "macro_f1": r["macro_f1"], "mean_f1": three[r["task"]], "threshold": r["threshold"], "passes_threshold": r["passes"], "accuracy": r["accuracy"], "per_class": by_class[r["task"]]}
        if r["evidence_cases"]:
            one["evidence_score"] = r["evidence_score"]
            one["evidence"] = {"cases": r["evidence_cases"], "found": r["found"], "without_gold_passage": r["without_passage"]} | ({"note": NO_PASSAGE} if r["without_passage"] else {})
        tasks[r["task"]] = one
    known = predictions.select("id").join(paired.select("id"), "id", "left_semi").distinct()
    return {
        "cases": paired.count(), "responses": known.count(), "issues": {r["issue"]: r["n"] for r in evaluate.issues(paired, predictions).orderBy(F.desc("n"), "issue").collect()}, "tasks": tasks,
        "languages": {r["pair"]: {"cases": r["cases"], "macro_f1": r["macro_f1"]} for r in evaluate.pairs(paired).orderBy("pair").collect()},
        "usage_mean_per_case": {r["metric"]: r["mean"] for r in evaluate.usage(paired).collect()},
    }


def scorecard(figures: dict) -> str:
    """The report in lines to read."""
    out = [f"{figures['cases']} cases, {figures['responses']} with a response"]
    for task, t in figures["tasks"].items():
        verdict = "" if t["threshold"] is None else f" (at least {t['threshold']:.2f}: {'pass' if t['passes_threshold'] else 'BELOW'})"
        out += ["", f"Task {task}, {t['cases']} cases", f"  macro-F1  {t['macro_f1']:.4f}{verdict}", f"  accuracy  {t['accuracy']:.4f}"]
        out += [f"    {name:13} precision {c['precision']:.3f}  recall {c['recall']:.3f}  F1 {c['f1']:.3f}  n {c['support']}" for name, c in t["per_class"].items()]
        if "evidence" in t:
            e = t["evidence"]
            out.append(f"  evidence  {t['evidence_score']:.4f} ({e['found']} of {e['cases']})" if t["evidence_score"] is not None else f"  evidence  none: {e['without_gold_passage']} of {e['cases']} cases have no gold passage; {e['note']}")
    if figures["languages"]:
        out += ["", "Macro-F1 by language", *[f"  {pair:12} {x['macro_f1']:.4f}  n {x['cases']}" for pair, x in figures["languages"].items()]]
    out += ["", "Reported per case: " + ", ".join(f"{k} {v:.0f}" for k, v in figures["usage_mean_per_case"].items())]
    if figures["issues"]:
        out += ["", "Issues", *[f"  {n:6}  {issue}" for issue, n in sorted(figures["issues"].items(), key=lambda x: (-x[1], x[0]))]]
    return "\n".join(out)


def evaluate_files(spark: SparkSession, predicted: str, gold: str, known: str | None = None, min_score: float = quotes.MIN_SCORE, max_chars: int = EVIDENCE_CHARS, target: str | None = None) -> dict:
    """The report of JSONL files of predictions, expected labels and, if given, cases; each file is read once. It is written as JSON to the file `target`, if given.

    A quote counts if it has at most max_chars characters and is at least min_score like the gold passage.
    """
    said = stored(rows(spark, predicted).select(_text("$.id").alias("id"), "raw"), "responses")
    paired = stored(evaluate.paired(expected(spark, gold), said, cases(spark, known) if known else None), "paired")
    figures = report(paired, said, min_score, max_chars)
    if target:
        folder, _, name = target.rpartition("/")
        Folder(folder or ".").write(name, (json.dumps(figures, indent=2, ensure_ascii=False) + "\n").encode())
    return figures
