"""A model's answers: the first JSON object with a known label, its flags, citations and label."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from factgrid.functions import text

# fixed values: the words that answers may use for labels
LABEL_WORDS = ("ENTAIL", "ENTAILMENT", "NEUTRAL", "CONTRADICT", "CONTRADICTION")


def first_object(answer: str | None) -> str | None:
    """The first JSON object in an answer, prose around it or not, whose label is a known word; nested ones count."""
    reader = json.JSONDecoder(strict=False, parse_constant=lambda _: None)
    at = (answer or "").find("{")
    while at >= 0:
        try:
            found, _ = reader.raw_decode(answer, at)
        except (ValueError, RecursionError):
            found = None
        if isinstance(found, dict) and str(found.get("label")).strip().upper() in LABEL_WORDS:
            return json.dumps(found, ensure_ascii=False)
        at = answer.find("{", at + 1)
    return None


@F.pandas_udf(StringType())
def answer_object(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(first_object)


def _cited(item: Column) -> Column:
    """(chunk, quote) of a citation; evidence_id counts only where there is no key chunk."""
    named = F.coalesce(F.array_contains(F.json_object_keys(F.to_json(item)), "chunk"), F.lit(False))
    chunk = F.when(named, F.try_variant_get(item, "$.chunk", "int")).otherwise(F.try_variant_get(item, "$.evidence_id", "int"))
    quote = F.when(F.schema_of_variant(F.try_variant_get(item, "$.quote", "variant")) == "STRING", F.try_variant_get(item, "$.quote", "string"))
    return F.struct(chunk.alias("chunk"), quote.alias("quote"))


def parsed(rows: DataFrame, answer: str = "answer") -> DataFrame:
    """rows with label, claim_says, passage_says, citations array<(chunk, quote)> and parse_error in place of the answer.

    The flags subject_addressed and same_meaning decide before the label word. Without such an object a label in the text is
    taken, without its flags; else the label is NEUTRAL and parse_error says so. Malformed citations are left out.
    """
    read = rows.withColumn("_t", text.unfenced(F.col(answer))).withColumn("_w", F.try_parse_json("_t"))
    known = F.schema_of_variant("_w").startswith("OBJECT") & text.label_of(F.try_variant_get("_w", "$.label", "string")).isNotNull()
    read = read.withColumn("_w", F.when(known, F.col("_w")))  # an answer that is such an object and nothing else; only others go through Python
    read = read.withColumn("_p", answer_object(F.when(F.col("_w").isNull(), F.col("_t")))).withColumn("_v", F.coalesce("_w", F.try_parse_json("_p")))
    says = lambda key: F.try_variant_get("_v", f"$.{key}", "string")
    word = F.coalesce(text.label_of(says("label")), text.label_of(F.regexp_extract("_t", r'(?i)"label"\s*:\s*"?\s*([A-Za-z]+)', 1)))
    items = F.transform(F.try_variant_get("_v", "$.citations", "array<variant>"), _cited)
    good = F.filter(items, lambda c: c["chunk"].isNotNull() & F.coalesce(c["quote"].rlike(r"(?U)\S"), F.lit(False)))
    label = text.derived_label(text.tri_state(says("subject_addressed")), text.tri_state(says("same_meaning")), word)
    return read.select(
        *[rows[c] for c in rows.columns if c != answer],
        F.coalesce(label, F.lit("NEUTRAL")).alias("label"), says("claim_says").alias("claim_says"), says("passage_says").alias("passage_says"),
        F.coalesce(good, F.array().cast("array<struct<chunk:int,quote:string>>")).alias("citations"), F.when(word.isNull(), "no label in the answer").alias("parse_error"),
    )
