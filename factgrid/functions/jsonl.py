"""JSON lines as Python's reader takes them: of a repeated key the last one counts, NaN is a number, whole numbers have any length."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _plain(raw: str | None) -> str | None:
    """The line with one value a key, NaN and infinities as null, so that Spark's parser takes it; null where it isn't JSON."""
    if raw is None:
        return None
    try:
        return json.dumps(json.loads(raw, parse_constant=lambda _: None), ensure_ascii=False)
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(StringType())
def _plain_lines(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(_plain)


@F.pandas_udf(StringType())
def _whole_ids(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def digits(raw: str | None) -> str | None:
        if raw is None:
            return None
        got = json.loads(raw, parse_constant=lambda _: None).get("id")
        return str(got) if type(got) is int else None

    for s in parts:
        yield s.map(digits)


@F.pandas_udf(StringType())
def _dumped_votes(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda raw: None if raw is None else json.dumps(json.loads(raw, parse_constant=lambda _: None).get("vote"), ensure_ascii=False))


def parsed(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """rows with `line` and its variant `v`: raw where Spark's parser takes it; else, in Python and for such lines alone, the same JSON in a form that it takes, or null."""
    rows = rows.withColumn("_v", F.when(F.is_valid_utf8(raw), F.try_parse_json(raw)))
    rows = rows.withColumn("_p", _plain_lines(F.when(F.col("_v").isNull() & F.is_valid_utf8(raw), F.col(raw))))
    return rows.withColumn("line", F.when(F.col("_v").isNotNull(), F.col(raw)).otherwise(F.col("_p"))).withColumn("v", F.coalesce("_v", F.try_parse_json("_p"))).drop("_v", "_p")


def kind_of(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def ident(line: Column, v: Column) -> tuple[Column, Column]:
    """Kind and text of a line's id. A whole number without a point is a BIGINT, however long; what Spark reads as a decimal or double is looked at in Python."""
    own = F.try_variant_get(v, "$.id", "variant")
    digits = _whole_ids(F.when(kind_of(own).rlike("^(DECIMAL|DOUBLE|FLOAT)"), line))
    return F.when(digits.isNotNull(), "BIGINT").otherwise(kind_of(own)), F.coalesce(digits, F.try_variant_get(v, "$.id", "string"))


def dumped_vote(line: Column, wanted: Column) -> Column:
    """The vote of a line as JSON, its keys in their order, where wanted is true."""
    return _dumped_votes(F.when(wanted, line))
