"""Running values over the rows of each key, in order, where one key may hold most of the rows.

A window over a key puts all of the key's rows into one task. Here rows are dealt out by ranges of (key, order), so a large key
lies in many stretches, each in its own task. A stretch is summed up in one row (its count, sum, extremes, last value); what these
summaries make of the stretches before is carried into the stretch, and only within it rows are looked at one after the other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factgrid.storage import stored

STRETCH = "_stretch"


@dataclass(frozen=True)
class Fold:
    """An associative step over values: how rows are summed up, and how the sum of what comes earlier meets that of what comes later."""

    value: Column
    summed: Callable[[Column], Column]
    joined: Callable[[Column, Column], Column]
    last: bool = False


def running_sum(value: Column) -> Fold:
    """The sum of earlier rows' values; 0 before any."""
    return Fold(value, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def running_count() -> Fold:
    """How many rows come earlier."""
    return running_sum(F.lit(1))


def running_max(value: Column) -> Fold:
    """The greatest of earlier rows' values; null before any."""
    return Fold(value, F.max, lambda a, b: F.greatest(a, b))


def running_min(value: Column) -> Fold:
    """The least of earlier rows' values; null before any."""
    return Fold(value, F.min, lambda a, b: F.least(a, b))


def previous(value: Column) -> Fold:
    """The value of the row just before, null or not; null for a key's first row."""
    return Fold(value, F.last, lambda a, b: F.coalesce(b, a), last=True)


def dealt(rows: DataFrame, order: Sequence[Column], key: Sequence[str] = (), stretches: int | None = None) -> DataFrame:
    """rows with the number of their stretch, written once so that it stays. order: ascending columns, nulls first; ties may be cut anywhere."""
    n = stretches or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.repartitionByRange(n, *key, *order).withColumn(STRETCH, F.spark_partition_id()), "stretches")


def scanned(rows: DataFrame, order: Sequence[Column], folds: dict[str, Fold], key: Sequence[str] = ()) -> DataFrame:
    """Rows of dealt() with a column for each fold: what the earlier rows of the same key make. Null keys are one key.

    Rows that tie in `order` come in any order, so it should tell all rows apart whose values differ.
    """
    values = {f"_v{i}": F.struct(f.value.alias("v")) if f.last else f.value for i, f in enumerate(folds.values())}
    rows = rows.withColumns(values)
    within = Window.partitionBy(*key, STRETCH).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns({f"_w{i}": f.summed(F.col(f"_v{i}")).over(within) for i, f in enumerate(folds.values())})
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    sums = rows.groupBy(*key, STRETCH).agg(*[(F.max_by(F.col(f"_v{i}"), place) if f.last else f.summed(F.col(f"_v{i}"))).alias(f"_v{i}") for i, f in enumerate(folds.values())])
    earlier = Window.partitionBy(*key).orderBy(STRETCH).rowsBetween(Window.unboundedPreceding, -1)  # a row for each stretch of a key
    carry = sums.select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(key)], F.col(STRETCH).alias("_s"), *[f.summed(F.col(f"_v{i}")).over(earlier).alias(f"_c{i}") for i, f in enumerate(folds.values())])
    on = F.col(STRETCH) == F.col("_s")
    for j, k in enumerate(key):
        on &= F.col(k).eqNullSafe(F.col(f"_k{j}"))
    out = local.join(carry, on)
    joined = {name: f.joined(F.col(f"_c{i}"), F.col(f"_w{i}")) for i, (name, f) in enumerate(folds.items())}
    out = out.withColumns({name: c["v"] if folds[name].last else c for name, c in joined.items()})
    return out.drop("_s", *[f"_k{j}" for j in range(len(key))], *[f"{c}{i}" for i in range(len(folds)) for c in ("_v", "_w", "_c")])
