"""What each of several filters removes, in every order of applying them.

Spark counts the documents of each part by the set of filters they fail (at most 32 sets). From these counts come the
removals of all 32 coalitions of filters, and from them everything else: a step of an order removes the difference
of two coalitions, and a filter's Shapley value is the solution of the kernel-weighted least squares over the coalitions
whose values sum up to the removals of all filters, solved in rationals.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words.
SPACE = r"[\x20\x09-\x0D]+"
LEAST_WORDS = 200
LEAST_DISTINCT = 50
MOST_CAPITALS = 3
SYMBOLS = r"[#$%&*|]"
#: The last filter is that of copies, which no expression over one text decides.
LETTERS = "ABCDE"
COUNTS = ("n", "good", "toxic")
AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_failures(text: Column) -> list[Column]:
    """Whether the text has too few words, too few distinct ones (percent), too many capitals (percent), or symbols."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    return [n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n, 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > MOST_CAPITALS * F.char_length(text).cast("long"), F.regexp_like(text, F.lit(SYMBOLS))]


def failures(docs: DataFrame, tests: Sequence[Column] | None = None) -> DataFrame:
    """(part, doc_id, fails, n): documents by the filters they fail, one bit each in the order of LETTERS.

    tests: a condition on the column `body` for each letter but the last. Equal texts meet by their SHA-256, in aggregates: the smallest
    doc_id of each text is found first and meets the rows by text and doc_id together, so a text that a third of all rows hold is spread by doc_id.
    """
    tests = text_failures(F.col("body")) if tests is None else tests
    body = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("body"))
    bits = sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))
    slim = body.select("part", "doc_id", F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("digest"), bits.cast("int").alias("fails"))
    same = slim.groupBy("digest", "doc_id", "part", "fails").agg(F.count("*").alias("n"))
    first = slim.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    copy = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 1 << len(tests)).otherwise(0)
    marked = same.join(first, ["digest", "doc_id"], "left").select("part", "doc_id", (F.col("fails") + copy).alias("fails"), "n")
    return marked.groupBy("part", "doc_id", "fails").agg(F.sum("n").alias("n"))


def tabulated(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, n, good, toxic): documents that fail just these filters, and how many of them are labelled so; at most 32 rows a part."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("is_good"), F.max(F.col("toxic") == 1).alias("is_toxic"))
    both = failed.join(marks, "doc_id", "left")
    count = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return both.groupBy("part", "fails").agg(F.sum("n").alias("n"), count("is_good").alias("good"), count("is_toxic").alias("toxic"))


def solved(matrix: list[list[Fraction]], right: list[Fraction]) -> list[Fraction]:
    """The x of matrix x = right, by elimination in rationals."""
    rows = [[*row, r] for row, r in zip(matrix, right)]
    for i in range(len(rows)):
        pivot = next(k for k in range(i, len(rows)) if rows[k][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for k in range(len(rows)):
            if k != i and rows[k][i]:
                rows[k] = [x - rows[k][i] * y for x, y in zip(rows[k], rows[i])]
    return [row[-1] for row in rows]


def shapley(value: Sequence[int], filters: int) -> list[Fraction]:
    """Each filter's share of value[all], by least squares over the coalitions: value[s] is that of the filters whose bits s has, value[0] is 0.

    Minimises the sum over coalitions of weight * (value - sum of the shares in it) ** 2 where the shares sum up to value[all];
    a coalition of k of m filters weighs (m - 1) / (C(m, k) k (m - k)). A multiplier stands for the constraint in the normal equations.
    """
    everyone = (1 << filters) - 1
    a = [[Fraction(0)] * (filters + 1) for _ in range(filters + 1)]
    b = [Fraction(0)] * (filters + 1)
    for s in range(1, everyone):
        own = [i for i in range(filters) if s >> i & 1]
        weight = Fraction(filters - 1, comb(filters, len(own)) * len(own) * (filters - len(own)))
        for i in own:
            b[i] += weight * value[s]
            for j in own:
                a[i][j] += weight
    for i in range(filters):
        a[i][filters] = a[filters][i] = Fraction(1)
    b[filters] = Fraction(value[everyone])
    return solved(a, b)[:filters]


def steps(part: str, by: dict[int, tuple[int, int, int]], letters: str = LETTERS) -> list[tuple]:
    """The rows of AUDIT of one part; by: the counts of documents that fail just the filters of each set of bits."""
    m = len(letters)
    gone = [[sum(counts[c] for fails, counts in by.items() if fails & s) for s in range(1 << m)] for c in range(len(COUNTS))]
    n, good, toxic = gone
    total, everyone = sum(counts[0] for counts in by.values()), (1 << m) - 1
    shares = [int(x * factorial(m)) for x in shapley(n, m)]  # whole numbers: sums over all orders
    rows = []
    for order in permutations(range(m)):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = n[after] - n[before]
            rows.append((part, "".join(letters[k] for k in order), step, total - n[after], removed, n[1 << i] - removed, n[everyone] - n[everyone ^ 1 << i], good[after] - good[before], toxic[after] - toxic[before], shares[i]))
            before = after
    return rows


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of AUDIT: one row for each part, order of the filters and step.

    A part is a lang value; null and empty are one part. A null text is empty: it has no words, so it fails A alone of the text filters, and it is
    a copy of other empty texts. Of equal texts, rows with the smallest doc_id are no copies (repeated rows neither), nor are rows with
    a null doc_id, before which nothing comes. Labels meet documents by doc_id; of several labels for one doc_id, it is good (toxic) if any says so, and
    null labels say nothing. Texts of any length are read whole. Ties (just 200 words, just 50 or 3 percent) pass. An empty table gives no rows. Other columns are ignored.
    """

    def rows(key: tuple, counts: pd.DataFrame) -> pd.DataFrame:  # at most 32 rows
        by = {int(f): tuple(map(int, c)) for f, *c in counts[["fails", *COUNTS]].itertuples(index=False)}
        return pd.DataFrame(steps(key[0], by), columns=[x.split()[0] for x in AUDIT.split(", ")])

    return tabulated(failures(docs), labels).groupBy("part").applyInPandas(rows, AUDIT)
