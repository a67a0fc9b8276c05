"""Queries on the text of pages and on evidence: places of lines, choices between texts, labels, stray hyphens, evidence items, best chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgrid.functions import text
from factgrid.operators import evaluate, layout, quotes, segmented
from factgrid.plans import run
from factgrid.sources import pages, predictions, requests


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def line_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Where each line of a document begins, blanks at its beginning left out: lines get up to four of them."""
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.lit(1).alias("page"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    lines = lines.withColumn("text", F.concat(F.repeat(F.lit(" "), F.pmod("line_no", F.lit(5))), "text"))
    return pages.offsets(lines).select(F.col("path").alias("doc_id"), "line_no", F.col("offset").cast("long").alias("begins"))


def page_choice(spark: SparkSession, d: str) -> DataFrame:
    """Two extractors' texts of a turn: the second says the same, the same twice, or something more backwards. Which was taken, and its shingles."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("a"))
    b = F.when(F.col("turn") % 3 == 0, F.concat("a", F.lit(" "), F.reverse("a"))).when(F.col("turn") % 3 == 1, F.concat("a", F.lit(" "), "a")).otherwise(F.col("a"))
    chosen = c.withColumn("b", b).withColumn("chosen", text.choose_page(F.col("a"), F.col("b")))
    return chosen.select("conv_id", "turn", F.length("chosen").alias("chars"), F.size(text.char_shingles(F.col("chosen"))).alias("shingles"))


def _margin(spark: SparkSession, d: str) -> DataFrame:
    """Events as lines of a user's page, half an hour a point high; every fourth in the margin, every ninth a hyphen alone, some with a break mark."""
    k = F.col("event_id")
    return table(spark, d, "events").select(
        F.col("user_id").alias("path"), F.lit(1).alias("page"), k.alias("line_no"), (k % 97).cast("double").alias("left"), (F.unix_seconds(F.col("ts").cast("timestamp")) / 1800.0).alias("top"),
        F.when(k % 9 == 4, "-").when(k % 5 == 0, F.concat("event_type", F.lit("­"))).otherwise(F.col("event_type")).alias("text"), (k % 4 == 0).alias("is_label"),
    )


def label_texts(spark: SparkSession, d: str) -> DataFrame:
    """The labels' texts, block by block, words that are broken between lines joined."""
    lines = _margin(spark, d).where("text <> '-'")
    return layout.label_anchors(lines).select(F.col("path").alias("user_id"), F.col("block").cast("long").alias("block"), "label")


def stray_hyphens(spark: SparkSession, d: str) -> DataFrame:
    """How many hyphens that stood alone each line has got."""
    mark = F.length("text") - F.length(F.regexp_replace("text", "­", ""))
    return layout.place_hyphens(_margin(spark, d).where("line_no % 5 <> 0")).select("line_no", mark.alias("marks")).where("marks > 0")


def evidence_items(spark: SparkSession, d: str) -> DataFrame:
    """Responses with up to seven items of evidence, some of them malformed: how many of the first five count, and the labels that do."""
    n, k = F.pmod("n_chars", F.lit(8)), F.col("doc_id")
    item = lambda i: F.when((k + i) % 5 == 0, F.to_json(F.struct(i.alias("text")))).when((k + i) % 5 == 1, F.lit('"text"')).otherwise(F.to_json(F.struct(F.concat(F.lit("q"), i).alias("text"))))
    items = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), item), ",")
    raw = F.concat(F.lit('{"label": '), F.when(k % 3 == 0, "true").otherwise((k % 4).cast("string")), F.lit(', "label": '), F.when(k % 7 == 0, "1.0").otherwise((k % 4).cast("string")), F.lit(', "label_name": "neutral", "evidence": ['), items, F.lit("]}"))
    read = evaluate.responses(table(spark, d, "documents").select(k.alias("id"), raw.alias("raw")))
    return read.select("id", "label", "problem", F.array_join("quotes", ",").alias("quotes"))


def best_passages(spark: SparkSession, d: str) -> DataFrame:
    """Of a conversation's turns the one most like a stretch of its longest; without a stretch long enough, the first."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("request"), F.col("turn").alias("chunk"), F.lit(None).cast("int").alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    longest = c.groupBy("request").agg(F.max_by("text", F.struct(F.length("text"), -F.col("chunk"))).alias("t"))
    asked = longest.select("request", F.substring("t", F.lit(3), F.when(F.col("request") % 4 == 0, 5).otherwise(F.length("t"))).alias("text"))
    return quotes.best_chunks(asked, c).select("request", "chunk", F.length("text").alias("chars"))


def neutral_run(spark: SparkSession, d: str) -> DataFrame:
    """Turns as requests, those that keep the contract predicted as neutral and checked: what is written, and whether it may be."""
    c = table(spark, d, "conversations").where(F.col("text").rlike(r"(?U)\S"))
    order = [F.col("conv_id"), F.col("turn")]
    c = segmented.scanned(segmented.dealt(c.select("conv_id", "turn", "text"), order), order, {"before": segmented.running_count()})
    number = F.col("conv_id") * 1000 + F.col("turn")
    ident = F.when(F.col("turn") % 2 == 0, number.cast("string")).otherwise(F.concat(F.lit('"'), number.cast("string"), F.lit('"')))
    body = F.to_json(F.struct(F.col("text").alias("text"), F.lit("fr").alias("language")))
    raw = F.concat(F.lit('{"id": '), ident, F.lit(', "vote": null, "claim": '), body, F.lit(', "reference": '), body, F.lit("}"))
    asked = requests.checked(c.select((F.col("before") + 1).alias("line_no"), raw.alias("raw"))).where("error is null").drop("error")
    return predictions.checked(run.judged(asked, run.Neutral().predict(asked))).select("line_no", "raw", "error")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (line_offsets, page_choice, label_texts, stray_hyphens, evidence_items, best_passages, neutral_run)}


_MARGIN = """m AS (SELECT user_id, event_id AS k, CAST(event_id % 97 AS DOUBLE) AS lft, CAST(epoch_us(ts) // 1000000 AS DOUBLE) / 1800 AS top,
  CASE WHEN event_id % 9 = 4 THEN '-' WHEN event_id % 5 = 0 THEN event_type || chr(173) ELSE event_type END AS text, event_id % 4 = 0 AS is_label FROM events)"""


def oracle_sql() -> dict[str, str]:
    return {
        "line_offsets": """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents), e AS (SELECT doc_id, unnest(t) AS text, CAST(unnest(range(len(t))) AS INTEGER) AS line_no FROM l),
  p AS (SELECT doc_id, line_no, repeat(' ', line_no % 5) || text AS text FROM e)
SELECT doc_id, line_no, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(text) - length(regexp_replace(text, '^\\s+', '')) AS BIGINT) AS begins FROM p""",
        "page_choice": r"""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS a FROM conversations), d AS (SELECT *, CASE turn % 3 WHEN 0 THEN a || ' ' || reverse(a) WHEN 1 THEN a || ' ' || a ELSE a END AS b FROM c),
  f AS (SELECT *, regexp_replace(replace(lower(a), 'ß', 'ss'), '\s+', ' ', 'g') AS fa, regexp_replace(replace(lower(b), 'ß', 'ss'), '\s+', ' ', 'g') AS fb FROM d),
  g AS (SELECT *, list_distinct(list_transform(range(1, length(fa) - 8), lambda i: substring(fa, i, 10))) AS sa, list_distinct(list_transform(range(1, length(fb) - 8), lambda i: substring(fb, i, 10))) AS sb FROM f),
  h AS (SELECT *, len(sb) > 0 AND length(b) > length(a) + 100 AND len(list_filter(sb, lambda x: NOT list_contains(sa, x))) / len(sb) > 0.15 AS second FROM g)
SELECT conv_id, turn, CASE WHEN second THEN length(b) ELSE length(a) END AS chars, CAST(CASE WHEN second THEN len(sb) ELSE len(sa) END AS INTEGER) AS shingles FROM h""",
        "label_texts": f"""WITH {_MARGIN}, l AS (SELECT * FROM m WHERE is_label AND text <> '-'), o AS (SELECT *, CASE WHEN lag(top) OVER (PARTITION BY user_id ORDER BY top DESC) - top >= 16 THEN 1 ELSE 0 END AS opens FROM l),
  b AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY top DESC) AS block FROM o)
SELECT user_id, CAST(block AS BIGINT) AS block, regexp_replace(string_agg(text, ' ' ORDER BY top DESC, k), chr(173) || '\\s*', '', 'g') AS label FROM b GROUP BY user_id, block""",
        "stray_hyphens": f"""WITH {_MARGIN}, n AS (SELECT * FROM m WHERE k % 5 <> 0), h AS (SELECT * FROM n WHERE text = '-'), r AS (SELECT * FROM n WHERE text <> '-'),
  j AS (SELECT h.k AS h, r.k, row_number() OVER (PARTITION BY h.k ORDER BY r.lft DESC, r.is_label, r.k) AS place FROM h JOIN r ON h.user_id = r.user_id AND abs(h.top - r.top) <= 6 AND r.lft < h.lft)
SELECT k AS line_no, CAST(count(*) AS INTEGER) AS marks FROM j WHERE place = 1 GROUP BY k""",
        "evidence_items": """SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 OR doc_id % 4 <> 1 THEN -1 ELSE 1 END AS label, CASE WHEN doc_id % 7 = 0 OR doc_id % 4 = 3 THEN 'invalid label' WHEN doc_id % 4 <> 1 THEN 'label_name does not match label' END AS problem,
  array_to_string(list_transform(list_filter(range(1, least(greatest(n_chars % 8, 1), 5) + 1), lambda i: (doc_id + i) % 5 > 1), lambda i: 'q' || i), ',') AS quotes FROM documents""",
        "best_passages": """WITH c AS (SELECT conv_id AS request, turn AS chunk, coalesce(text, '') AS text FROM conversations), l AS (SELECT request, first(text ORDER BY length(text) DESC, chunk) AS t FROM c GROUP BY request),
  a AS (SELECT request, CASE WHEN request % 4 = 0 THEN substring(t, 3, 5) ELSE substring(t, 3) END AS w FROM l)
SELECT request, min(chunk) AS chunk, CAST(first(length(text) ORDER BY chunk) AS INTEGER) AS chars FROM c JOIN a USING (request) WHERE length(trim(w)) < 8 OR contains(text, w) OR (text <> '' AND contains(w, text)) GROUP BY request""",
        "neutral_run": """SELECT row_number() OVER (ORDER BY conv_id, turn) AS line_no, '{"id":' || CASE WHEN turn % 2 = 0 THEN '' || (conv_id * 1000 + turn) ELSE '"' || (conv_id * 1000 + turn) || '"' END
  || ',"label":1,"label_name":"neutral","evidence":[],"metrics":{"input_tokens":0,"output_tokens":0,"inference_time_ms":0}}' AS raw, CAST(NULL AS VARCHAR) AS error FROM conversations WHERE regexp_matches(text, '\\S')""",
    }
