"""The claim-checking queries over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgrid.functions import text
from factgrid.operators import answers, crawl, evaluate, intervals, layout, quotes, retrieval, scoring
from factgrid.sources import predictions, requests
from factgrid.storage import stored


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _gold(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("quality") == 0, 1).when(F.col("toxic") == 1, 2).otherwise(0)
    return table(spark, d, "labels").select(F.col("doc_id").alias("id"), label.alias("label"))


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    """A response per document, those divisible by 11 twice: labels 0 to 3, of which 3 is invalid."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.pmod(F.col("n_chars"), F.lit(4)).cast("int").alias("label"))
    return docs.union(docs.where("id % 11 = 0"))


def score_languages(spark: SparkSession, d: str) -> DataFrame:
    gold = _gold(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang"), "id")
    scores = scoring.class_scores(scoring.paired(gold, _predictions(spark, d)), "lang")
    return scoring.macro_f1(scores, "lang").select("lang", F.round("macro_f1", 9).alias("macro_f1"), "cases")


def score_issues(spark: SparkSession, d: str) -> DataFrame:
    return scoring.issues(_gold(spark, d), _predictions(spark, d))


def api_seconds(spark: SparkSession, d: str) -> DataFrame:
    """Milliseconds in which each user had a call open, a call lasting abs(value) whole seconds from ts; counted in microseconds."""
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    lasting = table(spark, d, "events").select("user_id", start.alias("start"), (start + F.floor(F.abs("value")) * 1_000_000).alias("end"))
    return intervals.covered(lasting, "user_id").select("user_id", F.expr("cast(seconds as bigint) div 1000").alias("open_ms"))


def label_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a margin, here events of a user at heights of whole seconds: blocks end at gaps of 3600 or more."""
    rows = table(spark, d, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("top"))
    return intervals.blocks(rows.distinct(), "user_id", "top", 3600).groupBy("user_id").agg((F.max("block") + 1).alias("blocks"), F.count("*").alias("lines"))


def top_pages(spark: SparkSession, d: str) -> DataFrame:
    """Claims are the vectors divisible by 100, booklets the labels; a claim is matched with its booklet's pages."""
    v = table(spark, d, "embeddings")
    pages = v.select(F.col("label").alias("path"), F.col("vec_id").alias("page"), F.col("embedding").alias("vec"))
    claims = pages.where("page % 100 = 0").withColumnRenamed("page", "request")
    return retrieval.top_pages(claims, pages).select("request", "page", "rank", F.round("score", 6).alias("score"))


def filler_pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents' lines as pages: how many, how many are filler, and how long the cleaned others are."""
    page = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("page"))
    cleaned = page.withColumn("page", text.clean_page(F.col("page"))).withColumn("filler", text.is_filler(F.col("page")))
    return cleaned.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if("filler").alias("filler"), F.coalesce(F.sum(F.when(~F.col("filler"), F.length("page"))), F.lit(0)).alias("chars"))


def request_contract(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns as request lines; by the rule that a line breaks first."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    ident = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    lang = F.element_at(F.array(*map(F.lit, ("de", "fr", "it", "en"))), (F.col("turn") % 4 + 1).cast("int"))
    body = F.struct(F.col("text").alias("text"), lang.alias("language"))
    line = F.when(F.col("conv_id") % 7 == 0, F.to_json(F.struct(ident.alias("id"), body.alias("claim"), body.alias("reference")))).otherwise(
        F.to_json(F.struct(ident.alias("id"), F.lit("v").alias("vote"), body.alias("claim"), body.alias("reference")))
    )
    rows = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("line_no"), line.alias("raw"))
    return requests.checked(rows).groupBy(F.coalesce("error", F.lit("ok")).alias("error")).agg(F.count("*").alias("n"))


def crawl_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The manifest of the pages' URLs: a file name for each, the languages (of each page by its id) and the pages that name it."""
    lang = F.element_at(F.array(*map(F.lit, text.LANGUAGES)), (F.pmod("page_id", F.lit(3)) + 1).cast("int"))
    m = crawl.manifest(table(spark, d, "pages").select(F.col("page_id").alias("reference"), "url", lang.alias("language")))
    return m.select("url", "path", F.array_join("languages", ",").alias("languages"), F.array_join(F.transform("references", lambda x: x.cast("string")), ",").alias("named_by"))


def _expected(spark: SparkSession, d: str) -> DataFrame:
    """Cases of three tasks, by their ids' ends; the gold passage is the document's beginning."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 120).alias("reference"))
    task = F.element_at(F.array(*map(F.lit, ("A", "B", "C"))), (F.pmod("id", F.lit(3)) + 1).cast("int"))
    return _gold(spark, d).join(docs, "id").select(F.concat_ws("-", "id", task).alias("id"), "label", "reference")


def _responses(spark: SparkSession, d: str) -> DataFrame:
    """A response per document as JSON, those divisible by 11 twice; some labels are 3, some names wrong, some metrics negative or strings."""
    doc = table(spark, d, "documents").withColumn("p", F.pmod("n_chars", F.lit(4)).cast("int"))
    task = F.element_at(F.array(*map(F.lit, ("A", "B", "C"))), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    name = F.when(F.col("doc_id") % 13 == 0, "wrong").otherwise(F.element_at(F.array(*map(F.lit, (*text.LABELS, "none"))), F.col("p") + 1))
    quote = F.when(F.col("doc_id") % 2 == 0, F.substring("text", 11, 40)).otherwise("zzzz zzzz zzzz")
    metrics = F.struct(F.when(F.col("doc_id") % 7 == 0, -1).otherwise(F.col("n_chars")).alias("input_tokens"), F.when(F.col("doc_id") % 5 != 0, 2).alias("output_tokens"), (F.col("doc_id") % 100 / 2).alias("inference_time_ms"))
    body = F.struct(F.col("p").alias("label"), name.alias("label_name"), F.array(F.struct(F.lit(1).alias("page"), quote.alias("text"))).alias("evidence"), metrics.alias("metrics"))
    out = doc.select("doc_id", F.concat_ws("-", "doc_id", task).alias("id"), F.to_json(body).alias("raw"))
    return out.union(out.where("doc_id % 11 = 0")).select("id", "raw")


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "documents").where("doc_id % 4 <> 0 and doc_id % 3 < 2").select(
        F.concat("doc_id", F.when(F.col("doc_id") % 3 == 0, "-A").otherwise("-B")).alias("id"), F.when(F.col("doc_id") % 3 == 0, "A").otherwise("B").alias("task"),
        F.col("lang").alias("source_lang"), F.when(F.col("doc_id") % 2 == 0, "fr").alias("claim_lang"),
    )
    return evaluate.paired(_expected(spark, d), _responses(spark, d), known)


def task_report(spark: SparkSession, d: str) -> DataFrame:
    """Cases, macro-F1, accuracy, pass mark and evidence by task."""
    t = evaluate.tasks(stored(_evaluated(spark, d), "evaluated"))
    return t.select("task", "cases", F.round("macro_f1", 9).alias("macro_f1"), F.round("accuracy", 9).alias("accuracy"), "threshold", "passes", "evidence_cases", "found", F.round("evidence_score", 9).alias("evidence_score"))


def language_pairs(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.pairs(_evaluated(spark, d)).select("pair", F.round("macro_f1", 9).alias("macro_f1"), "cases")


def usage(spark: SparkSession, d: str) -> DataFrame:
    """What responses report, per expected case."""
    return evaluate.usage(_evaluated(spark, d)).select("metric", F.round("mean", 6).alias("mean"))


def response_issues(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.issues(_evaluated(spark, d), _responses(spark, d))


def confusion(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.confusion(_evaluated(spark, d), "task")


def hyphen_breaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a mark put behind their tenth character and a line broken there, and a second mark within the line, cleaned up."""
    c = F.concat(F.substring("text", 1, 10), F.when(F.col("doc_id") % 2 == 0, " \u00ad \n ").otherwise("\n\x02"), F.substring("text", 11, 20), F.lit("\u00ad\x02\n\n\n\nend"))
    return table(spark, d, "documents").where("text rlike '^[A-Za-z0-9., ]{30}'").select("doc_id", text.join_hyphens(c).alias("joined"))


def first_evidence(spark: SparkSession, d: str) -> DataFrame:
    """A document's lines: quotes are its lines of 200 characters or more, retrieved pages all its lines in their order."""
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("request"), F.posexplode(F.split("text", "\n")).alias("page", "text"))
    quotes = lines.where(F.length("text") >= 200).withColumn("place", F.col("page"))
    ranked = lines.withColumn("rank", F.col("page"))
    out = retrieval.first_evidence(quotes, ranked)
    return out.select("request", "page", "place", F.length("text").alias("chars"))


def parsed_answers(spark: SparkSession, d: str) -> DataFrame:
    """An answer per document that cites the document's beginning; a quarter of them has no known label."""
    doc = table(spark, d, "documents")
    word = F.element_at(F.array(*map(F.lit, ("entail", "Neutral", "CONTRADICTION", "other"))), (F.pmod("n_chars", F.lit(4)) + 1).cast("int"))
    cited = F.array(F.struct(F.lit(0).alias("chunk"), F.substring("text", 1, 20).alias("quote")))
    said = F.to_json(F.struct(F.when(F.col("doc_id") % 5 == 0, False).alias("subject_addressed"), cited.alias("citations"), word.alias("label")))
    rows = answers.parsed(doc.select("doc_id", F.concat(F.lit("```json\n"), said, F.lit("\n```")).alias("answer")))
    return rows.select("doc_id", "label", F.size("citations").cast("long").alias("citations"), F.col("parse_error").isNotNull().alias("faulty"))


def first_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Turns as chunks of their conversation, their beginnings as quotes; the fourth turn's cites a turn that isn't there."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("request"), F.col("turn").alias("chunk"), F.col("turn").alias("page"), "text")
    cited = c.select("request", F.col("chunk").alias("place"), F.when(F.col("chunk") == 4, -1).otherwise(F.col("chunk")).alias("chunk"), F.substring("text", 1, 40).alias("quote"))
    return quotes.first_hits(cited, c).select("request", "place", "chunk", F.length("quote").alias("chars"))


def label_places(spark: SparkSession, d: str) -> DataFrame:
    """Events as lines of a user's page, an hour a point high; each fourth is a label in the margin."""
    lines = table(spark, d, "events").select(
        F.col("user_id").alias("path"), F.lit(1).alias("page"), F.col("event_id").alias("line_no"), F.col("event_id").cast("double").alias("left"),
        (F.unix_seconds(F.col("ts").cast("timestamp")) / 3600.0).alias("top"), F.col("event_type").alias("text"), (F.col("event_id") % 4 == 0).alias("is_label"),
    )
    return layout.label_anchors(lines).select(F.col("path").alias("user_id"), F.col("block").cast("long").alias("block"), F.col("at").cast("long").alias("place"))


def prediction_contract(spark: SparkSession, d: str) -> DataFrame:
    """Predictions made of labels, some of them broken; by the rule that each breaks first."""
    g = table(spark, d, "labels").withColumn("broken", F.col("doc_id") % 6)
    evidence = F.when(F.col("broken") == 1, F.array().cast("array<struct<page:int,text:string>>")).otherwise(F.array(F.struct(F.when(F.col("broken") != 2, 1).alias("page"), F.lit("t").alias("text"))))
    metrics = F.struct(F.when(F.col("broken") == 3, -1).otherwise(1).alias("input_tokens"), F.lit(2).alias("output_tokens"), F.lit(0.5).alias("inference_time_ms"))
    name = F.when(F.col("broken") == 4, "no such name").when(F.col("quality") == 0, "neutral").otherwise("entailment")
    body = F.struct(F.when(F.col("broken") != 5, F.col("doc_id")).alias("id"), F.when(F.col("quality") == 0, 1).otherwise(0).alias("label"), name.alias("label_name"), evidence.alias("evidence"), metrics.alias("metrics"))
    rows = g.select(F.col("doc_id").cast("string").alias("id"), F.lit("BIGINT").alias("id_kind"), F.lit("A").alias("task"), F.to_json(body, {"ignoreNullFields": "false"}).alias("raw"))
    return predictions.checked(rows).groupBy(F.coalesce("error", F.lit("ok")).alias("error")).agg(F.count("*").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    each = (score_languages, score_issues, api_seconds, label_blocks, top_pages, filler_pages, request_contract, crawl_manifest, usage, first_evidence, parsed_answers, first_quotes, label_places, prediction_contract, task_report, language_pairs, response_issues, confusion, hyphen_breaks)
    return {f.__name__: f for f in each}


_SCORED = """gold AS (SELECT doc_id AS id, CASE WHEN quality = 0 THEN 1 WHEN toxic = 1 THEN 2 ELSE 0 END AS label FROM labels),
  docs AS (SELECT doc_id AS id, lang, CAST(n_chars % 4 AS INTEGER) AS p FROM documents),
  pred AS (SELECT id, p FROM docs UNION ALL SELECT id, p FROM docs WHERE id % 11 = 0),
  known AS (SELECT id, count(*) AS n, min(p) AS p FROM pred GROUP BY id)"""


_EVALUATED = """e AS (SELECT d.doc_id, text, n_chars, p, ['A', 'B', 'C'][CAST(d.doc_id % 3 AS INTEGER) + 1] AS task, CASE WHEN quality = 0 THEN 1 WHEN toxic = 1 THEN 2 ELSE 0 END AS label, d.doc_id % 11 <> 0 AS once,
  CASE WHEN d.doc_id % 11 = 0 OR p = 3 OR d.doc_id % 13 = 0 THEN -1 ELSE p END AS pred,
  CASE WHEN d.doc_id % 4 <> 0 AND d.doc_id % 3 < 2 THEN CASE WHEN d.doc_id % 3 = 0 THEN 'A ' ELSE 'B ' END || coalesce(lang, '?') || '->' || CASE WHEN d.doc_id % 2 = 0 THEN 'fr' ELSE '?' END END AS pair
  FROM labels JOIN (SELECT *, CAST(n_chars % 4 AS INTEGER) AS p FROM documents) d USING (doc_id))"""
_F1 = """s AS (SELECT {by}, c, sum(CASE WHEN label = c AND pred = c THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN pred = c THEN 1 ELSE 0 END) AS np, sum(CASE WHEN label = c THEN 1 ELSE 0 END) AS ng FROM e, (VALUES (0), (1), (2)) t(c) GROUP BY {by}, c),
  f AS (SELECT {by}, round(avg(CASE WHEN np + ng > 0 THEN 2.0 * tp / (np + ng) END), 9) AS macro_f1, CAST(sum(ng) AS BIGINT) AS cases FROM s GROUP BY {by})"""


def oracle_sql() -> dict[str, str]:
    return {
        "score_languages": f"""WITH {_SCORED},
  pairs AS (SELECT lang, label, CASE WHEN n = 1 AND k.p < 3 THEN k.p ELSE -1 END AS pred FROM gold JOIN docs USING (id) LEFT JOIN known k USING (id)),
  cells AS (SELECT lang, c, sum(CASE WHEN label = c AND pred = c THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN pred = c THEN 1 ELSE 0 END) AS np, sum(CASE WHEN label = c THEN 1 ELSE 0 END) AS ng FROM pairs, (VALUES (0), (1), (2)) t(c) GROUP BY lang, c)
SELECT lang, round(avg(CASE WHEN np + ng > 0 THEN 2.0 * tp / (np + ng) END), 9) AS macro_f1, CAST(sum(ng) AS BIGINT) AS cases FROM cells GROUP BY lang""",
        "score_issues": f"""WITH {_SCORED}, j AS (SELECT g.id, n, p FROM gold g LEFT JOIN known k USING (id)),
  u AS (SELECT 'unknown id' AS issue, n FROM known WHERE id NOT IN (SELECT id FROM gold) UNION ALL SELECT 'duplicate id', n - 1 FROM j WHERE n > 1
  UNION ALL SELECT 'missing or duplicate response', 1 FROM j WHERE n IS NULL OR n > 1 UNION ALL SELECT 'invalid label', 1 FROM j WHERE n = 1 AND p NOT IN (0, 1, 2))
SELECT issue, CAST(sum(n) AS BIGINT) AS n FROM u GROUP BY issue""",
        "api_seconds": """WITH s AS (SELECT user_id, epoch_us(ts) AS a, epoch_us(ts) + CAST(floor(abs(value)) AS BIGINT) * 1000000 AS b FROM events),
  w AS (SELECT user_id, a, b, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s)
SELECT user_id, CAST(sum(greatest(0, b - greatest(a, coalesce(m, a)))) AS BIGINT) // 1000 AS open_ms FROM w GROUP BY user_id""",
        "label_blocks": """WITH r AS (SELECT DISTINCT user_id, epoch_us(ts) // 1000000 AS top FROM events),
  g AS (SELECT user_id, CASE WHEN lag(top) OVER (PARTITION BY user_id ORDER BY top DESC) - top >= 3600 THEN 1 ELSE 0 END AS o FROM r)
SELECT user_id, CAST(sum(o) + 1 AS BIGINT) AS blocks, count(*) AS lines FROM g GROUP BY user_id""",
        "top_pages": """WITH c AS (SELECT vec_id AS request, label, embedding AS cv FROM embeddings WHERE vec_id % 100 = 0),
  s AS (SELECT request, vec_id AS page, list_dot_product(cv::DOUBLE[], embedding::DOUBLE[]) AS score FROM c JOIN embeddings USING (label)),
  r AS (SELECT request, page, score, row_number() OVER (PARTITION BY request ORDER BY score DESC, page) AS rank FROM s)
SELECT request, page, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= 5""",
        "filler_pages": r"""WITH p AS (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffe}\x{feff}]', '', 'g') AS page FROM documents),
  f AS (SELECT doc_id, page, length(regexp_replace(regexp_replace(page, '^\s*\d{1,3}\s*', ''), '^\s+|\s+$', '', 'g')) < 50 AS filler FROM p)
SELECT doc_id, count(*) AS pages, count_if(filler) AS filler, CAST(coalesce(sum(CASE WHEN NOT filler THEN length(page) END), 0) AS BIGINT) AS chars FROM f GROUP BY doc_id""",
        "request_contract": """SELECT CASE WHEN conv_id % 7 = 0 THEN 'vote is missing' WHEN coalesce(trim(text), '') = '' THEN 'claim.text' WHEN turn % 4 = 3 THEN 'claim.language' ELSE 'ok' END AS error, count(*) AS n FROM conversations GROUP BY 1""",
        "crawl_manifest": r"""WITH p AS (SELECT trim(url) AS url, page_id, ['de', 'fr', 'it'][CAST(page_id % 3 AS INTEGER) + 1] AS lang FROM pages WHERE regexp_matches(trim(url), '^(?i)https?://([^/?#@]*@)?[^/?#:@]+')),
  n AS (SELECT url, regexp_replace(regexp_replace(url_decode(replace(regexp_replace(regexp_extract(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '([^/]*)$', 1), '(.)\.[^.]*$', '\1'), '+', '%2B')), '[^a-zA-Z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') AS stem, page_id, lang FROM p)
SELECT url, 'pdf/' || CASE WHEN any_value(stem) = '' THEN 'booklet' ELSE left(any_value(stem), 100) END || '__' || sha256(url) || '.pdf' AS path, array_to_string(list_sort(list(DISTINCT lang)), ',') AS languages,
  array_to_string(list_transform(list_sort(list(page_id)), lambda x: CAST(x AS VARCHAR)), ',') AS named_by FROM n GROUP BY url""",
        "usage": f"""WITH {_EVALUATED} SELECT m AS metric, round(sum(v) / (SELECT count(*) FROM e), 6) AS mean FROM (SELECT 'input_tokens' AS m, CASE WHEN once AND doc_id % 7 <> 0 THEN n_chars ELSE 0 END AS v FROM e UNION ALL
  SELECT 'output_tokens', CASE WHEN once AND doc_id % 5 <> 0 THEN 2 ELSE 0 END FROM e UNION ALL SELECT 'inference_time_ms', CASE WHEN once THEN (doc_id % 100) / 2.0 ELSE 0 END FROM e) GROUP BY m""",
        "task_report": f"""WITH {_EVALUATED}, {_F1.format(by="task")},
  q AS (SELECT count(*) AS evidence_cases, count_if(once AND doc_id % 2 = 0 AND regexp_matches(substring(text, 11, 40), '\\S')) AS found FROM e WHERE task = 'A' AND label <> 1)
SELECT e.task, count(*) AS cases, any_value(f.macro_f1) AS macro_f1, round(avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END), 9) AS accuracy, CASE e.task WHEN 'A' THEN 0.6 WHEN 'B' THEN 0.7 END::DOUBLE AS threshold,
  any_value(f.macro_f1) >= CASE e.task WHEN 'A' THEN 0.6 WHEN 'B' THEN 0.7 END::DOUBLE AS passes, CASE WHEN e.task = 'A' THEN (SELECT evidence_cases FROM q) END AS evidence_cases,
  CASE WHEN e.task = 'A' THEN (SELECT found FROM q) END AS found, CASE WHEN e.task = 'A' THEN (SELECT round(found / evidence_cases, 9) FROM q) END AS evidence_score FROM e JOIN f USING (task) GROUP BY e.task""",
        "language_pairs": f"""WITH {_EVALUATED}, {_F1.format(by="pair")} SELECT pair, macro_f1, cases FROM f WHERE pair IS NOT NULL""",
        "response_issues": f"""WITH {_EVALUATED}, u AS (SELECT 'missing or duplicate response' AS issue, count_if(NOT once) AS n FROM e UNION ALL SELECT 'invalid label', count_if(once AND p = 3) FROM e
  UNION ALL SELECT 'label_name does not match label', count_if(once AND p < 3 AND doc_id % 13 = 0) FROM e UNION ALL SELECT 'invalid metrics.input_tokens (does not affect the score)', count_if(once AND doc_id % 7 = 0) FROM e
  UNION ALL SELECT 'invalid metrics.output_tokens (does not affect the score)', count_if(once AND doc_id % 5 = 0) FROM e UNION ALL SELECT 'duplicate id', count_if(NOT once) FROM e
  UNION ALL SELECT 'unknown id', sum(CASE WHEN doc_id % 11 = 0 THEN 2 ELSE 1 END) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) SELECT issue, CAST(n AS BIGINT) AS n FROM u WHERE n > 0""",
        "confusion": f"""WITH {_EVALUATED}, g AS (SELECT task, l AS label, p AS pred FROM (SELECT DISTINCT task FROM e), (VALUES (0), (1), (2)) x(l), (VALUES (0), (1), (2)) y(p))
SELECT task, g.label, g.pred, count(e.doc_id) AS n FROM g LEFT JOIN e USING (task, label, pred) GROUP BY ALL""",
        "hyphen_breaks": r"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN rtrim(left(text, 10)) ELSE left(text, 10) END || CASE WHEN doc_id % 2 = 0 THEN ltrim(substring(text, 11, 20)) ELSE ltrim(substring(text, 11, 20)) END || '-' || chr(10) || chr(10) || 'end' || chr(10) AS joined
FROM documents WHERE regexp_matches(text, '^[A-Za-z0-9., ]{30}')""",
        "first_evidence": """WITH l AS (SELECT doc_id AS request, string_split(text, chr(10)) AS t FROM documents), p AS (SELECT request, unnest(t) AS text, CAST(unnest(range(len(t))) AS INTEGER) AS page FROM l),
  u AS (SELECT request, page, text, 0 AS kind FROM p WHERE length(text) >= 200 UNION ALL SELECT request, page, text, 1 FROM p WHERE length(text) < 200),
  r AS (SELECT request, page, text, row_number() OVER (PARTITION BY request ORDER BY kind, page) AS place FROM u)
SELECT request, page, CAST(place AS INTEGER) AS place, length(text) AS chars FROM r WHERE place <= 5""",
        "parsed_answers": r"""SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR n_chars % 4 IN (1, 3) THEN 'NEUTRAL' WHEN n_chars % 4 = 0 THEN 'ENTAILMENT' ELSE 'CONTRADICTION' END AS label,
  CAST(n_chars % 4 <> 3 AND regexp_matches(coalesce(left(text, 20), ''), '\S') AS BIGINT) AS citations, n_chars % 4 = 3 AS faulty FROM documents""",
        "label_places": """WITH l AS (SELECT user_id, event_id, CAST(epoch_us(ts) // 1000000 AS DOUBLE) / 3600 AS top, event_id % 4 = 0 AS is_label FROM events),
  o AS (SELECT user_id, top, CASE WHEN lag(top) OVER (PARTITION BY user_id ORDER BY top DESC) - top >= 16 THEN 1 ELSE 0 END AS opens FROM l WHERE is_label),
  b AS (SELECT user_id, top, sum(opens) OVER (PARTITION BY user_id ORDER BY top DESC) AS block FROM o), a AS (SELECT user_id, block, max(top) + 14 AS y FROM b GROUP BY user_id, block),
  m AS (SELECT user_id, top, row_number() OVER (PARTITION BY user_id ORDER BY round_even(top, 0) DESC, event_id) AS pos FROM l WHERE NOT is_label)
SELECT a.user_id, CAST(block AS BIGINT) AS block, min(pos) AS place FROM a LEFT JOIN m ON m.user_id = a.user_id AND m.top <= a.y GROUP BY a.user_id, block""",
        "prediction_contract": """SELECT CASE WHEN doc_id % 6 = 5 THEN 'id' WHEN doc_id % 6 = 4 THEN 'label_name' WHEN doc_id % 6 = 1 AND quality <> 0 THEN 'evidence is missing' WHEN doc_id % 6 = 2 THEN 'evidence.page'
  WHEN doc_id % 6 = 3 THEN 'metrics.input_tokens' ELSE 'ok' END AS error, count(*) AS n FROM labels GROUP BY 1""",
    }
