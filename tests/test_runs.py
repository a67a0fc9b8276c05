"""The prediction run, page scan, retrieval build, evaluator, crawl and settings on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from factgrid import settings
from factgrid.operators import crawl, evaluate, retrieval
from factgrid.plans import run, scorecard
from factgrid.sources import pages, requests

TEXT = {"text": "Die Gemeinde baut 2025 eine Schule im Dorf.", "language": "de"}


def request(ident, **kw):
    return {"id": ident, "vote": {"title": "Schule"}, "claim": TEXT} | (kw or {"reference": TEXT})


def written(spark, path):
    return [json.loads(r["value"]) for r in spark.read.text(path).orderBy(F.col("_metadata.file_path")).collect()]


@pytest.fixture
def source(tmp_path):
    lines = [request("7"), request(7), "", request("ü", booklet={"path": "b.pdf", "language": "fr"})]
    (tmp_path / "in.jsonl").write_text("".join((json.dumps(x) if x else "") + "\n" for x in lines))
    return str(tmp_path / "in.jsonl")


def test_neutral_run(spark, source, tmp_path):
    assert run.run(spark, source, str(tmp_path / "out"), run.Neutral()) == 3
    got = written(spark, str(tmp_path / "out"))
    assert [x["id"] for x in got] == ["7", 7, "ü"] and all(x["label"] == 1 and x["evidence"] == [] and x["metrics"] == {"input_tokens": 0, "output_tokens": 0, "inference_time_ms": 0} for x in got)
    with pytest.raises(ValueError, match="must not be the input"):
        run.run(spark, source, source, run.Neutral())


def test_run_leaves_nothing_behind(spark, source, tmp_path):
    class Broken(run.Neutral):
        def predict(self, requests):
            return super().predict(requests).withColumn("label_name", F.lit("maybe"))

    with pytest.raises(ValueError, match="line 1: label_name"):
        run.run(spark, source, str(tmp_path / "none"), Broken())
    assert not (tmp_path / "none").exists()


def test_run_from_answers(spark, source, tmp_path):
    said = lambda label, quote: json.dumps({"label": label, "citations": [{"chunk": 0, "quote": quote}]})
    answers = [(1, said("entailment", "baut 2025 eine Schule"), 30, 5, 12.5), (2, "no JSON", 20, 4, 1.0)]
    answered = spark.createDataFrame(answers, "line_no long, answer string, input_tokens long, output_tokens long, api_time_ms double")
    booklet = spark.createDataFrame([("b.pdf", 3, "Seite drei")], "path string, page int, text string")
    assert run.run(spark, source, str(tmp_path / "out"), run.FromAnswers(answered, booklet)) == 3
    one, two, three = written(spark, str(tmp_path / "out"))
    assert one["label"] == 0 and one["evidence"] == [{"page": None, "text": "baut 2025 eine Schule"}] and one["metrics"] == {"input_tokens": 30, "output_tokens": 5, "inference_time_ms": 12}
    assert (two["label"], two["metrics"]["input_tokens"]) == (1, 20) and (three["label"], three["metrics"]["output_tokens"]) == (1, 0)


def test_retrieval(spark):
    texts = ["Wasser und Berge", "Steuern und Abgaben", "Schulen im Dorf", "Strom aus Wind"]
    leaf = spark.createDataFrame([("b", k + 1, t) for k, t in enumerate(texts)], "path string, page int, text string")
    rows = [(1, "A", "b", None, "neue Schulen im Dorf", "Dorf"), (2, "A", "b", None, "Steuern senken", None), (3, "B", None, "eine Passage", "x", None), (4, "A", "b", None, "Steuern senken", None)]
    asked = spark.createDataFrame(rows, "line_no long, task string, booklet_path string, reference_text string, claim string, vote string")
    loads = []
    vectors, claims = retrieval.page_vectors(leaf, retrieval.hashed_ngrams), retrieval.claim_vectors(asked, retrieval.hashed_ngrams)
    assert not loads and vectors.select(F.max(F.abs(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x) - 1))).first()[0] < 1e-5 and claims.count() == 4
    chunks, found = retrieval.chunks(asked, leaf, vectors, claims, k=2)
    best = {(r["request"], r["rank"]): r["page"] for r in found.collect()}
    assert (best[1, 1], best[2, 1], best[4, 1]) == (3, 2, 2) and len(best) == 6
    got = sorted((r["request"], r["chunk"], r["page"]) for r in chunks.collect())
    assert len(got) == 7 and (3, 0, None) in got and all(p < q for (a, _, p), (b, _, q) in zip(got, got[1:]) if a == b)
    whole, none = retrieval.chunks(asked, leaf)
    assert none is None and whole.where("request = 1").count() == 4


def test_pages(spark):
    filler = "Ein ganzer Satz, der lang genug ist, um als Beleg zu zählen, ja sicher."

    def extract(content):
        if content == b"bad":
            raise ValueError("no PDF")
        for page, part in enumerate(content.decode().split("|"), 1):
            for k, line in enumerate(part.split("\n")):
                yield page, k, 200.0, 700.0 - 20 * k, 500.0, line, "form" in line

    again = lambda content, wanted: [(p, "Der zweite Leser findet mehr: " + filler * 4) for p in wanted]
    files = spark.createDataFrame([("a", bytearray(f"{filler}|12|form {filler}".encode())), ("b", bytearray(b"bad")), ("c", bytearray(b"9"))], "path string, content binary")
    got = {(r["path"], r["page"]): (r["text"], r["error"]) for r in pages.pages(files, extract, again).collect()}
    assert set(got) == {("a", 1), ("a", 3), ("b", None), ("c", None)}
    assert got["a", 1][0] == filler + "\n" and got["a", 3][0].startswith("Der zweite") and got["b", None][1] == "ValueError: no PDF" and got["c", None][1] == "no extractable text"
    lines = spark.createDataFrame([("a", 1, 0, "ab"), ("a", 1, 1, "  c"), ("a", 1, 2, "d")], "path string, page int, line_no int, text string")
    assert [r["offset"] for r in pages.offsets(lines).orderBy("line_no").collect()] == [0, 6, 9]


def test_evaluator(spark):
    """Small enough to count by hand: of four A cases one is right, one missing, one twice, one neutral; no evidence score while a passage is missing."""
    say = lambda i, label, name, **kw: (i, json.dumps({"label": label, "label_name": name, "evidence": [{"page": 1, "text": "goldene Passage"}], "metrics": {"input_tokens": 8, "output_tokens": True, "inference_time_ms": 4.5}} | kw))
    expected = spark.createDataFrame([("1-A", 0, "die goldene Passage hier"), ("2-A", 2, None), ("3-A", 0, "x"), ("4-A", 1, None), ("5-B", 2, None)], "id string, label int, reference string")
    predictions = spark.createDataFrame([say("1-A", 0, "entailment"), say("3-A", 0, "entailment"), say("3-A", 0, "entailment"), say("4-A", 1, "neutral"), say("5-B", 2, "neutral"), say("9", 0, "entailment")], "id string, raw string")
    rows = evaluate.paired(expected, predictions)
    by = {r["task"]: r for r in evaluate.tasks(rows).collect()}
    assert (by["A"]["cases"], by["A"]["accuracy"], by["A"]["evidence_cases"], by["A"]["found"], by["A"]["evidence_score"]) == (4, 0.5, 3, 1, None)
    assert by["A"]["macro_f1"] == pytest.approx((2 / 3 + 1 + 0) / 3) and by["A"]["passes"] is False and by["B"]["macro_f1"] == 0
    assert {r["metric"]: r["mean"] for r in evaluate.usage(rows).collect()} == {"input_tokens": 24 / 5, "output_tokens": 0, "inference_time_ms": 13.5 / 5}
    assert {r["issue"]: r["n"] for r in evaluate.issues(rows, predictions).collect()} == {
        "missing or duplicate response": 2, "label_name does not match label": 1, "invalid metrics.output_tokens (does not affect the score)": 3, "unknown id": 1, "duplicate id": 1,
    }
    full = scorecard.report(rows, predictions)
    assert full["cases"] == 5 and full["responses"] == 4 and sorted(full["tasks"]) == ["A", "B"] and full["languages"] == {}


def test_evaluate_files(spark, tmp_path):
    """From files to a report and a scorecard: repeated keys, NaN, blank lines, a note where passages are missing, and limits for quotes."""
    quote = "Die Gemeinde baut eine Schule"
    gold = [{"id": "1-A", "label": 0, "reference": f"{quote} im Dorf."}, {"id": "2-A", "label": 2, "reference": "anders"}, {"id": "3-B", "label": 1}, {"id": "3-B", "label": 2}]
    known = [{"id": "1-A", "claim": {"language": "fr"}, "booklet": {"language": "de"}}, {"id": "3-B", "claim": {}, "reference": {"text": "x"}}]
    said = ['{"id": "1-A", "label": 7, "label": 0, "label_name": "entailment", "evidence": [{"text": "%s"}], "metrics": {"input_tokens": NaN, "output_tokens": 4, "inference_time_ms": 1.5}}' % quote.replace("baut", "baud"), "", '{"id": "3-B", "label": 2, "label_name": "contradiction", "metrics": []}']
    for name, lines in (("gold", map(json.dumps, gold)), ("known", map(json.dumps, known)), ("said", said)):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    f = lambda **kw: scorecard.evaluate_files(spark, *(str(tmp_path / n) for n in ("said", "gold", "known")), **kw)
    full = f(target=str(tmp_path / "out/report.json"))
    assert json.loads((tmp_path / "out/report.json").read_text()) == full
    a, b = full["tasks"]["A"], full["tasks"]["B"]
    assert (full["cases"], full["responses"], a["cases"], a["accuracy"], a["passes_threshold"], a["evidence"], a["evidence_score"]) == (3, 2, 2, 0.5, False, {"cases": 2, "found": 1, "without_gold_passage": 0}, 0.5)
    assert b["macro_f1"] == 1 and b["mean_f1"] == pytest.approx(1 / 3) and b["per_class"]["contradiction"] == {"precision": 1, "recall": 1, "f1": 1, "support": 1} and b["passes_threshold"] is True
    assert full["languages"] == {"A de->fr": {"cases": 1, "macro_f1": 1.0}, "B ?->?": {"cases": 1, "macro_f1": 1.0}}
    assert full["issues"] == {"invalid metrics.input_tokens (does not affect the score)": 2, "invalid metrics.inference_time_ms (does not affect the score)": 1, "invalid metrics.output_tokens (does not affect the score)": 1, "missing or duplicate response": 1}
    assert f(min_score=99)["tasks"]["A"]["evidence"]["found"] == f(max_chars=10)["tasks"]["A"]["evidence"]["found"] == 0
    (tmp_path / "gold").write_text(json.dumps(gold[0] | {"reference": None}) + "\n")
    text = scorecard.scorecard(f())
    assert "no gold passage" in text and "BELOW" not in text and "invalid metrics.input_tokens" in text
    (tmp_path / "said").write_text("[1]\n")
    with pytest.raises(Exception, match="not a JSON object"):
        f()


def test_json_as_python_reads_it(spark):
    """Ids of any length, the last of repeated keys, NaN beside, votes without a title in their own order; 7.0 and 1e3 are no whole numbers."""
    line = lambda i, vote='"v"', more="": '{"id": %s, "vote": %s, "claim": {"text": "c", "language": "de"}, "reference": {"text": "r", "language": "fr"}%s}' % (i, vote, more)
    big, huge = str(2**70), str(3**200)
    raw = [line(big), line(huge), line("7.0"), line("1e3"), line("5", more=', "x": NaN'), line("1", more=', "id": "2"'), line("3", '{"z": 1, "a": {"y": "ü", "b": []}}'), line("4", '{"title": "", "name": "n"}'), line("6", "null"), line("8", more=', "vote": '), line("true")]
    got = [r for r in requests.checked(spark.createDataFrame(list(enumerate(raw)), "line_no long, raw string")).orderBy("line_no").collect()]
    assert [(r["id"], r["id_kind"], r["id_json"]) for r in got[:2]] == [(big, "BIGINT", big), (huge, "BIGINT", huge)]
    assert [r["error"] for r in got] == [None, None, *["id must be a non-empty string or an integer"] * 2, None, None, None, None, None, "not JSON", "id must be a non-empty string or an integer"]
    assert (got[5]["id"], got[5]["id_kind"], got[5]["id_json"]) == ("2", "STRING", '"2"')
    assert [got[i]["vote_title"] for i in (4, 6, 7, 8)] == ["v", '{"z": 1, "a": {"y": "ü", "b": []}}', "n", None]


def test_long_ids_run(spark, tmp_path):
    ids = [2**70, 3**200, "7", 7]
    (tmp_path / "in.jsonl").write_text("".join(json.dumps(request(i)) + "\n" for i in ids))
    assert run.run(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "out"), run.Neutral()) == 4
    assert [x["id"] for x in written(spark, str(tmp_path / "out"))] == ids


def test_crawl(spark):
    given = [(1, " https://x.ch/a.pdf ", "de"), (2, "https://x.ch/a.pdf", "fr"), (3, "https://x.ch/a.pdf", None), (4, "ftp://x.ch/a", "de"), (5, " ", "de"), (6, None, "de"), (7, "https:///a.pdf", "de"), (8, "http://y.ch", "it")]
    got = {r["url"]: r for r in crawl.manifest(spark.createDataFrame(given, "reference int, url string, language string")).collect()}
    assert set(got) == {"https://x.ch/a.pdf", "http://y.ch"} and got["https://x.ch/a.pdf"]["languages"] == ["de", "fr"] and got["https://x.ch/a.pdf"]["references"] == [1, 2, 3]
    wanted = spark.createDataFrame([(u,) for u in "abcde"], "url string")
    fetched = spark.createDataFrame([("b", bytearray(b"%PDF-1"), None), ("c", bytearray(b"<html>"), None), ("d", None, "timeout")], "url string, content binary, error string")
    entries = crawl.statuses(wanted, spark.createDataFrame([("a", True), ("b", False)], "url string, reuse boolean"), fetched)
    assert {r["url"]: (r["status"], r["error"]) for r in entries.collect()} == {"a": ("cached", None), "b": ("downloaded", None), "c": ("error", "no PDF header"), "d": ("error", "timeout"), "e": ("pending", None)}
    assert {r["status"]: r["n"] for r in crawl.failures(entries).collect()}["error"] == 2


def test_settings():
    key = {"API_KEY": "k"}
    assert settings.settings(key | {"MODEL": "m"}) == settings.Settings("k", "m", 5, False, 4)
    names = settings.Names(key=("A", "B"), model=("N",), model_family="maker/x-", model_default="maker/x-1", top_k="K", full_document="FULL", batch_size="BATCH")
    assert settings.settings({"B": "k", "K": "8", "FULL": "1"}, names) == settings.Settings("k", "maker/x-1", 8, True, 4)
    for env in ({}, {"A": " ", "B": "k"}, {"A": "k", "N": "other/model"}, {"A": "k", "N": "maker/x- "}, {"A": "k", "K": "0"}, {"A": "k", "BATCH": "x"}):
        with pytest.raises(ValueError):
            settings.settings(env, names)
    with pytest.raises(ValueError, match="MODEL"):
        settings.settings(key)


def test_request_values(spark, source):
    """Ids keep their kind on the way through."""
    assert [r[0] for r in requests.read_requests(spark, source).orderBy("line_no").select("id_json").collect()] == ['"7"', "7", '"ü"']
