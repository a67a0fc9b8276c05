"""Answers, quotes, layout and the whole plan on small cases."""

import json

from pyspark.sql import functions as F

from factgrid.operators import answers, layout, quotes
from factgrid.plans import predict


def answer(**kw):
    return json.dumps({"claim_says": "c", "passage_says": "p", "label": "NEUTRAL", "citations": []} | kw)


def test_parsed(spark):
    cite = [{"chunk": "1", "quote": "one two three"}, {"evidence_id": 2, "quote": "four"}, {"chunk": None, "evidence_id": 2, "quote": "x"}, {"chunk": 1, "quote": " "}, {"chunk": 1, "quote": 5}, "no"]
    rows = [
        (1, answer(label="entail"), "ENTAILMENT", 0, None), (2, "```json\n" + answer(subject_addressed=False, label="ENTAILMENT") + "\n```", "NEUTRAL", 0, None),
        (3, "so {x} " + answer(same_meaning="false", citations=cite) + " done {", "CONTRADICTION", 2, None), (4, 'cut: {"label": "contradict', "CONTRADICTION", 0, None),
        (5, "nothing", "NEUTRAL", 0, "no label in the answer"), (6, None, "NEUTRAL", 0, "no label in the answer"), (7, '{"a": {"label": "entailment", "same_meaning": null}}', "ENTAILMENT", 0, None),
        (8, '{"label": "neutral", "claim_says": "a\nb", "citations": 3}', "NEUTRAL", 0, None),
    ]
    got = answers.parsed(spark.createDataFrame(rows, "request int, answer string, want string, n int, fault string")).collect()
    assert len(got) == len(rows) and all((r["label"], len(r["citations"]), r["parse_error"]) == (r["want"], r["n"], r["fault"]) for r in got)
    assert [tuple(c) for r in got if r["request"] == 3 for c in r["citations"]] == [(1, "one two three"), (2, "four")]


CHUNKS = [(1, 0, 3, "Der Bund zahlt nichts."), (1, 1, 7, "Die Kantone tragen die Kosten allein."), (1, 2, 9, "Die Kantone tragen die Kosten."), (2, 0, None, "Un autre texte entier.")]


def test_first_hits(spark):
    chunks = spark.createDataFrame(CHUNKS, "request int, chunk int, page int, text string")
    cited = [(1, 0, 1, "Kantone tragen die Kost"), (1, 1, 0, "Kantone tragen"), (1, 2, 2, "Die Kantone trugen die Kosten"), (1, 3, 9, "völlig anderes Zitat hier"), (1, 4, 0, "kurz"), (2, 0, 5, "autre texte")]
    got = quotes.first_hits(spark.createDataFrame(cited, "request int, place int, chunk int, quote string"), chunks).collect()
    found = {(r["request"], r["place"]): (r["chunk"], r["quote"]) for r in got}
    assert found == {(1, 0): (1, "Kantone tragen die Kosten"), (1, 1): (1, "Kantone tragen"), (1, 2): (2, "Die Kantone tragen die Kosten"), (2, 0): (0, "autre texte")}


def test_best_chunks(spark):
    chunks = spark.createDataFrame(CHUNKS, "request int, chunk int, page int, text string")
    texts = spark.createDataFrame([(1, "die Kantone tragen Kosten"), (2, "kurz"), (2, None)], "request int, text string")
    assert {r["request"]: r["chunk"] for r in quotes.best_chunks(texts, chunks).collect()} == {1: 1, 2: 0}


def test_evidence_hits(spark):
    gold = spark.createDataFrame([("a", "Die Kan-\ntone tragen"), ("b", "ganz anders"), ("c", None)], "id string, passage string")
    cited = spark.createDataFrame([("a", "die  kantone tragen"), ("a", "nichts"), ("b", "Kosten"), ("b", "ganz anders" + " x" * 2600), ("c", "x")], "id string, quote string")
    assert {r["id"]: r["hit"] for r in quotes.evidence_hits(gold, cited).collect()} == {"a": True, "b": False, "c": False}


def test_predictions(spark):
    requests = spark.createDataFrame([(1, "c"), (2, "c"), (3, "c"), (4, "c")], "request int, claim string")
    chunks = spark.createDataFrame([*CHUNKS, (4, 0, 1, "Ein Satz ohne Zitat.")], "request int, chunk int, page int, text string")
    said = [(1, answer(label="entailment", citations=[{"chunk": 1, "quote": "Kantone tragen die Kosten"}])), (2, answer(citations=[{"chunk": 0, "quote": "autre texte"}])), (4, answer(label="contradiction"))]
    pages = spark.createDataFrame([(1, 7, 1, "seven"), (1, 3, 2, "three"), (2, 1, 1, "no")], "request int, page int, rank int, text string")
    got = {r["request"]: r for r in predict.predictions(requests, chunks, spark.createDataFrame(said, "request int, answer string"), pages).collect()}
    assert [(e["page"], e["text"]) for e in got[1]["evidence"]] == [(7, "Kantone tragen die Kosten"), (7, "seven"), (3, "three")]
    assert (got[1]["label"], got[1]["error"]) == (0, None)
    assert (got[2]["label"], [e["text"] for e in got[2]["evidence"]]) == (1, ["autre texte"])
    assert (got[3]["label_name"], got[3]["evidence"], got[3]["error"]) == ("neutral", [], "no answer")
    assert (got[4]["label"], [e["text"] for e in got[4]["evidence"]], got[4]["error"]) == (2, ["Ein Satz ohne Zitat."], "no quote was found")


def test_fallback_texts(spark):
    """The claim itself chooses no chunk: only the answer's quotes and passage do."""
    chunks = spark.createDataFrame([(1, 0, 1, "Der Rat spricht vom Passagentext des Bundes."), (1, 1, 2, "Die Behauptung steht hier Wort fuer Wort.")], "request int, chunk int, page int, text string")
    requests = spark.createDataFrame([(1, "Die Behauptung steht hier Wort fuer Wort.")], "request int, claim string")
    said = spark.createDataFrame([(1, answer(label="contradiction", passage_says="spricht vom Passagentext"))], "request int, answer string")
    assert [e["page"] for e in predict.predictions(requests, chunks, said).first()["evidence"]] == [1]


def test_prompts(spark):
    chunks = spark.createDataFrame([(1, 1, 2, None, "b"), (1, 0, None, "p", "a")], "request int, chunk int, page int, paragraph string, text string")
    got = predict.prompts(spark.createDataFrame([(1, "c", None)], "request int, claim string, vote string"), chunks).first()["payload"]
    assert json.loads(got) == {"vote": None, "claim": "c", "chunks": [{"chunk": 0, "page": None, "paragraph": "p", "text": "a"}, {"chunk": 1, "page": 2, "paragraph": None, "text": "b"}]}


def test_page_texts(spark):
    lines = [
        (0, 200.0, 700.0, "First paragraph begins"), (1, 200.0, 690.0, "and ends here."), (2, 50.0, 702.0, "Vor­"), (3, 50.0, 690.0, "lage"), (4, 200.0, 600.0, "Second one hyphen"),
        (5, 400.0, 603.0, "-"), (6, 50.0, 595.0, "Not a label."), (7, 50.0, 100.0, "Below all"),
    ]
    df = spark.createDataFrame([("p", 1, *x[:1], x[1], x[2], 500.0, x[3]) for x in lines], "path string, page int, line_no int, left double, top double, page_width double, text string")
    got = layout.page_texts(df).first()["text"].split("\n")
    assert got == ["Vorlage", "First paragraph begins", "and ends here.", "Second one hyphenNot a label.", "", "Below all", ""]
    asks = [("q", 1, 0, 60.0, 500.0, 500.0, "Was ist neu?"), ("q", 1, 1, 200.0, 498.0, 500.0, "Stimm\u00ad"), ("q", 1, 2, 200.0, 480.0, 500.0, "recht\u00a0"), ("q", 1, 3, 60.0, 300.0, 500.0, "Ziel:")]
    got = layout.page_texts(spark.createDataFrame(asks, "path string, page int, line_no int, left double, top double, page_width double, text string")).first()["text"]
    assert got == "Was ist neu?\nStimmrecht\nZiel:\n"
    assert layout.page_texts(df.where(F.lit(False))).count() == 0
