"""Experiments on single claims with a model that isn't one."""

import json

from pyspark.sql import functions as F

from factgrid.plans import experiment

TEXT = "Die Gemeinde baut 2025 eine Schule im Dorf."


class Model:
    model = "fake"

    def complete(self, system, user, max_tokens):
        told = json.loads(user)
        if "garbled" in told["claim"]:
            return {"text": "no label here", "input_tokens": 7, "output_tokens": 1}
        label = {"yes": "ENTAILMENT", "no": "CONTRADICTION"}.get(told["claim"], "NEUTRAL")
        return {"text": json.dumps({"label": label, "citations": [{"chunk": len(told["chunks"]) - 1, "quote": TEXT[:12]}]}), "input_tokens": 10, "output_tokens": 2}


def test_experiment(spark, tmp_path):
    """Chunks as texts and objects; ids and their stand-ins; scores only if all gold labels are there; equal payloads cost as often as they are asked."""
    long = {"text": TEXT, "page": 4, "id": "p1"}
    cases = [{"id": 5, "claim": "yes", "chunks": [TEXT], "label": 0}, {"claim": "no", "chunks": ["x", long], "label": 0}, {"id": "g", "claim": "garbled", "chunks": [long | {"paragraph": None}], "label": 1}, {"claim": " ", "chunks": [TEXT], "label": 1}, {"id": 5, "claim": "yes", "chunks": [TEXT], "label": 0}]
    (tmp_path / "cases.jsonl").write_text("\n".join(json.dumps(c) + "\n" for c in cases))
    read = experiment.read_cases(spark, str(tmp_path / "cases.jsonl"))
    chunks = {(r["request"], r["chunk"]): (r["page"], r["paragraph"], r["text"]) for r in experiment.chunks_of(read).collect()}
    assert chunks[0, 0] == (None, None, TEXT) and chunks[1, 1] == (4, "p1", TEXT) and chunks[2, 0] == (4, None, TEXT)
    done = experiment.classified(read, Model, "fake", str(tmp_path / "log")).persist()
    experiment.write_judged(done, str(tmp_path / "out"))
    got = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).orderBy(F.col("_metadata.file_path")).collect()]
    assert [(g["id"], g["label"], g["label_name"], g["metrics"]["input_tokens"]) for g in got] == [("5", 0, "entailment", 10), ("1", 2, "contradiction", 10), ("g", 1, "neutral", 7), ("3", 1, "neutral", 0), ("5", 0, "entailment", 10)]
    assert got[1]["evidence"] == [{"page": 4, "text": "Die Gemeinde"}] and got[0]["evidence"][0]["page"] is None and all(g["metrics"]["inference_time_ms"] >= 0 for g in got)
    m = experiment.metrics(done)
    assert (m["n"], m["accuracy"], m["confusion"], m["input_tokens"], m["output_tokens"]) == (5, 0.8, [[2, 0, 1], [0, 2, 0], [0, 0, 0]], 37, 7)
    assert m["f1"] == {"entailment": 0.8, "neutral": 1.0, "contradiction": 0.0} and abs(m["macro_f1"] - 0.6) < 1e-12
    assert experiment.metrics(done.withColumn("label", F.when(F.col("row") > 0, F.col("label")))) is None
    one = experiment.classified(experiment.inline(spark, "no", ["x", long]), Model, "fake", str(tmp_path / "log")).collect()
    assert [(r["id"], r["label_pred"], r["error"]) for r in one] == [("0", 2, None)]
    assert {r["error"] for r in done.collect()} >= {None, "no claim or no chunks"}


def test_experiment_log(spark, tmp_path):
    for k in range(2):
        experiment.log_experiment(str(tmp_path / "log"), "run", {"macro_f1": 0.5 + k}, "ü", experiment.commit_of(str(tmp_path)), model="fake")
    got = spark.read.json(str(tmp_path / "log")).orderBy("metrics.macro_f1").collect()
    assert [(r["metrics"]["macro_f1"], r["name"], r["note"], r["model"]) for r in got] == [(0.5, "run", "ü", "fake"), (1.5, "run", "ü", "fake")]
