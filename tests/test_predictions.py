"""The prediction contract, sinks and the request stream on small cases."""

import hashlib
import time
import json

from factgrid.sources import predictions
from factgrid.streaming import requests

METRICS = {"input_tokens": 12, "output_tokens": 0, "inference_time_ms": 0.25}


def prediction(label=2, evidence=((4, "Absatz"),), name=None, **other):
    return {"id": "k-1", "label": label, "label_name": name or ("entailment", "neutral", "contradiction")[label], "evidence": [{"page": p, "text": t} for p, t in evidence], "metrics": METRICS} | other


#: By rule: what keeps it and what breaks it, in task A unless said.
RULES = {
    "id": [({"id": 1}, "A"), ({"id": None}, "A"), ({"id": "k-1 "}, "A")],
    "label": [({"label": v}, "A") for v in (-1, 7, "2", 2.0, False, None)],
    "label_name": [({"label_name": v}, "B") for v in ("neutral", "Contradiction", None)],
    "evidence": [({"evidence": v}, "A") for v in ({}, "Absatz", None, [{"page": k, "text": "x"} for k in range(1, 7)])],
    "evidence is missing": [({"evidence": []}, "A")],
    "evidence.page": [({"evidence": [{"page": v, "text": "x"}]}, "A") for v in (-3, 0, "4", True, None, 4.5)] + [({"evidence": [{"text": "x"}]}, "B"), ({"evidence": [{"page": 9, "text": "x"}]}, "B")],
    "evidence.text": [({"evidence": [{"page": 4, "text": v}]}, "A") for v in ("", "\n\t", 3, None, "a" * 5001)],
    "metrics.input_tokens": [({"metrics": METRICS | {"input_tokens": v}}, "A") for v in (-1, 1.0, "12", None, False)] + [({"metrics": {}}, "A")],
    "metrics.output_tokens": [({"metrics": METRICS | {"output_tokens": -2}}, "A")],
    "metrics.inference_time_ms": [({"metrics": METRICS | {"inference_time_ms": v}}, "A") for v in (-0.5, "1", None, True)],
}
KEPT = [(prediction(), "A"), (prediction(1, ()), "A"), (prediction(0, ()), "B"), (prediction(0, [(None, "🙂" * 5000)] * 5), "B"), (prediction(extra=1), "A"), (prediction(metrics=METRICS | {"inference_time_ms": 3, "cost": "x"}), "A")]


def test_contract(spark):
    cases = [(rule, json.dumps(prediction() | change), task) for rule, broken in RULES.items() for change, task in broken] + [(None, json.dumps(body), task) for body, task in KEPT] + [("not an object", raw, "A") for raw in ("[]", "{", "null")]
    df = spark.createDataFrame([(k, "k-1", "STRING", task, raw, rule) for k, (rule, raw, task) in enumerate(cases)], "k int, id string, id_kind string, task string, raw string, want string")
    got = predictions.checked(df).collect()
    assert len(got) == len(cases) and not [(r["raw"][:200], r["error"], r["want"]) for r in got if r["error"] != r["want"]]


def test_write_lines(spark, tmp_path):
    df = spark.createDataFrame([(2, None, "b"), (1, 5, "ä"), (3, 1, "c")], "line_no int, page int, text string")
    predictions.write_lines(df, str(tmp_path / "out"))
    lines = [x for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == ['{"page":5,"text":"ä"}', '{"page":null,"text":"b"}', '{"page":1,"text":"c"}']
    for _ in range(2):
        predictions.log_run(spark.createDataFrame([(0.5,)], "f1 double"), str(tmp_path / "log"), "run")
    assert spark.read.json(str(tmp_path / "log")).selectExpr("metrics.f1").collect() == [(0.5,), (0.5,)]


def test_reusable(spark):
    pdf, other = b"%PDF-1.7 x", b"<html>"
    digest = lambda b: hashlib.sha256(b).hexdigest()
    files = spark.createDataFrame([("a", bytearray(pdf)), ("b", bytearray(other)), ("c", bytearray(pdf))], "path string, content binary")
    manifest = spark.createDataFrame([("u1", "a", digest(pdf)), ("u2", "b", digest(other)), ("u3", "c", digest(other))], "url string, path string, sha256 string")
    got = predictions.reusable(spark.createDataFrame([("u1",), ("u2",), ("u3",), ("u4",)], "url string"), manifest, files)
    assert {r["url"]: r["reuse"] for r in got.collect()} == {"u1": True, "u2": False, "u3": False, "u4": False}


def test_stream(spark, tmp_path):
    line = '{"id": %s, "vote": null, "claim": {"text": "c", "language": "de"}, "reference": {"text": "r", "language": "it"}}'
    (tmp_path / "in").mkdir()
    args = str(tmp_path / "out"), str(tmp_path / "state")
    for name, ids in (("a", ("7", '"7"', "7", "true")), ("b", ("7", "8"))):
        (tmp_path / "in" / f"{name}.jsonl").write_text("\n".join(line % i for i in ids) + "\n\n")
        requests.keep(requests.first_of_id(requests.request_stream(spark, str(tmp_path / "in"))), *args).awaitTermination(120)
    assert sorted((r["id_kind"], r["id"]) for r in spark.read.parquet(args[0]).collect()) == [("BIGINT", "7"), ("BIGINT", "8"), ("STRING", "7")]


def test_stream_forgets(spark, tmp_path):
    """After its time an id is forgotten, so that it may come again; before, it may not, also not after a restart."""
    line = '{"id": %s, "vote": {"title": "t"}, "claim": {"text": "c", "language": "de"}, "reference": {"text": "r", "language": "it"}}'
    (tmp_path / "in").mkdir()
    for k, (ident, wait) in enumerate(((1, 0), (1, 0), (2, 0), (3, 4), (1, 4))):
        time.sleep(wait)
        (tmp_path / "in" / f"{k}.jsonl").write_text(line % ident)
        stream = requests.first_of_id(requests.request_stream(spark, str(tmp_path / "in")), "100 seconds" if k < 2 else "1 second")
        requests.keep(stream, str(tmp_path / f"out{k > 1}"), str(tmp_path / f"state{k > 1}")).awaitTermination(120)
    seen = lambda k: sorted(r["id"] for r in spark.read.parquet(str(tmp_path / f"out{k}")).collect())
    assert seen(False) == ["1"] and seen(True) == ["1", "1", "2", "3"]
    assert json.loads(spark.read.parquet(str(tmp_path / "outFalse")).first()["vote"]) == {"title": "t"}
