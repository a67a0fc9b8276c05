"""Paged scans, downloads and model calls against a local server that has faults, and requests from several files."""

import hashlib
import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from factgrid.functions import text
from factgrid.operators import crawl, intervals, segmented
from factgrid.plans import prompt, run
from factgrid.sources import calls, downloads, http, paged, requests
from factgrid.storage import Folder


class Site(BaseHTTPRequestHandler):
    """Answers come from server.answer(path, query): bytes, or a status; each request is counted."""

    def do_GET(self):
        asked = urlsplit(self.path)
        with self.server.lock:
            self.server.seen[self.path] += 1
            n = self.server.seen[self.path]
        got = self.server.answer(asked.path, {k: v[0] for k, v in parse_qs(asked.query).items()}, n)
        if got is None:
            self.connection.close()
            return
        status, body = (got, b"") if isinstance(got, int) else (200, got)
        self.send_response(status)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def do_POST(self):
        self.server.posted.append((self.headers["Authorization"], json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
        self.do_GET()

    def log_message(self, *args):
        pass


@pytest.fixture
def site():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    server.lock, server.seen, server.posted = threading.Lock(), Counter(), []
    server.base = f"http://127.0.0.1:{server.server_address[1]}"
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server
    server.shutdown()


def dataset(sizes, longest=100, **faults):
    """An API of splits of these sizes that gives at most `longest` rows a page and fails each first request for rows."""

    def answer(path, q, n):
        if path == "/splits":
            return json.dumps({"splits": [{"config": c, "split": s} for c, s in sizes], **faults.get("splits", {})}).encode()
        if n == 1:
            return faults.get("first", 503)
        size, offset = sizes[q["config"], q["split"]], int(q["offset"])
        ids = range(offset, min(size, offset + min(longest, int(q["length"]))))
        if faults.get("empty_from", size) <= offset:
            ids = []
        rows = [{"row_idx": i, "row": {"booklet_url": faults.get("url", f" https://x.example/{i % 30}.pdf "), "reference_language": "de" if i % 2 else None}, "truncated_cells": ["booklet_url"] if faults.get("cut") == i else []} for i in ids]
        return json.dumps({"rows": rows, "num_rows_total": size + faults.get("grows", 0) * (offset > 0)}).encode()

    return answer


SIZES = {("a", "train"): 250, ("a", "test"): 7, ("b", "train"): 100}


@pytest.mark.parametrize("longest", [100, 33])
def test_paged_scan(spark, site, longest):
    """Every row once, though each first request fails and pages are shorter than asked."""
    site.answer = dataset(SIZES, longest)
    rows = paged.read_rows(spark, site.base, "d", wait=0.01, pages=2)
    got = crawl.whole(crawl.references(rows))
    assert Counter((r["reference"]["config"], r["reference"]["split"]) for r in got.collect()) == SIZES
    m = {r["url"]: r for r in crawl.manifest(got).collect()}
    assert len(m) == 30 and m["https://x.example/6.pdf"]["languages"] == [] and m["https://x.example/7.pdf"]["languages"] == ["de"]
    assert [tuple(x) for x in m["https://x.example/7.pdf"]["references"]] == [("a", "train", i) for i in range(7, 250, 30)] + [("b", "train", i) for i in range(7, 100, 30)]


def test_paged_filters(spark, site):
    """Filters leave out splits and pages before they are fetched."""
    site.answer = dataset(SIZES)
    rows = paged.read_rows(spark, site.base, "d", wait=0.01)
    got = rows.where("config = 'a' and split in ('train', 'other') and row_idx >= 120 and row_idx < 180 and length(row) > 5").collect()
    assert [r["row_idx"] for r in sorted(got)] == list(range(120, 180))
    assert {(q["config"][0], q["split"][0], int(q["offset"][0])) for q in (parse_qs(urlsplit(p).query) for p in site.seen if p.startswith("/rows")) if q["length"] != ["1"]} == {("a", "train", 120)}


@pytest.mark.parametrize("faults, words", [
    ({"splits": {"pending": [{"config": "c"}]}}, "pending"), ({"splits": {"splits": []}}, "no splits"), ({"empty_from": 200}, "no rows at 200"), ({"grows": 1}, "now has"), ({"cut": 130}, "truncated"), ({"url": "ftp://x"}, "not an http"), ({"url": None}, "missing"), ({"url": 7}, "missing"),
])
def test_refused_scans(spark, site, faults, words):
    site.answer = dataset(SIZES, **faults)
    with pytest.raises(Exception, match=words):
        crawl.whole(crawl.references(paged.read_rows(spark, site.base, "d", wait=0.01))).collect()


def test_fetch(site):
    """Three attempts, then the failure; a connection that breaks is tried again."""
    site.answer = lambda path, q, n: {"/late": b"x" if n == 3 else 500, "/never": 404, "/broken": None if n == 1 else b"y"}[path]
    assert http.fetch(f"{site.base}/late", wait=0.01) == b"x" and http.fetch(f"{site.base}/broken", wait=0.01) == b"y"
    with pytest.raises(OSError, match="404"):
        http.fetch(f"{site.base}/never", wait=0.01)
    assert site.seen == {"/late": 3, "/never": 3, "/broken": 2}


def wanted(spark, site, n):
    return spark.createDataFrame([(f"{site.base}/{i}.pdf", f"pdf/{i}.pdf", ["de"]) for i in range(n)] + [(None, "pdf/x.pdf", [])], "url string, path string, languages array<string>").repartition(3)


def test_downloads(spark, site, tmp_path):
    """A second run fetches what is missing, changed or failed, and nothing else."""
    site.answer = lambda path, q, n: b"%PDF-1.7 " + path.encode() * 9 if path != "/3.pdf" else (b"<html>" if n == 1 else b" " * 900 + b"%PDF-")
    folder = str(tmp_path / "out")
    got = {r["path"]: r for r in downloads.download(wanted(spark, site, 6), folder, wait=0.01).collect()}
    assert Counter(r["status"] for r in got.values()) == {"downloaded": 5, "error": 1, "pending": 1} and got["pdf/3.pdf"]["error"] == "no PDF header" and downloads.exit_status(folder) == 1
    assert got["pdf/4.pdf"]["sha256"] == hashlib.sha256((tmp_path / "out/pdf/4.pdf").read_bytes()).hexdigest() and not (tmp_path / "out/pdf/3.pdf").exists()
    (tmp_path / "out/pdf/1.pdf").write_bytes(b"%PDF- something else")
    (tmp_path / "out/pdf/2.pdf").unlink()
    before = site.seen.copy()
    again = {r["path"]: r["status"] for r in downloads.download(wanted(spark, site, 7), folder, wait=0.01).collect()}
    assert {k for k, n in site.seen.items() if n > before[k]} == {f"/{i}.pdf" for i in (1, 2, 3, 6)} and downloads.exit_status(folder) == 0
    assert again == {f"pdf/{i}.pdf": "cached" if i in (0, 4, 5) else "downloaded" for i in range(7)} | {"pdf/x.pdf": "pending"}


def test_killed_download(spark, site, tmp_path):
    """What was in place before a task died stays and isn't fetched again; no half file is left under a file's name."""

    def write(rows):
        writer = downloads.DownloadWriter({"path": str(tmp_path), "wait": "0.01"})
        writer.write(rows)

    def until_killed():
        for i in range(5):
            if i == 3:
                raise KeyboardInterrupt
            yield {"url": f"{site.base}/{i}.pdf", "path": f"pdf/{i}.pdf"}

    site.answer = lambda path, q, n: b"%PDF-" + b"x" * 1000
    with pytest.raises(KeyboardInterrupt):
        write(until_killed())
    assert sorted(p.name for p in (tmp_path / "pdf").iterdir()) == ["0.pdf", "1.pdf", "2.pdf"]
    got = downloads.download(wanted(spark, site, 5), str(tmp_path), wait=0.01).where("url is not null").collect()
    assert Counter(r["status"] for r in got) == {"cached": 3, "downloaded": 2} and set(site.seen.values()) == {1}


def test_downloads_from_a_store(spark, tmp_path):
    """The manifest's files don't grow with the downloads, an URL's last entry counts, and what a killed task left is taken; from a store, without a server."""
    for i in range(300):
        Folder(f"{tmp_path}/site").write(f"{i}.pdf", (b"%PDF-" if i % 100 else b"<html>") + str(i).encode())
    df = spark.createDataFrame([(f"file://{tmp_path}/site/{i}.pdf", f"pdf/{i}.pdf") for i in range(302)] + [(None, "x")], "url string, path string").repartition(3)
    folder = str(tmp_path / "out")

    def until_killed():
        yield {"url": f"file://{tmp_path}/site/7.pdf", "path": "pdf/7.pdf"}
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        downloads.DownloadWriter({"path": folder}).write(until_killed())
    first = {r["path"]: r for r in downloads.download(df, folder).collect()}
    assert Counter(r["status"] for r in first.values()) == {"downloaded": 296, "error": 5, "pending": 1, "cached": 1}
    assert first["pdf/8.pdf"]["sha256"] == hashlib.sha256(b"%PDF-8").hexdigest() and first["pdf/100.pdf"]["error"] == "no PDF header" and "no file" in first["pdf/301.pdf"]["error"]
    Folder(f"{tmp_path}/site").write("100.pdf", b"%PDF-")
    (tmp_path / "site/9.pdf").unlink()
    (tmp_path / "out/pdf/9.pdf").unlink()
    again = {r["path"]: r["status"] for r in downloads.download(df, folder).collect()}
    assert Counter(again.values()) == {"cached": 296, "downloaded": 1, "error": 5, "pending": 1} and again["pdf/100.pdf"] == "downloaded" and again["pdf/9.pdf"] == "error"
    assert len(list((tmp_path / "out/entries").rglob("*.json"))) < 12 and downloads.entries(spark, folder).count() == 302


def test_folder(tmp_path):
    f = Folder(f"file://{tmp_path}")
    f.write("a/b.txt", b"1")
    f.write("a/b.txt", b"2")
    assert f.read("a/b.txt") == b"2" and f.read("a/c") is None and f.names("a") == ["a/b.txt"] and f.names("none") == []


class Fake:
    """Writes down each call below a folder; fails for claims that say so."""

    model = "fake"

    def __init__(self, folder):
        self.folder = folder

    def complete(self, system, user, max_tokens):
        told = json.loads(user)
        Folder(self.folder).write(f"{hashlib.sha256(user.encode()).hexdigest()}-{time.time_ns()}", b"")
        if "fails" in told["claim"]:
            raise ConnectionError("down")
        time.sleep(0.05)
        quote = told["chunks"][0]["text"][:30]
        return {"text": json.dumps({"label": "ENTAILMENT", "subject_addressed": True, "same_meaning": True, "citations": [{"chunk": 0, "quote": quote}]}), "input_tokens": 40, "output_tokens": 4}


def test_calls_once(spark, tmp_path):
    """Equal payloads, a task that is tried again and a second run make no second call; failures are kept and tried anew."""
    made = str(tmp_path / "made")
    body = lambda claim: json.dumps({"claim": claim, "chunks": [{"text": "t" * 40}]})
    rows = [(str(i), body(f"claim {i % 5}")) for i in range(20)] + [("bad", body("fails")), ("none", None)]
    df = spark.createDataFrame(rows, "request string, payload string").repartition(3)
    ask = lambda: {r["request"]: r for r in calls.called(df, str(tmp_path / "log"), lambda: Fake(made), "fake", prompt.SYSTEM, in_flight=2).collect()}
    first = ask()
    assert len(first) == 22 and len(Folder(made).names()) == 6 and first["bad"]["error"] == "ConnectionError: down" and first["none"]["error"] == "no payload"
    assert all(first[str(i)]["input_tokens"] == 40 and not first[str(i)]["replayed"] and first[str(i)]["api_time_ms"] >= 50 for i in range(20))
    log, key = calls.Log(str(tmp_path / "log")), first["0"]["key"]
    assert calls.one_call(log, None, "other task", key, "", rows[0][1], 9)["replayed"]  # a task that is tried again has no need of a client
    second = ask()
    assert len(Folder(made).names()) == 7 and all(second[str(i)]["replayed"] and second[str(i)]["answer"] == first[str(i)]["answer"] for i in range(20))
    waited = calls.spans(spark, str(tmp_path / "log"))
    assert waited.where("error is not null").count() == 2 and waited.where("ended >= started").count() == 7
    t = calls.totals(spark.createDataFrame([(40, 4), (None, 4)], "input_tokens long, output_tokens long")).first()
    assert tuple(t) == (2, 40, 8)


def test_rolled_up_calls(spark, tmp_path):
    """The log's files don't grow with the calls; one that was left by a killed task, or is there twice, is one record, and answers are found in either place."""
    log, made = str(tmp_path / "log"), str(tmp_path / "made")
    body = lambda i: json.dumps({"claim": f"fails {i}" if i % 50 == 0 else f"claim {i}", "chunks": [{"text": "t" * 40}]})
    df = spark.createDataFrame([(str(i), body(i)) for i in range(200)], "request string, payload string").repartition(3)
    ask = lambda df: {r["request"]: r for r in calls.called(df, log, lambda: Fake(made), "fake", prompt.SYSTEM, in_flight=20).collect()}
    few = ask(df.where("request < '2'"))
    left = calls.Log(log)
    record = left.find(few["1"]["key"])
    left.put(record)  # as if the task had died before it took the file away
    first, second = ask(df), ask(df)
    assert len(first) == len(second) == 200 and len(Folder(made).names()) == 200 + 4 + sum(k < "2" and int(k) % 50 == 0 for k in first)
    assert all(second[k]["replayed"] and second[k]["answer"] == first[k]["answer"] for k in first if int(k) % 50)
    assert calls.spans(spark, log).count() == len(Folder(made).names())
    files = [p for p in (tmp_path / "log").rglob("*.json")]
    assert len({p.parent for p in files}) <= 256 and all(p.parent.name == "many" for p in files)


def test_local_ms(spark):
    """Time with calls under way is taken off once, however they overlap, and only a worker's own; cells of time don't matter."""
    cases = spark.createDataFrame([(1, "w", 1.0, 10.0), (2, "w", 2.5, 6.5), (3, "w", 4.0, 6.0), (4, "v", 0.0, 200.0), (5, "w", 300.0, 300.0015)], "case long, worker string, began double, finished double")
    waited = spark.createDataFrame([("w", 1.0, 3.0), ("w", 2.0, 4.0), ("w", 6.0, 7.0), ("w", 0.0, 0.5), ("v", 10.0, 190.0), ("v", 50.0, 130.0)], "worker string, started double, ended double")
    assert {tuple(r) for r in calls.local_ms(cases, waited).collect()} == {(1, 5000), (2, 2000), (3, 2000), (4, 20000), (5, 2)}


def test_chat_client(site):
    site.answer = lambda path, q, n: 500 if n == 1 else json.dumps({"choices": [{"message": {"content": "hi"}}], "model": "m-1", "usage": {"prompt_tokens": 3}}).encode()
    client = calls.pooled(site.base + "/v1/", "k", "m")
    assert client is calls.pooled(site.base + "/v1/", "k", "m")
    assert client.complete("s", "u", 5) == {"text": "hi", "model": "m-1", "input_tokens": 3, "output_tokens": 0}
    head, body = site.posted[-1]
    assert len(site.posted) == 2 and head == "Bearer k" and body["temperature"] == 0 and body["max_tokens"] == 5 and [m["role"] for m in body["messages"]] == ["system", "user"]
    with pytest.raises(ValueError, match="blank"):
        calls.ChatClient(site.base, " ", "m")


PASSAGE = {"text": "Die Gemeinde baut 2025 eine Schule im Dorf.", "language": "de"}


def line(ident, claim="Eine Schule wird gebaut.", **kw):
    return json.dumps({"id": ident, "vote": {"title": "Schule"}, "claim": {"text": claim, "language": "de"}} | (kw or {"reference": PASSAGE}))


def test_run_with_a_model(spark, tmp_path):
    """From requests to predictions through calls; a call that fails is a neutral case without cost."""
    (tmp_path / "in.jsonl").write_text("\n".join([line("a"), line("b", "it fails"), line("c"), line("d", booklet={"path": "b.pdf", "language": "de"})]))
    pages = spark.createDataFrame([("b.pdf", 3, "Seite drei sagt, dass gebaut wird.")], "path string, page int, text string")
    made = str(tmp_path / "made")
    model = run.FromModel(pages, lambda: Fake(made), "fake", str(tmp_path / "log"))
    assert run.run(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "out"), model) == 4
    got = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).orderBy(F.col("_metadata.file_path")).collect()]
    assert [(g["id"], g["label"], g["metrics"]["input_tokens"]) for g in got] == [("a", 0, 40), ("b", 1, 0), ("c", 0, 40), ("d", 0, 40)]
    assert [(e["page"], e["text"]) for e in got[0]["evidence"]] == [(None, "Die Gemeinde baut 2025 eine Schule")]  # a quote is widened to whole words
    assert [(e["page"], e["text"]) for e in got[3]["evidence"]] == [(3, "Seite drei sagt, dass gebaut wird")]
    assert len(Folder(made).names()) == 3  # a and c are one payload


def test_several_files(spark, tmp_path):
    """Two files of the same length: a prediction for each line, in the files' order; 7 and "7" are two ids, also across files."""
    (tmp_path / "a.jsonl").write_text(line("7") + "\n\n" + line("x") + "\n")
    (tmp_path / "b.jsonl").write_text(line(7) + "\n" + line("y"))
    both = [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")]
    assert run.run(spark, both, str(tmp_path / "out"), run.Neutral()) == 4
    got = [json.loads(r["value"])["id"] for r in spark.read.text(str(tmp_path / "out")).orderBy(F.col("_metadata.file_path")).collect()]
    assert got == ["7", "x", 7, "y"]
    assert [(r["line_no"], r["file_line"]) for r in requests.lines(spark, both).orderBy("line_no").collect()] == [(1, 1), (3, 3), (4, 1), (5, 2)]
    (tmp_path / "c.jsonl").write_text(line("z") + "\n" + line("x"))
    with pytest.raises(ValueError, match=r"c\.jsonl, line 2: duplicate id"):
        requests.read_requests(spark, [*both, str(tmp_path / "c.jsonl")])
    with pytest.raises(ValueError, match="must not be the input"):
        run.run(spark, both, f"{tmp_path}/x/../b.jsonl", run.Neutral())


def test_resolved_requests(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/r.jsonl").write_text(line(1, booklet={"path": "../b/./c.pdf", "language": "de"}) + "\n" + line(2, booklet={"path": "/x//y/../z.pdf", "language": "de"}) + "\n" + line(3))
    got = requests.read_requests(spark, str(tmp_path / "in/r.jsonl"), resolve=True).orderBy("line_no").collect()
    assert [r["booklet_path"] for r in got] == [f"{tmp_path}/b/c.pdf", "/x/z.pdf", None]
    odd = spark.createDataFrame([("/a", "../../../b"), ("s3://bucket/k", "../x"), ("/a/b", ""), (None, "x"), (None, "/x/."), ("hdfs://h:1/a", "s3://o/p/../q")], "folder string, path string")
    assert [r[0] for r in odd.select(text.resolved(F.col("folder"), F.col("path"))).collect()] == ["/b", "s3://bucket/x", "/a/b", None, "/x", "s3://o/q"]


@pytest.mark.parametrize("stretches", [1, 3, 7])
def test_running_values(spark, stretches):
    """Any number of stretches gives what windows over whole keys give; null keys are one; a key that most rows have lies in several stretches."""
    rows = [(None if i % 10 == 0 else "hot" if i % 3 else f"k{i % 4}", i * 37 % 101, None if i % 7 == 0 else i % 13) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, at long, v long")
    order = [F.col("at"), F.col("v")]
    dealt = segmented.dealt(df, order, ["k"], stretches)
    got = segmented.scanned(dealt, order, {"s": segmented.running_sum(F.col("v")), "n": segmented.running_count(), "hi": segmented.running_max(F.col("v")), "lo": segmented.running_min(F.col("v")), "p": segmented.previous(F.col("v"))}, ["k"])
    want, held = [], {}
    for k, at, v in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2] is not None, r[2] or 0)):
        before = held.setdefault(k, [])
        known = [x for x in before if x is not None]
        want.append((k, at, v, sum(known), len(before), max(known, default=None), min(known, default=None), before[-1] if before else None))
        before.append(v)
    assert sorted(map(repr, (tuple(r[c] for c in ("k", "at", "v", "s", "n", "hi", "lo", "p")) for r in got.collect()))) == sorted(map(repr, want))
    if stretches == 7:
        assert dealt.where("k = 'hot'").select(segmented.STRETCH).distinct().count() > 2


def test_covered_over_stretches(spark):
    """A long span covers those of later stretches."""
    spans = spark.createDataFrame([("u", float(i), float(i + (50 if i == 6 else 2))) for i in range(0, 90, 3)] + [("w", 1.0, 2.0)], "k string, start double, end double")
    assert {tuple(r) for r in intervals.covered(spans, "k").collect()} == {("u", 76.0), ("w", 1.0)}
