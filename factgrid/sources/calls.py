"""Calls of a model, each made once: a log keeps what was answered, and answers are replayed from it.

A call is known by the SHA-256 of all that the model is given. As soon as it ends, a record of it is put into the log whole, by a rename,
before anything else is done with the answer. A task that is tried again, a second run and a request with the same payload find
the record and make no call. (A call under way when an executor is lost has no record yet, so it alone is made again.) Records of failed
attempts are kept beside, since their time counts as waiting for the model; a failed call is tried anew by the next run.
Tasks roll their records up as they go, so that the log's files don't grow in number with the calls.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from functools import lru_cache
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgrid.functions.text import elapsed_ms
from factgrid.operators import intervals
from factgrid.sources.http import TIMEOUT, fetch
from factgrid.storage import Folder, stored

# fixed value: the most tokens of an answer
MAX_TOKENS = 1024
IN_FLIGHT = 4
#: Answers that a task hands over at a time.
ROWS = 256
#: Records that a task rolls up at a time; those of a few first digits, as its calls are in their order.
ROLL_UP = 4096
#: Seconds of a cell of time in which a case and a call of the same worker meet.
CELL = 60
_ANSWER = {"key": pa.string(), "answer": pa.string(), "model": pa.string(), "input_tokens": pa.int64(), "output_tokens": pa.int64(), "api_time_ms": pa.int64(), "error": pa.string(), "replayed": pa.bool_(), "worker": pa.string(), "began": pa.float64(), "finished": pa.float64()}
ANSWER = "key string, answer string, model string, input_tokens long, output_tokens long, api_time_ms long, error string, replayed boolean, worker string, began double, finished double"
RECORD = "key string, answer string, model string, input_tokens long, output_tokens long, started double, ended double, error string, worker string"


class Client(Protocol):
    model: str

    def complete(self, system: str, user: str, max_tokens: int) -> dict:
        """text, and if known model, input_tokens and output_tokens. May raise."""
        ...


class ChatClient:
    """A client of a chat completion API, at temperature 0; a failed attempt is made once more."""

    def __init__(self, base: str, key: str, model: str, timeout: float = TIMEOUT):
        if not key.strip():
            raise ValueError("the API's key is blank")
        self.base, self.key, self.model, self.timeout = base.rstrip("/"), key, model, timeout

    def complete(self, system: str, user: str, max_tokens: int = MAX_TOKENS) -> dict:
        body = {"model": self.model, "temperature": 0, "max_tokens": max_tokens, "stream": False, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        head = {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"}
        got = json.loads(fetch(f"{self.base}/chat/completions", 2, self.timeout, 1.0, json.dumps(body).encode(), head))
        used = got.get("usage") or {}
        return {"text": got["choices"][0]["message"].get("content") or "", "model": got.get("model") or self.model, "input_tokens": int(used.get("prompt_tokens") or 0), "output_tokens": int(used.get("completion_tokens") or 0)}


@lru_cache(maxsize=4)
def pooled(base: str, key: str, model: str, timeout: float = TIMEOUT) -> ChatClient:
    """One client for each API in a worker, kept from task to task."""
    return ChatClient(base, key, model, timeout)


class Log:
    """Records of calls below a folder, by the first two digits of the key: <key>.json of one that succeeded, <key>.<id>.failed.json of each attempt that failed.

    roll_up puts those that this log has written or found into one file, many/<id>.json, a line each, and takes their own files away after that:
    a record is always in one of them, and in both only where a task dies in between.
    """

    def __init__(self, path: str):
        self.folder, self.lock = Folder(path), threading.Lock()
        self.fresh: dict[str, bytes] = {}
        self.part, self.known, self.seen = "", {}, set()  # what many/ holds of the digits asked for last

    def find(self, key: str) -> dict | None:
        name = f"{key[:2]}/{key}.json"
        data = self.folder.read(name)
        with self.lock:
            if data:
                self.fresh[name] = data
            else:
                data = self._rolled_up(key[:2]).get(key)
        return json.loads(data) if data else None

    def _rolled_up(self, part: str) -> dict[str, bytes]:
        if part != self.part:
            self.part, self.known, self.seen = part, {}, set()
        for name in self.folder.names(f"{part}/many"):
            if name not in self.seen and name.endswith(".json"):
                self.seen.add(name)
                for line in (self.folder.read(name) or b"").split(b"\n"):
                    if line and (record := json.loads(line))["error"] is None:
                        self.known[record["key"]] = line
        return self.known

    def put(self, record: dict) -> None:
        name = record["key"] if record["error"] is None else f"{record['key']}.{uuid.uuid4().hex}.failed"
        name, data = f"{record['key'][:2]}/{name}.json", json.dumps(record, ensure_ascii=False).encode()
        self.folder.write(name, data)
        with self.lock:
            self.fresh[name] = data

    def roll_up(self) -> None:
        with self.lock:
            fresh, self.fresh = self.fresh, {}
        for part in {name[:2] for name in fresh}:
            own = {name: data for name, data in fresh.items() if name[:2] == part}
            self.folder.write(f"{part}/many/{uuid.uuid4().hex}.json", b"\n".join(own.values()) + b"\n")
            for name in own:
                self.folder.delete(name)


def one_call(log: Log, client: Client, worker: str, key: str, system: str, user: str, max_tokens: int) -> dict:
    """A row of ANSWER: from the log, or from a call whose record is put there first."""
    began = time.time()
    record = log.find(key)
    replayed = record is not None
    if record is None:
        record = {"key": key, "answer": None, "model": client.model, "input_tokens": 0, "output_tokens": 0, "started": time.time(), "error": None, "worker": worker}
        try:
            got = client.complete(system, user, max_tokens)
            record |= {"answer": got.get("text") or "", "model": got.get("model") or client.model, **{k: int(got.get(k) or 0) for k in ("input_tokens", "output_tokens")}}
        except Exception as e:  # noqa: BLE001  whatever a client raises is this case's error, not the job's
            record["error"] = f"{type(e).__name__}: {e}"
        record["ended"] = time.time()
        log.put(record)
    ms = round((record["ended"] - record["started"]) * 1000)
    return {k: record.get(k) for k in ("key", "answer", "model", "input_tokens", "output_tokens", "error")} | {"api_time_ms": ms, "replayed": replayed, "worker": worker, "began": began, "finished": time.time()}


def call_key(system: str, model: str, max_tokens: int):
    """What tells calls apart: the model, the length it may answer with, and both texts."""
    return F.sha2(F.concat(F.lit(f"{model}\n{max_tokens}\n{len(system)}\n{system}\n"), F.col("payload")), 256)


def called(payloads: DataFrame, log: str, connect: Callable[[], Client], model: str, system: str, max_tokens: int = MAX_TOKENS, in_flight: int = IN_FLIGHT, tasks: int | None = None) -> DataFrame:
    """payloads(request, payload) with the columns of ANSWER; a call for each payload that the log doesn't hold yet.

    connect makes the client, once in each task; at most in_flight calls of a task are under way. The answers are written once, so that what
    reads them later makes no call. A null payload isn't sent: its row has an error.
    """
    keyed = payloads.withColumn("key", call_key(system, model, max_tokens))
    n = tasks or int(payloads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = keyed.where("payload is not null").groupBy("key").agg(F.first("payload").alias("payload")).repartitionByRange(n, "key").sortWithinPartitions("key")  # a task has few first digits, one after another

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, client, worker = Log(log), connect(), uuid.uuid4().hex
        waiting: deque[Future] = deque()
        done: list[dict] = []
        with ThreadPoolExecutor(in_flight) as pool:

            def finish(most: int) -> None:
                """Waits until at most so many calls are under way or waiting."""
                while len(waiting) > most:
                    done.append(waiting.popleft().result())

            def answered() -> pa.RecordBatch:
                rows = done.copy()
                done.clear()
                return pa.RecordBatch.from_arrays([pa.array([row[k] for row in rows], t) for k, t in _ANSWER.items()], names=list(_ANSWER))

            for batch in batches:
                for key, user in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    finish(2 * in_flight - 1)
                    if len(records.fresh) >= ROLL_UP:
                        records.roll_up()
                    if len(done) >= ROWS:
                        yield answered()
                    waiting.append(pool.submit(one_call, records, client, worker, key, system, user, max_tokens))
            finish(0)
            records.roll_up()
            yield answered()

    answers = stored(once.mapInArrow(ask, ANSWER), "answers")
    return keyed.select("request", "key").join(answers, "key", "left").withColumn("error", F.coalesce("error", F.when(F.col("key").isNull(), "no payload")))


def spans(spark: SparkSession, log: str) -> DataFrame:
    """The log's records, those of failed attempts too: one for each time that a model was waited for."""
    records = spark.read.schema(RECORD).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(log)
    return records.dropDuplicates(["key", "worker", "started"])  # a record that was being rolled up when its task died is there twice


def local_ms(cases: DataFrame, waited: DataFrame) -> DataFrame:
    """(case, local_ms): the whole milliseconds of cases(case, worker, began, finished) in which their worker had no call under way; waited(worker, started, ended).

    A case meets the calls of its worker that lie in the same cells of time, and what they cover together is taken off.
    """
    cell = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / CELL), F.floor(F.greatest(F.col(a), F.col(b)) / CELL))).alias("cell")
    own = cases.select("case", "worker", "began", "finished", cell("began", "finished"))
    met = own.join(waited.select("worker", "started", "ended", cell("started", "ended")), ["worker", "cell"]).where("ended > began and started < finished")
    within = met.select("case", F.greatest("started", "began").alias("start"), F.least("ended", "finished").alias("end")).distinct()
    open_s = intervals.covered(within, "case").withColumnRenamed("seconds", "open")
    ms = elapsed_ms(F.col("finished") - F.col("began"), F.coalesce("open", F.lit(0.0)))
    return cases.join(open_s, "case", "left").select("case", ms.alias("local_ms"))


def totals(answers: DataFrame) -> DataFrame:
    """Tokens of all answers, and how many there are."""
    return answers.agg(F.count("*").alias("answers"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens")])
