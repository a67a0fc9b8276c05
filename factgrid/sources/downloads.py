"""A sink that downloads files: each row names a URL and the file it goes to.

    spark.dataSource.register(Downloads)
    wanted.write.format("downloads").option("path", folder).mode("append").save()

A file is written under another name and renamed, so it is whole or not there, whatever becomes of the task. Behind each file an entry
of its own is put in place the same way, below `entries`, in a folder for each run; together they are the manifest, in which an URL's entry of the
latest run counts. Tasks put entries of many files into one as they go, so that the manifest's files don't grow in number with the downloads.
A file that is there and is what its entry says isn't fetched again, so a job that was killed goes on where it ended. The tasks' commit
messages carry counts alone. URLs may also be of a store that Arrow reaches, such as file:, hdfs: or s3:.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from http.client import HTTPException

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from factgrid.sources.http import ATTEMPTS, TIMEOUT, WAIT, fetch
from factgrid.storage import Folder

ENTRY = "url string, path string, status string, bytes long, sha256 string, error string"
# fixed values: what a PDF file begins with, and within how many bytes
HEAD = b"%PDF-"
HEAD_BYTES = 1024
#: Entries that a task puts into one file.
ROLL_UP = 1000


def is_pdf(data: bytes) -> bool:
    return HEAD in data[:HEAD_BYTES]


@dataclass
class Counts(WriterCommitMessage):
    files: int
    failed: int
    fetched: int


class Downloads(DataSource):
    """Rows have url and path, and sha256 if the file was fetched before. Options: path (the folder), attempts, timeout, wait."""

    @classmethod
    def name(cls) -> str:
        return "downloads"

    def writer(self, schema, overwrite: bool) -> DownloadWriter:
        if overwrite:
            raise ValueError("files are kept or replaced one by one: use mode append")
        return DownloadWriter(self.options)


class DownloadWriter(DataSourceWriter):
    def __init__(self, options):
        self.path = options["path"]
        self.how = {"attempts": int(options.get("attempts", ATTEMPTS)), "timeout": float(options.get("timeout", TIMEOUT)), "wait": float(options.get("wait", WAIT))}

        self.run = 1 + last_run(self.path)

    def write(self, rows: Iterator[Row]) -> Counts:
        folder, files, failed, fetched = Folder(self.path), 0, 0, 0
        fresh: dict[str, bytes] = {}
        for row in rows:
            entry = self.one(folder, row["url"], row["path"], row["sha256"] if "sha256" in row else None)
            name = f"entries/run={self.run}/{hashlib.sha256(row['url'].encode()).hexdigest()}.json"
            fresh[name] = json.dumps(entry, ensure_ascii=False).encode()
            folder.write(name, fresh[name])
            if len(fresh) >= ROLL_UP:
                self.roll_up(folder, fresh)
            files += 1
            failed += entry["status"] == "error"
            fetched += entry["status"] == "downloaded"
        self.roll_up(folder, fresh)
        return Counts(files, failed, fetched)

    def roll_up(self, folder: Folder, fresh: dict[str, bytes]) -> None:
        """One file of these entries, a line each, and then none of their own; where a task dies in between they are there twice."""
        if fresh:
            folder.write(f"entries/run={self.run}/many-{uuid.uuid4().hex}.json", b"\n".join(fresh.values()) + b"\n")
        for name in fresh:
            folder.delete(name)
        fresh.clear()

    def one(self, folder: Folder, url: str, path: str, known: str | None) -> dict:
        """A file's entry. A failure is the entry's, not the task's."""
        entry = {"url": url, "path": path}
        try:
            data = folder.read(path) if known else None
            reuse = data is not None and is_pdf(data) and hashlib.sha256(data).hexdigest() == known
            if not reuse:
                data = fetch(url, **self.how) if re.match("https?:", url, re.IGNORECASE) else from_store(url)
                if not is_pdf(data):
                    raise ValueError("no PDF header")
                folder.write(path, data)
        except (OSError, ValueError, HTTPException) as e:
            return entry | {"status": "error", "error": str(e)}
        return entry | {"status": "cached" if reuse else "downloaded", "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}

    def commit(self, messages: list[Counts | None]) -> None:
        done = [m for m in messages if m is not None]
        total = {k: sum(getattr(m, k) for m in done) for k in ("files", "failed", "fetched")}
        Folder(self.path).write("last_run.json", json.dumps(total).encode())

    def abort(self, messages: list[Counts | None]) -> None:
        """Nothing to undo: files and entries that are there are whole, and the next run takes them."""


@lru_cache(maxsize=64)
def _store(path: str) -> Folder:
    return Folder(path)


def from_store(url: str) -> bytes:
    data = _store(posixpath.dirname(url)).read(posixpath.basename(url))
    if data is None:
        raise FileNotFoundError(f"no file {url}")
    return data


def last_run(folder: str) -> int:
    """The number of the latest run over the folder, or 0."""
    return max((int(m[1]) for name in Folder(folder).names("entries", any_kind=True) if (m := re.fullmatch(r"entries/run=(\d+)", name))), default=0)


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest: an URL's entry of the latest run that had it; one of a success, if a task was tried again in that run."""
    if not last_run(folder):
        return spark.createDataFrame([], ENTRY)
    every = spark.read.schema(f"{ENTRY}, run long").option("pathGlobFilter", "*.json").json(f"{folder}/entries")
    entry = F.struct("path", "status", "bytes", "sha256", "error")
    return every.groupBy("url").agg(F.max_by(entry, F.struct("run", F.col("sha256").isNotNull())).alias("e")).select("url", "e.*")


def download(wanted: DataFrame, folder: str, **options: object) -> DataFrame:
    """Downloads wanted(url, path, ..), a row for each url, and returns it with status, bytes, sha256 and error. Rows with a null url or path are pending."""
    spark = wanted.sparkSession
    known = entries(spark, folder).where("sha256 is not null").select(F.col("url").alias("_u"), F.col("path").alias("_p"), "sha256")
    todo = wanted.where("url is not null and path is not null").select("url", "path")
    todo = todo.join(known, (F.col("url") == F.col("_u")) & (F.col("path") == F.col("_p")), "left").select("url", "path", "sha256")
    todo = todo.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "url")  # a number that stays: rows are short, what they stand for isn't
    spark.dataSource.register(Downloads)
    todo.write.format("downloads").options(path=folder, **options).mode("append").save()
    found = entries(spark, folder).select("url", "status", "bytes", "sha256", "error")
    return wanted.join(found, "url", "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def exit_status(folder: str) -> int:
    """1 if the last run had a failure, else 0."""
    return int(json.loads(Folder(folder).read("last_run.json") or b'{"failed": 1}')["failed"] > 0)
