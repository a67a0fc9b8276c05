"""What stands in for services where there is no network: a local HTTP server over files that Spark writes for a dataset API, and files in the shared folder for the sites of booklets."""

from __future__ import annotations

import json
import posixpath
import threading
from collections.abc import Iterable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from factgrid.storage import Folder, shared_dir

PAGE = 100


def write_pages(rows: DataFrame, folder: str) -> None:
    """The API's answers, a file for each page of rows(config, split, row_idx, row); row is a struct."""
    counts = rows.groupBy("config", "split").agg(F.count("*").alias("total"))
    each = F.struct("row_idx", "row", F.array().cast("array<string>").alias("truncated_cells"))
    pages = rows.withColumn("page", F.floor(F.col("row_idx") / PAGE)).groupBy("config", "split", "page").agg(F.array_sort(F.collect_list(each)).alias("rows"))  # at most PAGE rows
    body = F.to_json(F.struct("rows", F.col("total").alias("num_rows_total")), {"ignoreNullFields": "false"})
    pages.join(counts, ["config", "split"]).select("config", "split", "page", body.alias("value")).repartition("config", "split", "page").write.partitionBy("config", "split", "page").text(f"{folder}/rows")
    splits = counts.agg(F.to_json(F.struct(F.collect_list(F.struct("config", "split")).alias("splits"))).alias("value"))  # a row for each split
    splits.coalesce(1).write.text(f"{folder}/splits")


def write_files(rows: DataFrame, folder: str, name: str, body: Column) -> None:
    """A file <name>.pdf for each of rows, with its body and an end of line. Tasks put them in place, so that nothing is left for the driver to do for each."""

    def write(part: Iterable[Row]) -> None:
        files = Folder(folder)
        for row in part:
            files.write(f"{row['name']}.pdf", row["value"].encode() + b"\n")

    rows.select(F.col(name).cast("string").alias("name"), body.alias("value")).where("name is not null").foreachPartition(write)


class _Handler(BaseHTTPRequestHandler):
    def _part(self, folder: str) -> bytes | None:
        names = [n for n in self.server.files.names(folder) if posixpath.basename(n).startswith("part-")]
        return self.server.files.read(names[0]) if names else None

    def do_GET(self) -> None:
        asked = urlsplit(self.path)
        q = {k: v[0] for k, v in parse_qs(asked.query).items()}
        if asked.path == "/splits":
            body = self._part("splits")
        elif asked.path == "/rows":
            offset, length = int(q["offset"]), int(q["length"])
            body = self._part(f"rows/config={q['config']}/split={q['split']}/page={offset // PAGE}")
            if body:
                answer = json.loads(body)
                answer["rows"] = [r for r in answer["rows"] if offset <= r["row_idx"] < offset + length]
                body = json.dumps(answer).encode()
        else:
            body = None
        self.send_response(404 if body is None else 200)
        self.send_header("Content-Length", str(len(body or b"")))
        self.end_headers()
        self.wfile.write(body or b"")

    def log_message(self, *args) -> None:
        pass


class _Server(ThreadingHTTPServer):
    daemon_threads = True
    request_queue_size = 128


def serve(spark: SparkSession, folder: str) -> str:
    """The base URL of a server over the folder, which executors reach at the driver's own host; it ends with the driver."""
    server = _Server(("", 0), _Handler)
    server.files = Folder(folder)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    host = spark.conf.get("spark.driver.host", "127.0.0.1")
    return f"http://{host}:{server.server_address[1]}"


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stand_in"
