"""WARC archives: writing pages as records, reading them back, and joining records into captures.

Archives are written by Spark's own text writer (one record a row, gzip), so commits and retries are
Spark's. Reading parses whole archive files by Content-Length in Arrow batches. A capture's request,
response (or revisit) and metadata records then meet by their concurrent-to identifiers and become
one nested row.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stored

DATE = "2024-01-01T00:00:00Z"
#: Pages (three records each) in an archive file, at most.
PAGES_A_FILE = 2_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "record_id string, type string, capture_id string, target_uri string, refers_to string, digest string, payload_bytes long, page_id long, payload binary"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 40 bits at a time, as eight digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(kind: str, record_id: Column, headers: list[tuple[str, Column]], body: Column) -> Column:
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Date: {DATE}\r\nWARC-Record-ID: <"), record_id, F.lit(">\r\n")]
    for name, value in headers:  # a header whose value is null is left out
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")))
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Three records per row of pages below `path`. Of equal payloads of at least min_bytes, the largest page_id's is the response.

    A capture's id is the page_id ('none' for null), a digest of the uri and the payload, and a number among equal rows,
    which are counted and written as often. Rows that have both the payload and the page_id of the response are responses too.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    uri = F.coalesce(F.regexp_replace("url", r"[\r\n]", ""), F.concat(F.lit("urn:page:"), F.col("page_id").cast("string")))
    keyed = pages.select("page_id", uri.alias("uri"), html.alias("html")).withColumns({"digest": base32_sha1(F.col("html")), "n": F.octet_length("html").cast("long")})
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    mark = F.substring(F.sha1(F.concat(F.coalesce("uri", F.lit("")), F.lit("\n"), F.col("digest"), F.lit(":"), F.col("n").cast("string")).cast("binary")), 1, 32)
    keyed = keyed.withColumn("capture", F.concat(page, F.lit(":"), mark))
    heads = stored(keyed.select("page_id", "capture", "digest", "n"), "heads")
    again = stored(heads.groupBy("capture").agg(F.count("*").alias("rows")).where("rows > 1").select("capture"), "again")
    numbered = keyed.withColumn("number", F.lit(1))
    if not again.isEmpty():  # equal rows meet in a hash aggregate, with a partial one before the shuffle
        equal = keyed.join(again, "capture", "left_semi").groupBy(keyed.columns).agg(F.count("*").cast("int").alias("rows"))
        equal = equal.withColumn("number", F.explode(F.sequence(F.lit(1), F.col("rows")))).drop("rows")
        numbered = numbered.join(again, "capture", "left_anti").unionByName(equal)
    owner = heads.where((F.col("n") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("digest", "n").agg(F.max(F.struct("page_id", "capture")).alias("owner"))
    p = numbered.join(owner, ["digest", "n"], "left").withColumn("revisit", F.col("owner").isNotNull() & ~F.col("owner.page_id").eqNullSafe(F.col("page_id")))
    own = F.concat("capture", F.lit(":"), F.col("number").cast("string"))
    name = lambda kind, of=own: F.concat(F.lit("urn:capture:"), of, F.lit(f":{kind}"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    angle = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    digest, of = F.concat(F.lit("sha1:"), F.col("digest")), angle(name("main"))
    request = _record("request", name("request"), [("WARC-Target-URI", F.col("uri")), ("WARC-Concurrent-To", of), ("Content-Type", F.lit("application/http;msgtype=request"))], F.lit("GET / HTTP/1.1\r\n\r\n"))
    shared = [("WARC-Target-URI", F.col("uri")), ("WARC-Payload-Digest", digest), ("Content-Type", F.lit("application/http;msgtype=response"))]
    main = F.when(F.col("revisit"), _record("revisit", name("main"), [*shared, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", angle(name("main", F.concat(F.col("owner.capture"), F.lit(":1")))))], http)).otherwise(
        _record("response", name("main"), shared, F.concat(http, F.col("html")))
    )
    about = F.concat(F.coalesce(F.concat(F.lit("pageId: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit("")), F.lit("payloadBytes: "), F.col("n").cast("string"), F.lit("\r\n"))
    metadata = _record("metadata", name("metadata"), [("WARC-Target-URI", F.col("uri")), ("WARC-Concurrent-To", of), ("Content-Type", F.lit("application/warc-fields"))], about)
    rows = p.select(F.explode(F.array(request, main, metadata)).alias("value"))
    rows.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", 3 * PAGES_A_FILE).text(path)


def _pieces(content: bytes) -> Iterator[bytes]:
    """The file in pieces of a MB: plain, or gzip of one or more members."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    while content[:2] == b"\x1f\x8b":
        unzip = zlib.decompressobj(31)
        while not unzip.eof:
            piece = unzip.decompress(content, 1 << 20)
            content = unzip.unconsumed_tail or unzip.unused_data
            if not piece and not content:
                break
            yield piece


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, by its Content-Length; a file cut off in a record ends before it."""
    pieces, have = _pieces(content), bytearray()

    def fill(n: int) -> bool:
        while len(have) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            have.extend(piece)
        return True

    while True:
        while fill(1) and have[:1] in b"\r\n" and have:
            del have[: len(have) - len(have.lstrip(b"\r\n")) or 1]
        at = 0
        while (end := have.find(b"\r\n\r\n", max(0, at - 3))) < 0:
            at = len(have)
            if not fill(at + 1):
                return
        head = [x.split(": ", 1) for x in have[:end].decode().split("\r\n")[1:]]
        headers = {x[0].lower(): x[1] for x in head if len(x) == 2}
        size = end + 4 + int(headers["content-length"])
        if not fill(size):
            return
        yield headers, bytes(have[end + 4 : size])
        del have[:size]


def _row(headers: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    kind, bare = headers["warc-type"], lambda x: x[1:-1] if x else None
    record_id = bare(headers["warc-record-id"])
    capture = bare(headers.get("warc-concurrent-to")) or record_id
    digest, n, page, payload = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None, None, None, None
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        n, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    elif kind == "metadata":
        fields = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if ": " in x)
        n, page = int(fields["payloadBytes"]), int(fields["pageId"]) if "pageId" in fields else None
    return record_id, kind, capture, headers.get("warc-target-uri"), bare(headers.get("warc-refers-to")), digest, n, page, payload if with_payload else None


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row per record of the archives below `path`, see RECORDS; payload_bytes and digest of responses are counted anew."""
    kinds = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in RECORDS.split(", "))])

    def records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for headers, block in parse(content.as_py()):
                    rows.append(_row(headers, block, with_payload))
                    size += 1000 + len(block) * with_payload
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, r)) for r in rows], kinds)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, r)) for r in rows], kinds)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(records, RECORDS)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, request, main (response or revisit), metadata.

    Records of a capture share its id: they name it as concurrent-to, the response or revisit has it
    as record id. A record that is missing is a null struct; of repeated ones any is taken.
    """
    fields = F.struct("record_id", "type", "target_uri", "refers_to", "digest", "payload_bytes", "page_id", "payload")
    one = lambda test, name: F.first(F.when(test, fields), ignorenulls=True).alias(name)
    kind = F.col("type")
    return records.groupBy("capture_id").agg(one(kind == "request", "request"), one(kind.isin("response", "revisit"), "main"), one(kind == "metadata", "metadata"))


def round_trip(pages: DataFrame, min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Writes the pages as archives, reads them, and returns page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload; a null url becomes urn:page:<page_id>. Each row of
    pages gives one row, also where page_id is null or repeated; a row of null page_id is a revisit where its payload is a page's with an id. An empty table gives no rows. Other columns are ignored.
    """
    path = path or f"{shared_dir(pages.sparkSession)}/warc"
    write_archives(pages, path, min_bytes)
    c = captures(read_records(pages.sparkSession, path, with_payload=False))
    return c.select(
        F.col("metadata.page_id").alias("page_id"), F.coalesce("main.payload_bytes", "metadata.payload_bytes").alias("payload_bytes"), F.col("main.digest").alias("payload_digest"),
        F.col("main.type").alias("record_type"), F.expr("try_cast(split(main.refers_to, ':')[2] as bigint)").alias("refers_to"),
    )
