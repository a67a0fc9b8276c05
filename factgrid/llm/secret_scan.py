"""Secret scans: all rules in one automaton.

One pass over the bytes finds the stretches that hold a match; there the automaton's second array, of all rules with their
own ends, gives the spans. No rule is ever run by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .automaton import Automaton
from .common import chunks, text_bytes

#: kind, base pattern, group that is measured, its least length, whether letters match in either case. The first three are the base kinds.
RULES = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    ("access", r"AKIA[A-Z0-9]+", 0, 16, False),
    ("hex", r"[0-9a-f]+", 0, 32, False),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, False),
    ("chat", r"xox[abp]-[0-9A-Za-z-]+", 0, 20, False),
)
BASE = ("assign", "access", "hex")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
_FOUND = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string())])


def automaton() -> Automaton:
    return Automaton([rule[1:] for rule in RULES])


def secret_scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    spans lists kind:start:end (code points, end exclusive) by start, then kind as in RULES; base_sha256 is of the
    same list for the base kinds alone. Matches of a kind don't overlap: the leftmost and longest wins, and one that is too short takes its
    place, too. Texts of any length are scanned whole. A null or empty text has no spans: zeros, the digest of the
    empty string, and an empty list. Repeated rows each get their row. An empty table gives none. Other columns are ignored.
    """

    shared = docs.sparkSession.sparkContext.broadcast(automaton())  # as large as the rules make it

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dfa = shared.value
        for part, texts in chunks(batches):
            rows = {"doc_id": part.column(0), **{f"n_{k}": [0] * len(texts) for k in BASE}, "base_sha256": [hashlib.sha256(b"").hexdigest()] * len(texts), "spans": [""] * len(texts)}
            data, ends, at = b"\n".join(texts), [], 0  # a line feed is a reset byte: no match spans two texts
            for t in texts:
                at += len(t) + 1
                ends.append(at)
            hits: dict[int, list] = {}
            d = 0
            for start, end in dfa.stretches(data):
                while start >= ends[d]:
                    d += 1
                hits.setdefault(d, []).append((start, end))
            for d, places in hits.items():
                first = ends[d] - len(texts[d]) - 1
                spans, seen, chars = [], first, 0
                for start, end in places:
                    chars += len(data[seen:start].decode("utf-8"))
                    piece = data[start:end]
                    point = (lambda i: i) if piece.isascii() else (lambda i: len(piece[:i].decode("utf-8")))  # noqa: B023  matches are ASCII
                    spans += [(chars + point(s), k, chars + point(e)) for s, k, e in dfa.matches(piece)]
                    seen, chars = end, chars + len(piece.decode("utf-8"))
                spans.sort()
                base = ",".join(f"{RULES[k][0]}:{s}:{e}" for s, k, e in spans if k < len(BASE))
                rows["base_sha256"][d] = hashlib.sha256(base.encode()).hexdigest()
                rows["spans"][d] = ",".join(f"{RULES[k][0]}:{s}:{e}" for s, k, e in spans)
                for k, name in enumerate(BASE):
                    rows[f"n_{name}"][d] = sum(x[1] == k for x in spans)
            yield pa.RecordBatch.from_pydict(rows, _FOUND)

    return docs.select("doc_id", text_bytes()).mapInArrow(scan, SCHEMA)
