"""The corpus queries and, where SQL can express one, its SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import embedding_join, exact_dedup, filter_audit, jaccard_join, language_id, packing, quality_fm, secret_scan, source_mix, substring_dedup, token_files, vector_codes, warc
from .common import table


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    """The path of a public tokenizer's vocabulary; TOKENIZERS names another folder."""
    folder = os.environ.get("TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _op1(spark: SparkSession, d: str) -> DataFrame:
    return quality_fm.quality(table(spark, d, "documents"), table(spark, d, "labels"))


def _op2(spark: SparkSession, d: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, d, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _op3(spark: SparkSession, d: str) -> DataFrame:
    return embedding_join.near_vectors(table(spark, d, "embeddings"))


def _op4(spark: SparkSession, d: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, d, "documents"))


def _op5(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), tokenizer())


def _op6(spark: SparkSession, d: str) -> DataFrame:
    return secret_scan.secret_scan(table(spark, d, "documents"))


def _op7(spark: SparkSession, d: str) -> DataFrame:
    return language_id.language(table(spark, d, "documents"))


def _op8(spark: SparkSession, d: str) -> DataFrame:
    return source_mix.source_mix(table(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _op9(spark: SparkSession, d: str) -> DataFrame:
    return warc.round_trip(table(spark, d, "pages"))


def _op10(spark: SparkSession, d: str) -> DataFrame:
    return jaccard_join.near_documents(table(spark, d, "documents"))


def _op11(spark: SparkSession, d: str) -> DataFrame:
    return token_files.token_files(table(spark, d, "documents"), tokenizer())


def _op12(spark: SparkSession, d: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, d, "embeddings"))


def _op13(spark: SparkSession, d: str) -> DataFrame:
    return filter_audit.audit(table(spark, d, "documents"), table(spark, d, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_fm": _op1, "op2_exact_dedup": _op2, "op3_embedding_join": _op3, "op4_substring_dedup": _op4, "op5_packing": _op5,
        "op6_secret_scan": _op6, "op7_language_id": _op7, "op8_source_mix": _op8, "op9_warc": _op9, "op10_jaccard_join": _op10,
        "op11_token_files": _op11, "op12_vector_codes": _op12, "op13_filter_audit": _op13,
    }


#: The same rounds with every part compared with every entry, and floors of quotients of whole numbers.
_CODES = """WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, label, part, x[part * (len(x) // 16) + 1 : (part + 1) * (len(x) // 16)] AS x FROM kept, unnest(range(16)) AS u(part)),
book0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM parts QUALIFY entry < 64),
{rounds},
codes AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near2 GROUP BY vec_id),
book AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, i)) AS h FROM (SELECT part, entry, unnest(x) AS v, unnest(range(len(x))) AS i FROM book2))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM codes, book"""
_NEAR = """near{k} AS (SELECT * EXCLUDE best, best.e AS entry, best.d AS d FROM (
  SELECT vec_id, p.label, p.part, p.x, min(struct_pack(d := list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e := b.entry)) AS best
  FROM parts p JOIN book{k} b ON p.part = b.part GROUP BY vec_id, p.label, p.part, p.x))"""
_BOOK = """sums{k} AS (SELECT part, entry, list(m ORDER BY i) AS x FROM (SELECT part, entry, i, ((sum(v)::BIGINT - ((sum(v)::BIGINT % count(*)) + count(*)) % count(*)) // count(*)) AS m
  FROM (SELECT part, entry, unnest(x) AS v, unnest(range(len(x))) AS i FROM near{j}) GROUP BY part, entry, i) GROUP BY part, entry),
book{k} AS (SELECT b.part, b.entry, coalesce(s.x, b.x) AS x FROM book{j} b LEFT JOIN sums{k} s ON b.part = s.part AND b.entry = s.entry)"""
#: Every order step by step, each step's counts looked up in all sets of filters; the Shapley value is the sum over all orders itself.
_AUDIT = r"""WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
fails AS (SELECT part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS f, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM texts LEFT JOIN marks USING (doc_id)),
gone AS (SELECT part, s, count(*) AS total, count_if(f & s <> 0)::BIGINT AS n, count_if(good AND f & s <> 0)::BIGINT AS g, count_if(toxic AND f & s <> 0)::BIGINT AS x FROM fails, range(32) r(s) GROUP BY part, s),
l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(l, b)),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM l a, l b, l c, l d, l e WHERE a.b | b.b | c.b | d.b | e.b = 31),
steps AS (SELECT filter_order, k AS step, bits[k] AS b, coalesce(list_sum(bits[1 : k - 1]), 0)::BIGINT AS before FROM orders, range(1, 6) r(k))
SELECT h.part, filter_order, step::INT AS step, h.total - h.n AS kept, h.n - p.n AS removed, own.n - (h.n - p.n) AS redundant, every.n - other.n AS unique_fails, h.g - p.g AS good_lost, h.x - p.x AS toxic_lost,
  sum(h.n - p.n) OVER (PARTITION BY h.part, b)::BIGINT AS shapley
FROM steps JOIN gone p ON p.s = before JOIN gone h ON h.s = before + b AND h.part = p.part JOIN gone own ON own.s = b AND own.part = p.part
JOIN gone every ON every.s = 31 AND every.part = p.part JOIN gone other ON other.s = 31 - b AND other.part = p.part"""


#: Spans from the pieces between matches: a match begins behind all pieces and matches before it. A least length within a run stands in the pattern.
_SECRETS = r"""WITH docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
kinds AS (SELECT * FROM (VALUES (0, 'assign', '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 8), (1, 'access', 'AKIA[A-Z0-9]{12,}', 0, 0), (2, 'hex', '[0-9a-f]{32,}', 0, 0),
  (3, 'pem', '-----BEGIN [A-Z ]*PRIVATE KEY-----', 0, 0), (4, 'chat', 'xox[abp]-[0-9A-Za-z-]{15,}', 0, 0)) v(k, kind, p, g, least)),
found AS (SELECT n, k, kind, least, string_split_regex(t, p) AS s, regexp_extract_all(t, p, 0) AS m, CASE WHEN g = 2 THEN regexp_extract_all(t, p, 2) ELSE regexp_extract_all(t, p, 0) END AS v FROM docs, kinds WHERE regexp_matches(t, p)),
each AS (SELECT n, k, kind, least, s, m, v, unnest(range(1, len(m) + 1)) AS i FROM found),
spans AS (SELECT n, k, kind, list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a, length(m[i]) AS l FROM each WHERE length(v[i]) >= least),
texts AS (SELECT n, k, a::BIGINT AS a, kind || ':' || a::BIGINT || ':' || (a + l)::BIGINT AS x FROM spans),
listed AS (SELECT n, count_if(k = 0) AS n_assign, count_if(k = 1) AS n_access, count_if(k = 2) AS n_hex, string_agg(x, ',' ORDER BY a, k) FILTER (k < 3) AS base, string_agg(x, ',' ORDER BY a, k) AS spans FROM texts GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN listed USING (n)"""
_CAPTURES = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substring(x, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM d"""


def oracle_sql() -> dict[str, str]:
    rounds = ",\n".join([_NEAR.format(k=0), *(x.format(k=k, j=k - 1) for k in (1, 2) for x in (_BOOK, _NEAR))])
    text = "coalesce(text, '')"
    return {
        "op2_exact_dedup": f"""SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256({text}) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY {text})""",
        "op6_secret_scan": _SECRETS,
        "op9_warc": _CAPTURES,
        "op12_vector_codes": _CODES.format(rounds=rounds),
        "op13_filter_audit": _AUDIT,
    }
