"""Column functions on page text, model answers, votes, vectors and URLs."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values: what the data format asks for
LANGUAGES = ("de", "fr", "it")
LABELS = ("entailment", "neutral", "contradiction")
MIN_PAGE_CHARS = 50
PASSAGE_CHARS = 2500
EVIDENCE_CHARS = 5000
MIN_QUOTE_CHARS = 8


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


# fixed values: characters that extractors leave inside words, marks of a word broken at a line end, a page's own number
CONTROLS = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\ufffe\\ufeff]"
BREAK_MARK = "[\\u00ad\\x02]"
BREAK = f"[ \\t]*{BREAK_MARK}[ \\t]*\\n[ \\t]*|\\n[ \\t]*{BREAK_MARK}[ \\t]*\\n?[ \\t]*"
PAGE_NUMBER = r"(?U)^\s*\d{1,3}\s*"


def clean_page(c: Column) -> Column:
    """Without control characters that extractors leave inside words; tabs and line ends stay."""
    return F.regexp_replace(c, CONTROLS, "")


def is_filler(c: Column) -> Column:
    """Whether a page has too little text besides its number to hold evidence."""
    return F.length(strip(F.regexp_replace(c, PAGE_NUMBER, ""))) < MIN_PAGE_CHARS


def join_hyphens(c: Column) -> Column:
    """Words broken at a line end joined, whether the mark ends the line or begins the next; other soft hyphens made visible, blank lines folded."""
    lines = F.regexp_replace(F.translate(F.regexp_replace(c, BREAK, ""), "\u00ad\x02", "-"), "\\n{3,}", "\n\n")
    return F.concat(strip(lines), F.lit("\n"))


def folded(c: Column) -> Column:
    """Lower case with ß as ss, as case folding has it in the languages at hand."""
    return F.regexp_replace(F.lower(c), "ß", "ss")


def char_shingles(c: Column, k: int = 10) -> Column:
    """Distinct k-character windows of the case-folded text with white space folded."""
    t = F.regexp_replace(folded(c), r"(?U)\s+", " ")
    return F.array_distinct(F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{k}}}))."), F.lit(1)))  # one pass: a window begins at each character that has k - 1 behind it


# fixed values: how many characters the second text has to be longer by, and what share of its shingles has to be new
LONGER_BY = 100
NEW_SHARE = 0.15


def choose_page(first: Column, second: Column) -> Column:
    """The second extractor's text only where it is over 100 characters longer and over 15 % of its shingles are new."""
    a, b = char_shingles(first), char_shingles(second)
    more = (F.size(b) > 0) & (F.length(second) > F.length(first) + LONGER_BY) & (F.size(F.array_except(b, a)) / F.size(b) > NEW_SHARE)
    return F.when(more, second).otherwise(first)


def passage(c: Column) -> Column:
    return F.concat(F.lit("passage: "), F.substring(c, 1, PASSAGE_CHARS))


def query(claim: Column, vote: Column) -> Column:
    return F.concat(F.lit("query: "), F.concat_ws(" ", F.nullif(claim, F.lit("")), F.nullif(vote, F.lit(""))))


def vote_title(vote: Column) -> Column:
    """Of a vote (variant): a string as it is, an object's title or else name or else the object as JSON; null stays null."""
    text = lambda path: F.nullif(F.try_variant_get(vote, path, "string"), F.lit(""))
    kind = F.schema_of_variant(vote)
    return F.when(kind.startswith("OBJECT"), F.coalesce(text("$.title"), text("$.name"), F.to_json(vote))).when(kind != "VOID", F.try_variant_get(vote, "$", "string"))


def elapsed_ms(seconds: Column, waited: Column) -> Column:
    """A case's own time in whole milliseconds (halves to even): what passed without the time waited for calls."""
    return F.greatest(F.lit(0), F.bround((seconds - waited) * 1000)).cast("long")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x / norm)


def unfenced(c: Column) -> Column:
    """A model's answer without the code fence around it."""
    return F.regexp_replace(F.regexp_replace(strip(c), r"^```[A-Za-z]*\s*", ""), r"\s*```$", "")


def label_of(c: Column) -> Column:
    """A model's label word as ENTAILMENT, NEUTRAL or CONTRADICTION; null for others."""
    up = F.upper(strip(c))
    return F.when(up.isin("ENTAIL", "ENTAILMENT"), "ENTAILMENT").when(up == "NEUTRAL", "NEUTRAL").when(up.isin("CONTRADICT", "CONTRADICTION"), "CONTRADICTION")


def tri_state(c: Column) -> Column:
    low = F.lower(strip(c.cast("string")))
    return F.when(low == "true", True).when(low == "false", False)


def derived_label(addressed: Column, same: Column, label: Column) -> Column:
    """The answer's own flags decide first, then its label."""
    return F.when(~addressed, "NEUTRAL").when(same, "ENTAILMENT").when(~same, "CONTRADICTION").otherwise(label)


@F.pandas_udf(StringType())
def nfkc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normalized(c: Column) -> Column:
    """Text as quotes and passages are compared: NFKC, hyphens joined, white space folded, lower case."""
    t = F.regexp_replace(nfkc(c), "\\u00ad", "")
    t = F.regexp_replace(t, r"(?U)(\w) ?-\s*\n\s*(\w)", "$1$2")
    return F.lower(strip(F.regexp_replace(t, r"(?U)\s+", " ")))


def booklet_file(url: Column) -> Column:
    """A stable file name for a URL: its path's stem made plain, and the URL's SHA-256."""
    stem = F.regexp_replace(F.regexp_extract(F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    plain = F.regexp_replace(F.regexp_replace(F.url_decode(F.regexp_replace(stem, r"\+", "%2B")), "[^a-zA-Z0-9._-]+", "_"), r"^[._-]+|[._-]+$", "")
    return F.concat(F.coalesce(F.nullif(F.substring(plain, 1, 100), F.lit("")), F.lit("booklet")), F.lit("__"), F.sha2(url, 256), F.lit(".pdf"))


def resolved(folder: Column, path: Column) -> Column:
    """An absolute path, taken from the folder where it is relative: empty segments and "." go, ".." takes back the segment before, and none above the root.

    The scheme and host of a URI stay before it. Null where path is, or where it is relative and folder is null.
    """
    root = r"^[A-Za-z][A-Za-z0-9+.-]+:(//[^/]*)?"
    whole = F.when(path.rlike(root) | path.startswith("/"), path).otherwise(F.concat(folder, F.lit("/"), path))
    step = lambda up, s: F.when(s.isin("", "."), up).when(s == "..", F.slice(up, 1, F.greatest(F.size(up) - 1, F.lit(0)))).otherwise(F.array_append(up, s))
    kept = F.aggregate(F.split(F.regexp_replace(whole, root, ""), "/"), F.array().cast("array<string>"), step)
    return F.concat(F.regexp_extract(whole, root, 0), F.lit("/"), F.array_join(kept, "/"))
