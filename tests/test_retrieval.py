"""Pages that are most like a claim, the index that is kept, and fuzzy places, against plain versions."""

import random

import numpy as np
import pytest

from factgrid.functions import fuzzy
from factgrid.operators import retrieval


@pytest.mark.parametrize("block", [2_000, 3])
def test_blocks_of_pages(spark, block):
    """However small the blocks, each claim has its booklet's best pages; equal pages come in their order, and pages without a vector last."""
    r = np.random.default_rng(1)
    v = lambda: r.integers(-3, 4, 8).astype(float).tolist()
    pages = [("big", i, v()) for i in range(40)]
    pages += [("big", 100 + i, pages[i][2]) for i in range(20)] + [("big", 200, None), ("small", 2, v()), ("small", 1, None), ("five", 9, v()), *[("five", i, None) for i in range(5)], ("unasked", 1, v())]
    claims = [(f"c{i}", "big", v()) for i in range(11)] + [("s", "small", v()), ("f", "five", v()), ("lost", "nowhere", v()), ("null", None, v())]
    got = retrieval.top_pages(spark.createDataFrame(claims, "request string, path string, vec array<float>"), spark.createDataFrame(pages, "path string, page int, vec array<float>"), 5, block).collect()
    want = []
    for request, path, c in claims:
        own = sorted((p, x) for q, p, x in pages if q == path and path is not None)
        if len(own) > 5:
            own = sorted(((p, None if x is None else float(np.dot(c, x))) for p, x in own), key=lambda s: (s[1] is None, -(s[1] or 0), s[0]))[:5]
        else:
            own = [(p, None) for p, _ in own]
        want += [(request, p, k, s) for k, (p, s) in enumerate(own, 1)]
    assert sorted((g["request"], g["page"], g["rank"], g["score"]) for g in got) == sorted(want)


class Noting:
    """Embeds, and writes down how many texts it was given."""

    def __init__(self, path):
        self.path = path

    def __call__(self):
        def embed(texts):
            with open(self.path, "a") as f:
                f.write("x" * len(texts))
            return [[float(len(t)), 1.0] for t in texts]

        return embed


def test_stored_index(spark, tmp_path):
    """Only booklets that are new or have changed are embedded: by a text, a page more or less, or another model."""
    folder, note = str(tmp_path / "index"), tmp_path / "note"
    note.write_text("")
    book = lambda **changed: spark.createDataFrame([(p, i, changed.get(f"{p}{i}", f"{p} page {i}")) for p in ("a", "b", "ü/c d") for i in range(4)] + [(None, 1, "no booklet")], "path string, page int, text string")

    def build(df, model="m", built=1):
        before = len(note.read_text())
        got = {(r["path"], r["page"]): r for r in retrieval.stored_index(df, folder, Noting(note), model, built=built).collect()}
        return got, len(note.read_text()) - before

    first, n = build(book())
    assert len(first) == n == 12 and abs(first["a", 0]["vec"][0] - 17 / (17**2 + 1) ** 0.5) < 1e-6  # "passage: " stands before the text
    assert build(book(), built=2)[1] == 0
    second, n = build(book(b2="changed"), built=3)
    assert n == 4 and {r["built"] for k, r in second.items() if k[0] == "b"} == {3} and {r["built"] for k, r in second.items() if k[0] != "b"} == {1}
    fewer, n = build(book(b2="changed").where("page < 3 or path <> 'a'"), built=4)
    assert n == 3 and len(fewer) == 11 and build(book(b2="changed").where("path = 'b'"))[1] == 0
    assert build(book(), "other", 5)[1] == 12


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def plain_align(quote, text):
    """Every stretch of the shorter one's length, cut off at the borders, in order."""
    short, long = (quote, text) if len(quote) <= len(text) else (text, quote)
    if short in long:
        best = (100.0, long.find(short), long.find(short) + len(short))
    else:
        best, n = (0.0, 0, 0), len(short)
        for i in range(-n + 1, len(long)):
            start, end = max(0, i), min(len(long), i + n)
            if long[end - 1 if end < len(long) else start] in short:
                score = 200.0 * plain_common(short, long[start:end]) / (n + end - start)
                best = (score, start, end) if score > best[0] else best
    return best if len(quote) <= len(text) else (best[0], 0, len(text) if best[0] else 0)


def test_fuzzy_places():
    """The bounds leave out no stretch that matters, and with a least score only those below it."""
    r = random.Random(1)
    for k in range(600):
        letters = r.choice(["ab", "abc ", "abcdefgh ", "abcdefghijklmnop äöü🙂"])
        text = "".join(r.choice(letters) for _ in range(r.randint(1, r.choice([8, 70]))))
        at = r.randrange(len(text))
        quote = list(text[at : at + r.randint(1, 40)]) if k % 4 else [r.choice(letters) for _ in range(r.randint(1, 30))]
        for _ in range(r.randint(0, 4)):
            i = r.randrange(len(quote) + 1)
            quote[i : i + r.randint(0, 1)] = [r.choice(letters)] * r.randint(0, 1)
        quote = "".join(quote) or "a"
        want = plain_align(quote, text)
        assert fuzzy.align(quote, text) == want, (quote, text)
        for least in (60.0, 90.0):
            got = fuzzy.align(quote, text, least)
            assert got == want if want[0] >= least else got[0] < least, (quote, text, least)
