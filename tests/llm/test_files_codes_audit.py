"""Token files, vector codes and the audit of filters against plain versions, on small tables with the odd cases."""

import hashlib
import random
import zlib
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest

from factgrid.llm import filter_audit, token_files, vector_codes
from factgrid.llm.registry import tokenizer

from . import brute


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# --- token files -------------------------------------------------------------------------------------------------


def odd_texts():
    r = random.Random(2)
    long = " ".join("".join(r.choice("abcdeéß") for _ in range(r.randint(1, 9))) for _ in range(60_000))
    return [None, "", " \n", "one", "One two", "one", "naïve ½ 中文 🙂 <|endoftext|>", long, "a b c " * 400]


def plain_tokens(docs, end_id=1):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer())
    ids = [(i, np.array([*whole.encode(t or "", add_special_tokens=False).ids, end_id], "<u4").tobytes()) for i, t in docs]
    ids = sorted(((i, zlib.crc32(x), len(x) // 4) for i, x in ids), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out, at = [], 0
    for i, crc, n in ids:
        out.append((i, at, n, crc))
        at += n
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard_ids", [token_files.SHARD_IDS, 3_000])
def test_token_files(spark, tmp_path, shard_ids):
    """Null and repeated doc_ids, a long text, ties; many shards and blocks give what one does."""
    texts = odd_texts()
    data = [(i * 7 % 11, t, "x") for i, t in enumerate(texts)] + [(None, "no id here", "x"), (None, "no id here", "x"), (5, "once more", "x"), (5, "once more", "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, ids string").repartition(3)
    got = token_files.token_files(df, tokenizer(), str(tmp_path / "t"), shard_ids=shard_ids, block_ids=1_000)
    assert rows(got, "doc_id", "start", "n_tokens", "ids_crc32") == plain_tokens([d[:2] for d in data])
    ranks = spark.read.parquet(str(tmp_path / "t/ranks")).orderBy("rank").collect()
    assert [r["rank"] for r in ranks] == list(range(len(ranks))) and [-r["n"] for r in ranks] == sorted(-r["n"] for r in ranks)
    files = [f for f in (tmp_path / "t/shards").glob("part-*") if f.stat().st_size]
    assert (len(files) > 5) == (shard_ids == 3_000)
    found = [b for f in files for b in token_files.blocks(f.read_bytes())]
    assert sum(len(b[1]) for b in found) == len(data) and max(len(b[1]) for b in found if b[2].sum() > 1_000) == 1


def test_token_files_empty(spark):
    assert token_files.token_files(spark.createDataFrame([], "doc_id long, text string"), tokenizer()).count() == 0


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1001])
def test_coding(n):
    """Ranks of all four lengths, and padding."""
    r = np.random.default_rng(n)
    ranks = (r.integers(0, 1 << 32, n, np.uint64) >> r.choice([0, 8, 16, 24, 31], n).astype(np.uint64)).astype(np.uint32)
    control, data = token_files.encode(ranks)
    back = token_files.decode(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8))
    assert back[:n].tolist() == ranks.tolist() and not back[n:].any() and len(back) == -(-n // 4) * 4
    assert len(data) == sum(max(1, -(-int(x).bit_length() // 8)) for x in ranks) + (-n % 4)


def test_damaged_block():
    control, data = token_files.encode(np.arange(10, dtype=np.uint32))
    whole = token_files.block(0, 0, [1, None], [4, 6], control, data) + b"\n"
    assert [b[1] for b in token_files.blocks(whole * 2)] == [[1, None]] * 2
    broken = bytearray(whole)
    broken[-2] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(token_files.blocks(bytes(broken)))
    with pytest.raises(ValueError, match="agree"):
        token_files.decode(np.frombuffer(control, np.uint8), np.frombuffer(data[:-1], np.uint8))


# --- vector codes ------------------------------------------------------------------------------------------------


def plain_codes(data, parts=16, entries=64, rounds=2):
    """Whole searches in Python's own numbers. data: vec_id, vector, label."""
    kept = [(i, [int(np.floor(256.0 * c)) for c in v], label) for i, v, label in data if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda k: (k[0] is None, k[0] or 0, k[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for _, v, _ in kept:
                own[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(c) for c in zip(*own[k])] if k in own else e for k, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    out = [(i, label, [near(cut(v, p), books[p]) for p in range(parts)]) for i, v, label in kept]
    by = defaultdict(int)
    for _, label, found in out:
        by[label] += sum(d for d, _ in found)
    return sorted(((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), by[label], digest) for i, label, found in out), key=repr)


SCHEMA = "vec_id long, embedding array<float>, label int, dist string"
OUT = ("vec_id", "code", "error", "label_error", "codebooks_sha256")


@pytest.mark.parametrize("coarse", [1, 8])
def test_codes(spark, coarse):
    """Bad vectors go, null and repeated ids and labels stay; coarse numbers make many ties."""
    r = np.random.default_rng(coarse)
    vectors = (r.normal(0, 0.2, (260, 32)) * 256 // 40 * 40 / 256 if coarse == 8 else r.normal(0, 0.2, (260, 32))).astype(np.float32).tolist()
    data = [(i * 37 % 1000, v, [None, 3, 4][i % 3], "x") for i, v in enumerate(vectors)]
    data += [(None, vectors[0], None, "x"), (5, vectors[1], 3, "x"), (5, vectors[1], 3, "x"), (5, vectors[2], 4, "x")]
    bad = [(1, None, 3, "x"), (2, [None, *vectors[0][1:]], 3, "x"), (3, [float("nan"), *vectors[0][1:]], 3, "x"), (4, [float("-inf"), *vectors[0][1:]], 3, "x")]
    df = spark.createDataFrame(data + bad, SCHEMA).repartition(3)
    assert rows(vector_codes.vector_codes(df), *OUT) == plain_codes([d[:3] for d in data])


def test_few_vectors(spark):
    """Fewer vectors than entries; other lengths have codebooks of their own or can't be cut; large numbers stop at a limit."""
    data = [(1, [0.5] * 16, 1, ""), (2, [-0.001] * 16, 1, ""), (3, [3e38] * 16, None, ""), (4, [1.0] * 32, None, ""), (5, [1.0] * 17, 1, ""), (6, [], 1, "")]
    got = {r["vec_id"]: r for r in vector_codes.vector_codes(spark.createDataFrame(data, SCHEMA)).collect()}
    assert sorted(got) == [1, 2, 3, 4, 6] and {r["error"] for r in got.values()} == {0}
    assert [got[i]["code"] for i in (1, 2, 3, 4, 6)] == ["00" * 16, "01" * 16, "02" * 16, "00" * 16, "00" * 16]
    assert got[1]["codebooks_sha256"] == hashlib.sha256(",".join(["128,-1,1048576"] * 16).encode()).hexdigest() != got[4]["codebooks_sha256"]
    assert vector_codes.vector_codes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert vector_codes.vector_codes(spark.createDataFrame([(1, None, 1, "")], SCHEMA)).count() == 0


def test_active_entries(monkeypatch):
    """What moved entries and stored distances give is what a whole search gives, ties too; parts whose entry stays look at moved ones alone."""
    r = np.random.default_rng(5)
    x, book = r.integers(-4, 5, (500, 2)), r.integers(-4, 5, (64, 2))
    near, dist = vector_codes.nearest(x, book)
    for _ in range(20):
        moved = r.random(64) < 0.3
        book = np.where(moved[:, None], r.integers(-4, 5, book.shape), book)
        asked = []
        plain = vector_codes.distances
        monkeypatch.setattr(vector_codes, "distances", lambda x, e: (asked.append(len(x) * len(e)), plain(x, e))[1])  # noqa: B023
        stays = int((~moved[near]).sum())
        near, dist = vector_codes.renewed(x, book, moved, near, dist)
        monkeypatch.setattr(vector_codes, "distances", plain)
        want = vector_codes.nearest(x, book)
        assert (near == want[0]).all() and (dist == want[1]).all() and sum(asked) == stays * moved.sum() + (len(x) - stays) * 64
    same = vector_codes.renewed(x, book, np.zeros(64, bool), near, dist)
    assert (same[0] == near).all() and (same[1] == dist).all()


# --- filters -----------------------------------------------------------------------------------------------------


def plain_audit(docs, labels):
    """Every order applied document by document. docs: doc_id, text, lang."""
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    parts = defaultdict(list)
    for i, t, lang in docs:
        t = t or ""
        w = brute.words(t)
        failed = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and least[t] < i,
        }
        parts[lang or ""].append((i, {k for k, v in failed.items() if v}))
    out = []
    for part, own in parts.items():
        found, total = [], defaultdict(int)
        for order in permutations("ABCDE"):
            left = own
            for step, k in enumerate(order, 1):
                gone, left = [d for d in left if k in d[1]], [d for d in left if k not in d[1]]
                total[k] += len(gone)
                found.append((k, (part, "".join(order), step, len(left), len(gone), sum(k in f for _, f in own) - len(gone), sum(f == {k} for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))))
        out += [(*row, total[k]) for k, row in found]
    return sorted(out, key=repr)


def test_audit(spark):
    r = random.Random(3)
    word = lambda: r.choice(["a", "bb", "Ccc", "dd", "é", "x#", "&"]) + str(r.randrange(r.choice([3, 400])))
    texts = [None, "", "a " * 200, "a b " * 100, "Abc" + "d" * 97, "ABCd" + "d" * 97, "x y", "100%"]  # just 200 words, 50 and 3 percent
    texts += [" ".join(word() for _ in range(r.choice([3, 150, 199, 200, 201, 260]))) for _ in range(40)]
    docs = [(i, t, [None, "", "en", "de"][i % 4], "x") for i, t in enumerate(texts)]
    docs += [(100 + i, r.choice(texts[4:20]), r.choice(["en", "fr", None]), "x") for i in range(60)] + [(101, texts[8], "en", "x"), (101, texts[8], "en", "x"), (None, texts[8], "en", "x"), (None, texts[8], "de", "x")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 150, 2)] + [(8, 1, 1), (8, 0, 0), (None, 1, 1)]
    got = filter_audit.audit(spark.createDataFrame(docs, "doc_id long, text string, lang string, fails string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    columns = [c.split()[0] for c in filter_audit.AUDIT.split(", ")]
    assert rows(got, *columns) == plain_audit([d[:3] for d in docs], labels) and got.count() == 600 * 4


def test_audit_empty(spark):
    docs, labels = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"
    assert filter_audit.audit(spark.createDataFrame([], docs), spark.createDataFrame([], labels)).count() == 0
    one = filter_audit.audit(spark.createDataFrame([(1, "word " * 5, "en")], docs), spark.createDataFrame([], labels)).collect()
    assert len(one) == 600 and {(r["kept"], r["good_lost"]) for r in one if r["step"] == 5} == {(0, 0)} and {r["shapley"] for r in one} == {0, 60}


def test_shapley():
    """The least squares' solution is the mean over all orders, on any values."""
    r = random.Random(7)
    for m in (2, 3, 5):
        value = [0] + [r.randrange(1000) for _ in range((1 << m) - 1)]
        total = [0] * m
        orders = list(permutations(range(m)))
        for order in orders:
            s = 0
            for i in order:
                total[i] += value[s | 1 << i] - value[s]
                s |= 1 << i
        assert [x * len(orders) for x in filter_audit.shapley(value, m)] == total
