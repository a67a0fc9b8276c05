"""Language identification by interpolated Kneser-Ney character models, one per language.

A model sees each word's letters between boundary marks. Spark counts the highest-order n-grams of a
bounded sample of labelled documents by language; the driver turns the counts, which the sample
bounds, into discounted probabilities and back-off weights in sorted hash arrays. A text gets the
language of the lowest cross-entropy per character. Rows set apart from the sample calibrate the rest: a temperature that makes the
scores probabilities, the least score to be trusted, and for each language the cross-entropy above which a text is none of it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, stored, text_bytes

ORDER = 4
DISCOUNT = 0.75
#: Documents of each language in the sample, about (those whose hash falls into that share of the language); a tenth of them is set apart.
MOST_ROWS = 600
#: Of the rows set apart that aren't rejected by their score, so many are right; of those that are right, so many aren't rejected by their entropy.
TRUST, LEFT_ALONE = 0.995, 0.99
#: Words whose scores a Python worker keeps; beyond that it forgets them all.
MOST_KNOWN = 200_000
UNKNOWN = "und"
_NOT_LETTERS = regex.compile(r"\P{L}+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def letters(word: bytes) -> str:
    return _NOT_LETTERS.sub("", word.decode("utf-8").lower())


def rolling(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For each n up to order, the hash of the n codes that end at each position; hashes[0] is that of none."""
    out = [np.zeros(len(codes), np.uint64)]
    for n in range(1, order + 1):
        shifted = np.concatenate([np.zeros(n - 1, np.uint64), codes[: len(codes) - n + 1]])
        h = (out[-1] ^ (shifted + np.uint64(n))) * _MIX
        out.append(h ^ (h >> np.uint64(29)))
    return out


def codes_of(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words with order-1 marks before each and one behind, which of them are predicted, and their word."""
    text = "".join("\x02" * (order - 1) + w + "\x03" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), [len(w) + order for w in words])
    return codes, codes != 2, word


class Model:
    """probability[n] and backoff[n]: sorted hashes of n-grams (of contexts of order n) and a row of languages each."""

    def __init__(self, langs: list[str], grams: dict[str, Counter], order: int = ORDER, discount: float = DISCOUNT):
        self.langs, self.order, self.beta = langs, order, 1.0
        self.least, self.highest = 0.0, np.full(len(langs), np.inf)  # score below which, and entropy above which, a text is rejected
        tables: list[list[dict[str, float]]] = []
        alphabet = {c for by in grams.values() for g in by for c in g}
        self.base = 1.0 / max(1, len(alphabet) + 1)
        for lang in langs:
            counts, levels = grams[lang], []
            for n in range(order, 0, -1):
                total, kinds = Counter(), Counter()
                for g, c in counts.items():
                    total[g[:-1]] += c
                    kinds[g[:-1]] += 1
                levels.append(({g: max(c - discount, 0.0) / total[g[:-1]] for g, c in counts.items()}, {h: discount * k / total[h] for h, k in kinds.items()}))
                below: Counter = Counter(g[1:] for g in counts)  # distinct ways to continue to the left
                counts = below
            tables.append(levels[::-1])
        self.probability, self.backoff = [], []
        for n in range(order):
            for kind, out, default in ((0, self.probability, 0.0), (1, self.backoff, 1.0)):
                keys = sorted({g for t in tables for g in t[n][kind]})
                hashes = np.array([self._hash(g) for g in keys], np.uint64)
                rows = np.array([[t[n][kind].get(g, default) for t in tables] for g in keys], np.float32).reshape(len(keys), len(langs))
                order_ = np.argsort(hashes)
                out.append((hashes[order_], rows[order_]))

    @staticmethod
    def _hash(gram: str) -> int:
        if not gram:
            return 0
        codes = np.frombuffer(gram.encode("utf-32-le"), np.uint32).astype(np.uint64)
        return int(rolling(codes, len(gram))[-1][-1])

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each word's negative log-probability by language, and its number of predicted characters."""
        if not words:
            return np.zeros((0, len(self.langs))), np.zeros(0)
        codes, predicted, word = codes_of(words, self.order)
        hashes = [h[predicted] for h in rolling(codes, self.order)]
        # a context is the n-gram that ends one position earlier
        before = [np.concatenate([h[:1], h[:-1]])[predicted] for h in rolling(codes, self.order - 1)]
        _, first, inverse = np.unique(hashes[-1], return_index=True, return_inverse=True)
        p = np.full((len(first), len(self.langs)), self.base)
        for n in range(self.order):
            p = _find(self.probability[n], hashes[n + 1][first], 0.0) + _find(self.backoff[n], before[n][first], 1.0) * p
        cost = -np.log(np.maximum(p, 1e-12))[inverse]
        own = word[predicted]
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        return np.add.reduceat(cost, starts), np.diff([*starts, len(own)]).astype(float)


def _find(arrays: tuple[np.ndarray, np.ndarray], keys: np.ndarray, default: float) -> np.ndarray:
    hashes, rows = arrays
    out = np.full((len(keys), rows.shape[1]), default)
    if len(hashes):
        i = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
        hit = hashes[i] == keys
        out[hit] = rows[i[hit]]
    return out


class Scorer:
    """Cross-entropies of whole texts; what it knows of a word is kept."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.cost, self.size = np.zeros((1024, len(self.model.langs))), np.zeros(1024)

    def entropies(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character by language for each text, and its number of characters (0: no letter)."""
        if len(self.place) > MOST_KNOWN:
            self.forget()
        place, fresh, rows = self.place, [], []
        for t in texts:
            words = t.split()
            for w in set(words).difference(place):
                place[w] = len(place)
                fresh.append(w)
            rows.append(np.fromiter(map(place.__getitem__, words), np.int64, len(words)))
        while len(self.size) < len(place):
            self.cost, self.size = np.concatenate([self.cost, np.zeros_like(self.cost)]), np.concatenate([self.size, np.zeros_like(self.size)])
        known = [(w, s) for w in fresh if (s := letters(w))]
        for at in range(0, len(known), 20_000):
            part = known[at : at + 20_000]
            cost, size = self.model.words([s for _, s in part])
            i = [place[w] for w, _ in part]
            self.cost[i], self.size[i] = cost, size
        out, n = np.zeros((len(texts), len(self.model.langs))), np.zeros(len(texts))
        for k, r in enumerate(rows):
            n[k] = self.size[r].sum()
            if n[k]:
                out[k] = self.cost[r].sum(0) / n[k]
        return out, n

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores, and which are rejected; a text without letters has no language, score 0, and is rejected."""
        h, n = self.entropies(texts)
        best = h.argmin(1)
        row = np.arange(len(texts))
        score = np.where(n > 0, probabilities(h, self.model.beta)[row, best], 0.0)
        rejected = (n == 0) | (score < self.model.least) | (h[row, best] > self.model.highest[best])
        return [self.model.langs[b] if k else UNKNOWN for b, k in zip(best, n)], score, rejected


def probabilities(h: np.ndarray, beta: float) -> np.ndarray:
    z = np.exp(-beta * (h - h.min(1, keepdims=True)))
    return z / z.sum(1, keepdims=True)


def calibrate(model: Model, h: np.ndarray, right: np.ndarray) -> None:
    """Fits beta, least and highest on entropies of rows of which the language is known.

    The log loss is taken against (n + 1) / (n + 2) in place of 1, so that a sample without errors doesn't make every score 1.
    """
    if not len(h):
        return
    row, target = np.arange(len(h)), (len(h) + 1) / (len(h) + 2)

    def loss(beta: float) -> float:
        p = np.clip(probabilities(h, beta)[row, right], 1e-12, 1 - 1e-12)
        return float(-(target * np.log(p) + (1 - target) * np.log(1 - p)).mean())

    model.beta = float(min(np.geomspace(0.1, 200, 120), key=loss))
    best = h.argmin(1)
    score, good = probabilities(h, model.beta)[row, best], best == right
    order = np.argsort(score)
    wrong_from = np.cumsum(~good[order][::-1])[::-1]  # wrong ones among those from here on
    trusted = np.flatnonzero(wrong_from <= (1 - TRUST) * (len(h) - np.arange(len(h))))
    model.least = float(score[order[trusted[0]]]) if len(trusted) and trusted[0] else (0.0 if len(trusted) else 1.0)
    for k in range(len(model.langs)):
        own = h[good & (right == k), k]
        if len(own) >= 10:
            model.highest[k] = np.quantile(own, LEFT_ALONE)


def train(docs: DataFrame, most_rows: int = MOST_ROWS, held_out: int = 0, parts: int = 5, order: int = ORDER) -> Model:
    """Fitted on about most_rows documents a language, picked by a hash of their id; ids whose crc32 mod parts is held_out are never read."""
    own = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts)) != held_out))
    many = stored(own.groupBy("lang").agg(F.count("*").alias("n")), "languages")  # a row for each language
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.least(F.lit(1.0), F.lit(most_rows) / F.col("n")) * (1 << 30)
    apart = (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(10)) == 0) & (F.col("n") >= 20)
    rows = stored(own.join(F.broadcast(many), "lang").where(share).select("lang", apart.alias("apart"), text_bytes()), "sample")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, limit=8 << 20):
            by: dict[str, Counter] = {}
            for lang, t in zip(part.column(0).to_pylist(), texts):
                by.setdefault(lang, Counter()).update(t.split())
            for lang, words in by.items():
                grams: Counter = Counter()
                for w, c in words.items():
                    if s := letters(w):
                        s = "\x02" * (order - 1) + s + "\x03"
                        for i in range(len(s) - order + 1):
                            grams[s[i : i + order]] += c
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], names=["lang", "gram", "n"])

    counted = rows.where("not apart").select("lang", "apart", "bytes").mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams: dict[str, Counter] = {}
    for lang, gram, n in counted.toPandas().itertuples(index=False):  # bounded by the sample
        grams.setdefault(lang, Counter())[gram] = n
    langs = sorted(r["lang"] for r in many.select("lang").collect())
    model = Model(langs, {x: grams.get(x, Counter()) for x in langs}, order)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def entropies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for part, texts in chunks(batches):
            h, n = scorer.entropies(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(h), pa.list_(pa.float64())), pa.array(n)], names=["lang", "h", "n"])

    test = rows.where("apart").mapInArrow(entropies, "lang string, h array<double>, n double").where("n > 0").toPandas()  # numbers of a tenth of the sample
    calibrate(model, np.array(test["h"].tolist()).reshape(-1, max(1, len(langs))), np.array([langs.index(x) for x in test["lang"]], int))
    return model


def language(docs: DataFrame, model: Model | None = None, reject: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every document.

    lang_pred is a learned language, or `und` with score 0 where a text is null or has no letter (of Unicode's category L) and, if
    `reject` is asked for, where the calibrated rejection holds. score is the calibrated probability of the language. Texts of any length are
    scored whole. Ties go to the first language by name. Repeated rows get a row each; an empty table gives none; without labelled rows
    all are `und`. Other columns are ignored.
    """
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for part, texts in chunks(batches):
            lang, score, rejected = scorer.predict(texts) if shared.value.langs else ([UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    out = docs.select("doc_id", text_bytes()).mapInArrow(predict, "doc_id long, lang_pred string, score double, rejected boolean")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    pred = F.when(F.col("rejected"), UNKNOWN).otherwise(F.col("lang_pred")) if reject else F.col("lang_pred")
    return out.select("doc_id", held.alias("held_out"), pred.alias("lang_pred"), "score", "rejected")
