"""Best-fit packing of tokenised documents into sequences of a fixed length, by bin completion.

Pieces are equal when their lengths are, so the problem is a histogram with one count for each length
below the limit, however many documents there are. Spark makes the histogram, the driver solves it
(bin completion, branch and bound, over at most `limit` counts), and Spark deals the pieces of each
length out to the slots of the solution by rank. Ranks are counted in many buckets per length, so a
length that a third of all pieces share isn't gathered anywhere.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import chunks, stored, text_bytes

LIMIT = 4096
END_ID = 1
#: Words, and parts of words, whose ids a Python worker keeps, and as many older ones.
MOST_WORDS = 200_000
#: Steps of the search (fillings built or tried) after best-fit gave the first solution; it stops before where the bound is met.
MOST_NODES = 20_000
#: Levels of the search whose state is kept, the deepest ones; others are built again when the search comes back to them, so memory doesn't follow the number of bins.
OPEN_LEVELS = 32
#: Pieces of one length whose ranks a task counts together, on average.
BUCKET_PIECES = 500
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: What the tokenizer's file says of texts, where words can be encoded alone: lower case, and a split that drops white space.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [{"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
    },
}
#: Printable characters below U+0180 that no normalisation changes, letters and numbers of them; other words take the tokenizer's whole way ("|" begins the names of special tokens).
_LETTERS, _NUMBERS = r"a-zA-Z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f", r"0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_ODD = re.compile(r"[^!-{}~\u00a1-\u00ac\u00ae-\u012f\u0131-\u017f]")
#: ASCII marks that the split keeps together behind letters: all but the apostrophe, which may begin a part of its own, and "|".
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{}~"
#: _SPLIT for these characters.
_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")


class Kept(dict):
    """What compute() gives, kept for about `most` keys at least: once there are so many, they become the older ones, and those asked for again are taken over."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most, {}

    def __missing__(self, key: bytes) -> bytes:
        found = self.older.get(key)
        if found is None:
            found = self.compute(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found

    def forget(self) -> None:
        self.clear()
        self.older = {}


class Parts(Kept):
    """The ids of a lower-case part of a word that the split leaves, by the model."""

    def __init__(self, model, most: int):
        super().__init__(most)
        self.tokenize = model.tokenize
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in byte-level BPE
        others = [x for x in range(256) if x not in set(plain)]
        self.chars = {x: chr(x) for x in plain} | {x: chr(256 + i) for i, x in enumerate(others)}

    def compute(self, part: bytes) -> bytes:
        mapped = part.decode() if part.isascii() else "".join(map(self.chars.__getitem__, part))
        ids = [t.id for t in self.tokenize(mapped)]
        return struct.pack(f"<{len(ids)}I", *ids)


class Encoder(Kept):
    """Ids of texts as little-endian unsigned 32-bit bytes, equal to the tokenizer's own.

    Where the tokenizer's file says that no token spans white space, words are encoded alone, part by part, and their ids are kept here;
    words of unusual characters take the tokenizer's whole way. With another file, whole texts do.
    """

    def __init__(self, path: str, most: int = MOST_WORDS):
        super().__init__(most)
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        rules = json.loads(self.whole.to_str())
        self.wordwise = {k: rules.get(k) for k in _WORDWISE} == _WORDWISE and rules["model"]["type"] == "BPE"
        self.parts = Parts(self.whole.model, most)

    def _whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def compute(self, word: bytes) -> bytes:
        core = word.rstrip(_MARKS)
        if core.isalpha():  # ASCII letters, perhaps with marks behind them: one part, or two
            own = self.parts[core.lower()]
            return own if len(core) == len(word) else own + self.parts[word[len(core) :]]
        text = word.decode("utf-8")
        return self._whole(text) if _ODD.search(text) else b"".join([self.parts[p.encode()] for p in _PARTS.findall(text.lower())])

    def forget(self) -> None:
        super().forget()
        self.parts.forget()

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split())) if self.wordwise else self._whole(text.decode("utf-8"))


_loaded = lru_cache(maxsize=1)(Encoder)


@contextmanager
def encoder(path: str) -> Iterator[Encoder]:
    """A worker's own: the tokenizer is kept from task to task, the ids of words only until the task ends."""
    own = _loaded(path)
    try:
        yield own
    finally:
        own.forget()


def pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids with end_id behind them, cut only when longer than limit."""
    names = [x.split()[0] for x in PIECES.split(", ")]
    kinds = pa.schema(list(zip(names, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        with encoder(tokenizer) as words:
            for part, texts in chunks(batches):
                rows: list[tuple] = []
                for doc, text in zip(part.column(0).to_pylist(), texts):
                    ids = words.encode(text) + end
                    for i, at in enumerate(range(0, len(ids), 4 * limit)):
                        own = ids[at : at + 4 * limit]
                        rows.append((doc, i, at // 4, len(own) // 4, zlib.crc32(own)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)], schema=kinds)

    return docs.select("doc_id", text_bytes()).mapInArrow(cut, PIECES)


def best_fit(counts: dict[int, int], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: (lengths of a bin, number of such bins)."""
    open_bins: dict[int, list] = {}  # room left: [(lengths, number)]
    rooms: list[int] = []

    def put(room: int, lengths: tuple[int, ...], n: int) -> None:
        if room not in open_bins:
            open_bins[room] = []
            insort(rooms, room)
        open_bins[room].append((lengths, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect_left(rooms, length)
            if i == len(rooms):  # new bins, with as many of this length as fit
                each = limit // length
                full, rest = divmod(left, each)
                if full:
                    put(limit - each * length, (length,) * each, full)
                if rest:
                    put(limit - rest * length, (length,) * rest, 1)
                break
            room = rooms[i]
            lengths, n = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room], rooms[i]
            each = min(room // length, left)
            take = min(n, left // each)
            left -= each * take
            if n > take:
                put(room, lengths, n - take)
            put(room - each * length, lengths + (length,) * each, take)
    return [x for bins in open_bins.values() for x in bins]


def least_bins(counts: dict[int, int], limit: int) -> int:
    """No packing has fewer: the tokens' bound, and Martello and Toth's waste bound over all thresholds."""
    by = np.zeros(limit + 1, np.int64)
    by[list(counts)] = list(counts.values())
    number, tokens, half = np.cumsum(by), np.cumsum(by * np.arange(limit + 1)), limit // 2
    small = np.concatenate([[0], np.flatnonzero(by[: half + 1])])
    # those over limit - small are alone; those up to half get what room the middle ones leave
    alone = number[limit] - number[limit - small]
    middle, middle_tokens = number[limit - small] - number[half], tokens[limit - small] - tokens[half]
    low = tokens[half] - np.where(small > 0, tokens[small - 1], 0)
    waste = alone + middle + np.maximum(0, -(-(low - (middle * limit - middle_tokens)) // limit))
    return int(max(waste.max(), -(-tokens[limit] // limit)))


class Steps:
    """How many steps a search may still take."""

    def __init__(self, most: int):
        self.left = most

    def take(self) -> bool:
        self.left -= 1
        return self.left >= 0


class Level:
    """A bin of the search: the fillings that are left to try, of which one may waste no more than spare (None: no filling at all), and how many were tried."""

    def __init__(self, spare: int | None):
        self.ways: Iterator | None = None
        self.spare, self.tried = spare, 0


def completions(counts: dict[int, int], largest: int, limit: int, steps: Steps, least: int = 0) -> Iterator[tuple[int, ...]]:
    """The undominated fillings around one of the largest, longest lengths first, one at a time.

    A filling is dominated, and left out, if a length of it could be replaced by a larger one that is to be had and
    still fits (an added length replaces room), or two of its lengths by one at least as long as both together. least: tokens that the bin has to hold.
    """
    have = dict(counts)
    have[largest] -= 1
    lengths = sorted((k for k, n in have.items() if n and k <= limit - largest), reverse=True)
    ascending = lengths[::-1]

    def better(low: int, high: int) -> bool:
        """Whether a length in [low, high] is left."""
        for k in ascending[bisect_left(ascending, low) :]:
            if k > high:
                return False
            if have[k]:
                return True
        return False

    def undominated(way: list[int], room: int) -> bool:
        if better(1, room) or any(better(k + 1, k + room) for k in dict.fromkeys(way)):
            return False
        pairs = {x + y for i, x in enumerate(way) for y in way[i + 1 :]}
        return not any(better(p, p + room) for p in pairs)

    def build(way: list[int], at: int, room: int) -> Iterator[tuple[int, ...]]:
        """Fillings that go on from way with lengths from lengths[at] on."""
        if not steps.take():
            return
        for i in range(at, len(lengths)):
            k = lengths[i]
            if k <= room and have[k]:
                have[k] -= 1
                way.append(k)
                yield from build(way, i, room - k)
                way.pop()
                have[k] += 1
                if steps.left < 0:
                    return
        if limit - room >= least and undominated(way, room):
            yield tuple(way)

    yield from build([], 0, limit - largest)


def solve(counts: dict[int, int], limit: int = LIMIT, most_nodes: int = MOST_NODES) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a bin, number of such bins), as few bins as the search finds; pieces of the whole limit are bins of their own.

    Bin completion: the largest length left is put with an undominated filling, as often as the counts allow and then once,
    then the next. Branches end once their bins and the bound on what is left reach the incumbent, which best-fit over what is left
    improves. The search ends when nothing is left to try (the solution has the fewest bins), at the lower bound, or after
    most_nodes steps with the best solution so far; least_bins then says how far off it may be.
    """
    rest = {k: n for k, n in counts.items() if n and k < limit}
    whole = [((limit,), counts[limit])] if counts.get(limit) else []
    if not rest:
        return whole
    best = best_fit(rest, limit)
    goal, size = least_bins(rest, limit), lambda s: sum(n for _, n in s)
    left, done, used, nodes, steps = dict(rest), [], 0, 0, Steps(most_nodes)

    def tries(left: dict[int, int], spare: int) -> Iterator[tuple[tuple[int, ...], int]]:
        """Fillings and how often each, of which a bin may waste no more than spare."""
        largest = max(left)
        for filling in completions(left, largest, limit, steps, limit - spare):
            way = (largest, *filling)
            most = min(left[k] // way.count(k) for k in set(way))
            yield way, most
            if most > 1:
                yield way, 1

    tokens = sum(k * n for k, n in left.items())
    spare = lambda: (size(best) - 1 - used) * limit - sum(k * n for k, n in left.items())
    if -(-tokens // limit) >= size(best):
        return whole + best
    depth = [Level(spare())]  # one for each bin placed; a step is undone when its branch ends
    while depth and size(best) > goal and steps.take():
        level = depth[-1]
        if level.ways is None:  # its fillings so far are built again
            level.ways = iter(()) if level.spare is None else tries(left, level.spare)
            for _ in range(level.tried):
                next(level.ways, None)
        level.tried += 1
        step = next(level.ways, None)
        if step is None:
            depth.pop()
            if done:
                way, times = done.pop()
                used -= times
                left = left | {k: left.get(k, 0) + times * way.count(k) for k in set(way)}
            continue
        nodes += 1
        way, times = step
        left = left | {k: left[k] - times * way.count(k) for k in set(way)}
        left = {k: n for k, n in left.items() if n}
        done.append(step)
        used += times
        if len(depth) >= OPEN_LEVELS:
            depth[-OPEN_LEVELS].ways = None
        if used + least_bins(left, limit) >= size(best):  # its waste is too much already, or it is complete and no better
            depth.append(Level(None))
            continue
        if not left or nodes % 16 == 0:
            tail = best_fit(left, limit) if left else []
            if used + size(tail) < size(best):
                best = done + tail
        depth.append(Level(spare() if left else None))
    return whole + best


def slots(solution: list[tuple[tuple[int, ...], int]], limit: int) -> dict[str, np.ndarray]:
    """For each length, ranges of ranks: key (length << 44 | first rank), sequence of the first rank, offset within it."""
    used = dict.fromkeys(range(limit + 1), 0)
    key, sequence, offset, at = [], [], [], 0
    for lengths, n in solution:
        place = 0
        for k in lengths:
            key.append(k << 44 | used[k])
            sequence.append(at)
            offset.append(place)
            used[k] += n
            place += k
        at += n
    order = np.argsort(key)
    return {"key": np.array(key, np.int64)[order], "sequence": np.array(sequence, np.int64)[order], "offset": np.array(offset, np.int64)[order]}


def pack(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end_id: int = END_ID, most_nodes: int = MOST_NODES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty: a document of end_id alone. Texts of any length are encoded whole; a task holds one of them, or a batch.
    Pieces of a sequence lie side by side from offset 0. Pieces of equal length change places freely; they are ordered by doc_id, piece and
    ids. An empty table gives no rows; repeated rows and rows with a null doc_id are packed each; other columns are ignored.
    """
    p = stored(pieces(docs, tokenizer, limit, end_id), "pieces")
    sizes = stored(p.groupBy("length").agg(F.count("*").alias("n")), "lengths")  # at most `limit` rows
    counts = {r["length"]: r["n"] for r in sizes.collect()}
    often = sizes.select("length", F.ceil(F.col("n") / BUCKET_PIECES).alias("buckets"))
    p = p.join(F.broadcast(often), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("buckets")))
    by = p.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    by = stored(by.withColumn("first", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")), "ranks")
    table = slots(solve(counts, limit, most_nodes), limit)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("length", "rank"))
            i = np.searchsorted(table["key"], length << 44 | rank, side="right") - 1
            sequence = table["sequence"][i] + (rank - (table["key"][i] & ((1 << 44) - 1)))
            columns = [batch.column(k) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(table["offset"][i])], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = p.withColumn("row", F.row_number().over(order)).join(by.select("length", "bucket", "first"), ["length", "bucket"])
    names = [x.split()[0] for x in PIECES.split(", ")]
    return ranked.select(*names, (F.col("first") + F.col("row") - 1).alias("rank")).mapInArrow(place, PIECES + ", sequence_id long, offset long")
