"""Katz backoff scoring of whole texts with word sequences of up to a given order.

``p(w | h)`` is the Good-Turing discounted share of w after h where the sequence was
seen in training, else the backoff weight of h times ``p(w | h')``, h' being h without
its oldest word; this goes on down to ``p(w)``, which is discounted likewise, and whose
missing mass is the chance of an unknown word. A history never seen in training has
weight one. The weights make every distribution sum to one exactly (up to rounding).
Before its first word a text has as many end tokens as a history needs.

Data flow, all of it in tables on the shared folder and plain joins and groups:

1. Texts become blocks of a few MB: token numbers of the block and its words.
2. Each block sends its distinct words, packed, to buckets by hash of the word. A
   bucket adds up their counts and gives ids (the unigram table), and answers.
3. For each order from 2 on, each block sends its distinct sequences, with what it was
   told of the order below, in packed arrays to buckets by hash of the history; a history
   with more occurrences than a bucket should hold is spread by the word. A bucket adds
   up the counts of all blocks and sums for each history that weights are asked for.
4. Counts of counts, smoothed by a log-linear fit, give the Good-Turing discounts of the
   order. Each bucket makes the weights and answers the blocks, which know then all they
   send for the next order; after the last one they add up their documents.

Packed arrays keep the number of rows in a shuffle small: one for each block and
bucket. Everything grows with the input; nothing is capped.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rebalance.llm.common import row_slices
from rebalance.staging import drop_table, new_path, stage

BLOCK_BYTES = 6 << 20
BUCKET_WORDS = 400_000
BUCKET_GRAMS = 1_000_000
GT_MAX = 5  # counts above are not discounted
END = b""  # the end of a text, which is also the history of its first word

_U = np.uint64


def held_out_seventh(doc_id: int | None) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 7 == 2


_NARROW = ["i1", "i2", "i4"]


@lru_cache(1)
def _codec():
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _narrow(a: np.ndarray) -> int:
    """How many of the kinds above are too narrow for the whole numbers of ``a``."""
    wide = min(len(_NARROW), a.dtype.itemsize.bit_length() - 1)
    if a.dtype.kind not in "iu" or not len(a):
        return len(_NARROW)
    low, high = a.min(), a.max()
    fits = (i for i, k in enumerate(_NARROW[:wide]) if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return next(fits, len(_NARROW))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length as one compressed value; equal bytes of the items lie together."""
    narrow = [_narrow(a) for a in arrays]
    planes = [bytes(narrow)]
    for a, i in zip(arrays, narrow):
        a = np.ascontiguousarray(a, _NARROW[i] if i < len(_NARROW) else a.dtype)
        planes.append(a.view("u1").reshape(len(a), a.dtype.itemsize).T.tobytes())
    return _codec()[0].compress(b"".join(planes))


def unpack(raw: bytes, *kinds: str) -> list[np.ndarray]:
    data = _codec()[1].decompress(raw)
    stored = [_NARROW[i] if i < len(_NARROW) else k for i, k in zip(data, kinds)]
    widths = [np.dtype(k).itemsize for k in stored]
    n = (len(data) - len(kinds)) // sum(widths)
    out, at = [], len(kinds)
    for k, own, width in zip(kinds, stored, widths):
        planes = np.frombuffer(data, "u1", n * width, at).reshape(width, n)
        out.append(planes.T.copy().view(own).reshape(n).astype(k, copy=False))
        at += n * width
    return out


def tuple_numbers(*columns: np.ndarray) -> np.ndarray:
    """One number for each tuple of whole numbers from -1 up; the numbers keep the order of the tuples."""
    code, span = np.zeros(len(columns[0]), np.int64), 1
    for c in columns:
        c = c.astype(np.int64) + 1
        size = int(c.max(initial=0)) + 1
        if span * size >= 1 << 62:  # ranks instead, of which there are no more than rows
            code, c = (np.unique(x, return_inverse=True)[1].astype(np.int64) for x in (code, c))
            span, size = len(code), len(c)
        code = code * size + c
        span *= size
    return code


def smoothed_slope(counts: list[int]) -> float | None:
    """Slope of log n_r over log r by least squares; None for fewer than two counts that are not 0."""
    points = [(math.log(r), math.log(n)) for r, n in enumerate(counts, 1) if n > 0]
    if len(points) < 2:
        return None
    x_mean, y_mean = (sum(p[k] for p in points) / len(points) for k in (0, 1))
    spread = sum((x - x_mean) ** 2 for x, _ in points)
    return sum((x - x_mean) * (y - y_mean) for x, y in points) / spread


def discounts(counts: list[int], most: int = GT_MAX) -> list[float]:
    """Good-Turing discount ratios for counts 0 to ``most`` from n_1 .. n_(most + 1).

    Counts of counts are smoothed by a line through (log r, log n_r), which gives the
    ratio r* / r as ``(1 + 1/r) ** (slope + 1)``. From r = 1 on the plain Turing ratio
    ``(r + 1) n_(r+1) / (r n_r)`` is used instead while it lies in (0, 1) and differs from
    the line by more than 1.65 of its standard deviations; once it does not, the line
    holds for all greater r. Katz's correction leaves counts above ``most`` as they are.
    A slope of -1 or more, or no two counts to fit, gives ``(r - 1/2) / r``.
    """
    n = [0, *counts[: most + 1]]
    slope = smoothed_slope(n[1:])
    if slope is None or slope >= -1:
        return [1.0] + [(r - 0.5) / r for r in range(1, most + 1)]
    common = (most + 1) ** (slope + 1)
    out, plain = [1.0], True
    for r in range(1, most + 1):
        ratio = (1 + 1 / r) ** (slope + 1)
        if plain and n[r] and n[r + 1]:
            turing = (r + 1) * n[r + 1] / (r * n[r])
            error = (r + 1) / r * math.sqrt(n[r + 1] / n[r] ** 2 * (1 + n[r + 1] / n[r]))
            plain = common < turing < 1 and abs(turing - ratio) > 1.65 * error
            ratio = turing if plain else ratio
        else:
            plain = False
        out.append((ratio - common) / (1 - common))
    return out


class Unigrams:
    """p(w) from a word's count; made on the driver from a few totals."""

    def __init__(self, tokens: int, words: int, counts: list[int], covered: list[int]):
        self.tokens, self.words = tokens, words
        self.ratio = np.array(discounts(counts))
        kept = sum(float(d) * c for d, c in zip(self.ratio[1:], covered[:GT_MAX])) + (tokens - sum(covered[:GT_MAX]))
        self.unknown = 1 - kept / tokens if tokens else 1.0
        if self.unknown <= 0:
            self.unknown = 1 / (tokens + words + 1)
        self.scale = (1 - self.unknown) / kept if kept else 0.0

    def chance(self, counts: np.ndarray) -> np.ndarray:
        c = counts.astype(np.float64)
        known = self.scale * c * np.where(counts <= GT_MAX, self.ratio[np.minimum(counts, GT_MAX)], 1.0)
        return np.where(counts > 0, known, self.unknown)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch one after the other; a row of a block is several MB."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_numbers(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of all texts, END among them; the number of every token; the tokens of each text."""
    import pyarrow.compute as pc

    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    if END not in words:
        words.append(END)
    end, token = words.index(END), coded.indices.to_numpy(zero_copy_only=False)
    real = token != end  # blanks around a text give empty words, which are left out
    until = np.concatenate([[0], np.cumsum(real)])[split.offsets.to_numpy() - split.offsets[0].as_py()]
    return words, np.insert(token[real], until[1:], end).astype(np.uint32), np.diff(until) + 1


def _blocked(held_out: Callable[[int | None], bool]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in row_slices(batch, "text", BLOCK_BYTES):
                words, token, sizes = word_numbers(part.column("text"))
                ids = part.column("doc_id").cast(pa.int64()).to_pylist()
                train = [not held_out(i) for i in ids]
                counts = np.bincount(token[np.repeat(train, sizes)], minlength=len(words))
                order = np.argsort(_hashes(words))  # the block's words are numbered by hash
                rank = np.empty(len(order), np.uint32)
                rank[order] = np.arange(len(order))
                row = {
                    "block": serial,
                    "doc_ids": ids,
                    "sizes": sizes.tolist(),
                    "train": train,
                    "tokens": pack(rank[token]),
                    "words": pack(np.frombuffer(b"\n".join([words[i] for i in order.tolist()]), np.uint8)),
                    "counts": pack(counts[order].astype("i8")),
                    "n_words": len(words),
                    "end": int(rank[words.index(END)]),
                }
                serial += 1
                yield pa.RecordBatch.from_pylist([row], schema=_BLOCK)

    return run


def _hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


_BLOCK = pa.schema(
    [
        ("block", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("sizes", pa.list_(pa.int32())),
        ("train", pa.list_(pa.bool_())),
        ("tokens", pa.binary()),
        ("words", pa.binary()),
        ("counts", pa.binary()),
        ("n_words", pa.int32()),
        ("end", pa.int32()),
    ]
)
_BLOCK_SQL = (
    "block long, doc_ids array<long>, sizes array<int>, train array<boolean>, tokens binary, words binary, counts binary, "
    "n_words int, `end` int"
)


def _words_sent(buckets: int):
    """Rows (bucket, block, words, counts) of every block; words in the order of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                (raw,), (counts,) = unpack(row["words"], "u1"), unpack(row["counts"], "i8")
                words = raw.tobytes().split(b"\n")
                bucket = (_hashes(words) >> _U(32)) * _U(buckets) >> _U(32)
                cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64)).tolist()
                out = {"bucket": [], "block": [], "words": [], "counts": []}
                for b, (low, high) in enumerate(zip(cut, cut[1:])):
                    if low < high:
                        out["bucket"].append(b)
                        out["block"].append(row["block"])
                        out["words"].append(pack(np.frombuffer(b"\n".join(words[low:high]), np.uint8)))
                        out["counts"].append(pack(counts[low:high]))
                yield pa.RecordBatch.from_pydict(
                    out, schema=pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())])
                )

    return run


_UNIGRAM = pa.schema(
    [("bucket", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), ("words", pa.binary()), ("n", pa.int64()), ("c", pa.int64())]
    + [(f"m{r}", pa.int64()) for r in range(1, GT_MAX + 2)]
)
_UNIGRAM_SQL = "bucket int, block long, ids binary, words binary, n long, c long, " + ", ".join(
    f"m{r} long" for r in range(1, GT_MAX + 2)
)


def _words_summed(buckets: int):
    """One bucket of words: its part of the unigram table, and (id, count) told to each block."""

    def run(rows: pa.Table) -> pa.Table:
        return _summed_words(rows, buckets)

    return run


def _summed_words(rows: pa.Table, buckets: int) -> pa.Table:
    rows = rows.select(["bucket", "block", "words", "counts"]).to_pylist()
    index: dict[bytes, int] = {}
    places, sums = [], []
    for r in rows:
        own = unpack(r["words"], "u1")[0].tobytes().split(b"\n")
        places.append(np.array([index.setdefault(w, len(index)) for w in own], np.int64))
        sums.append(unpack(r["counts"], "i8")[0])
    flat = np.concatenate(places)
    total = np.zeros(len(index), np.int64)
    np.add.at(total, flat, np.concatenate(sums))
    place = np.empty(len(total), np.int64)
    place[np.argsort(-total, kind="stable")] = np.arange(len(total))  # frequent words get small ids, which pack well
    ids = np.where(total > 0, place * buckets + rows[0]["bucket"], -1)
    out = [{"bucket": r["bucket"], "block": r["block"], "ids": pack(ids[p], total[p])} for r, p in zip(rows, places)]
    stored = {"bucket": rows[0]["bucket"], "n": int((total > 0).sum()), "c": int(total.sum())}
    stored["words"] = pack(np.frombuffer(b"\n".join(index), np.uint8))
    stored["ids"] = pack(ids, total)
    stored |= {f"m{r}": int((total == r).sum()) for r in range(1, GT_MAX + 2)}
    return pa.Table.from_pylist([*out, stored], schema=_UNIGRAM)


_STATE = pa.schema(
    [
        ("block", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("sizes", pa.list_(pa.int32())),
        ("train", pa.list_(pa.bool_())),
        ("tokens", pa.binary()),
        ("words", pa.binary()),
        ("end", pa.int32()),
        ("levels", pa.list_(pa.binary())),
    ]
)
_STATE_SQL = (
    "block long, doc_ids array<long>, sizes array<int>, train array<boolean>, tokens binary, words binary, `end` int, levels array<binary>"
)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks whose words are numbered by id; all words unknown to the model have one number, the last."""
    for batch in batches:
        for row in _rows(batch):
            (token,) = unpack(row["tokens"], "u4")
            told = [unpack(x["ids"], "i8", "i8") for x in sorted(row.pop("known"), key=lambda x: x["bucket"])]
            ids, counts = (np.concatenate([x[k] for x in told]) for k in (0, 1))
            known = int((ids >= 0).sum())
            order = np.argsort(np.where(ids >= 0, ids, np.iinfo(np.int64).max))
            rank = np.empty(len(ids), np.uint32)
            rank[order] = np.minimum(np.arange(len(ids)), known)
            own = order[:known]
            row["tokens"] = pack(rank[token])
            row["words"] = pack(np.diff(ids[own], prepend=0), counts[own])
            row["end"] = int(rank[row["end"]])
            row["levels"] = []
            yield pa.RecordBatch.from_pylist([{f.name: row[f.name] for f in _STATE}], schema=_STATE)


class Level:
    """The distinct sequences of one order in a block, and what the model told of them.

    ``place`` is the sequence at a position, -1 where the history has an unknown word, and
    ``first`` one position of each sequence. Of each sequence the highest order also has its
    numbers of words (``keys`` the history, latest word first, and ``word``) and ``hist``,
    equal for equal histories; orders below have ``count``, ``total`` and ``alpha`` as told.
    """

    def __init__(self, code: np.ndarray, hist: np.ndarray, word: np.ndarray, keys: list[np.ndarray], told: bytes | None):
        order = np.argsort(code)
        code = code[order]
        new = np.ones(len(code), bool)
        new[1:] = code[1:] != code[:-1]
        self.place = np.empty(len(code), np.int32)
        self.place[order] = np.cumsum(new) - 1
        self.first = order[new]
        if len(code) and code[0] < 0:
            self.first, self.place = self.first[1:], self.place - 1
        if told is not None:
            self.count, self.total, self.alpha = unpack(told, "i8", "i8", "f8")
        else:
            self.hist, self.word = hist[self.first], word[self.first]
            self.keys = [k[self.first] for k in keys]


class Grams:
    """A block and its sequences of the orders 2 to ``most``."""

    def __init__(self, row: dict, most: int):
        self.sizes = np.array(row["sizes"], np.int64)
        step, counts = unpack(row["words"], "i8", "i8")
        self.ids, self.counts = np.append(np.cumsum(step), -1), np.append(counts, 0)
        base = len(self.ids)
        self.token = unpack(row["tokens"], "u4")[0].astype(np.int32)
        self.end = end = row["end"]
        self.levels: list[Level] = []
        before, keys, known = self.token, [], np.ones(len(self.token), bool)
        for n in range(2, most + 1):
            older = np.full_like(self.token, end)
            older[n - 1 :] = self.token[: max(0, len(older) - n + 1)]
            if n > 2:
                older[before == end] = end  # nothing stands before a text but ends
            before = older
            keys.append(before)
            known &= before < base - 1
            hist, code = tuple_numbers(*keys), tuple_numbers(*keys, self.token)
            code[~known] = -1
            told = row["levels"][n - 2] if n - 2 < len(row["levels"]) else None
            self.levels.append(Level(code, hist, self.token, keys, told))

    def trained(self, row: dict) -> np.ndarray:
        """Occurrences in training rows of each sequence of the highest order."""
        top = self.levels[-1]
        yes = np.repeat(np.array(row["train"], bool), self.sizes) & (top.place >= 0)
        return np.bincount(top.place[yes], minlength=len(top.word))

    def dealt(self, buckets: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the highest order: bucket of each sequence, their order by bucket, and whether the history
        is spread, since it has over ``most`` occurrences."""
        top = self.levels[-1]
        if len(self.levels) == 1:
            often = self.counts[top.keys[0]]
        else:  # the history ends one position earlier; a text's first word follows ends alone
            below = self.levels[-2]
            place = below.place[np.maximum(top.first - 1, 0)]
            often = np.where(top.keys[0] == self.end, self.counts[self.end], below.count[np.maximum(place, 0)] if len(below.count) else 0)
        hot = often > most
        mixed = _mix((self.ids + 2).view(_U))
        key = mixed[top.keys[0]]
        for k in top.keys[1:]:
            key = key * _U(0x9E3779B97F4A7C15) + mixed[k]
        if hot.any():
            key = np.where(hot, key * _U(0x9E3779B97F4A7C15) + mixed[top.word], key)
        bucket = ((key >> _U(32)) * _U(buckets) >> _U(32)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
        return bucket, np.argsort(bucket, kind="stable"), hot


def _kinds(n: int) -> list[str]:
    """History, word, count, count and signed total of the order below, spread or not."""
    return ["i8"] * n + ["i4", "i8", "i8", "i1"]


def _sent(n: int, buckets: int, most: int):
    """Rows (bucket, block, grams) of every block: its sequences of n words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                p = Grams(row, n)
                top = p.levels[-1]
                bucket, order, hot = p.dealt(buckets, most)
                cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
                if n == 2:
                    low, total = p.counts[top.word], np.zeros(len(top.word), np.int64)
                else:
                    below = p.levels[-2]
                    at = below.place[top.first]
                    low, total = below.count[at], below.total[at]
                columns = [*(p.ids[k] for k in top.keys), p.ids[top.word], p.trained(row).astype("i4"), low, total, hot.view("i1")]
                columns = [c[order] for c in columns]
                out = {"bucket": [], "block": [], "grams": []}
                for b in range(buckets):
                    if cut[b] < cut[b + 1]:
                        part = [c[cut[b] : cut[b + 1]] for c in columns]
                        part[0] = np.diff(part[0], prepend=0)
                        out["bucket"].append(b)
                        out["block"].append(row["block"])
                        out["grams"].append(pack(*part))
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("grams", pa.binary())]))

    return run


def shares(count: np.ndarray, total: np.ndarray, ratio: list[float]) -> np.ndarray:
    """Discounted share of ``count`` in the occurrences of its history.

    A total below 0 says that nothing was discounted there: one more occurrence is set aside.
    """
    part = count * np.array([*ratio, 1.0])[np.minimum(count, GT_MAX + 1)]
    return part / np.maximum(np.where(total < 0, 1 - total, total), 1)


_SUMS = ["c", "big", *(f"m{r}" for r in range(1, GT_MAX + 1)), "seen"]
_SUM_KINDS = ["i8"] * (GT_MAX + 2) + ["f8"]
_TOLD = [("block", pa.int64()), *((x, pa.binary()) for x in ("counts", "totals", "asked", "spread"))]
_HOT = [("h", pa.list_(pa.int64())), ("at", pa.int64()), *((x, pa.float64() if x == "seen" else pa.int64()) for x in _SUMS)]
_SUMMED = pa.schema(
    [("bucket", pa.int32()), ("told", pa.list_(pa.struct(_TOLD))), ("kept", pa.binary()), ("hot", pa.list_(pa.struct(_HOT)))]
    + [(f"m{r}", pa.int64()) for r in range(1, GT_MAX + 2)]
)
_SUMMED_SQL = (
    "bucket int, told array<struct<block: long, counts: binary, totals: binary, asked: binary, spread: binary>>, kept binary, "
    + "hot array<struct<h: array<long>, at: long, "
    + ", ".join(f"{x}: {'double' if x == 'seen' else 'long'}" for x in _SUMS)
    + ">>, "
    + ", ".join(f"m{r} long" for r in range(1, GT_MAX + 2))
)


def _summed(n: int, unigrams: Unigrams, ratio: list[float] | None):
    """One bucket: counts of its sequences and totals of their histories for each block, and
    sums of those histories that were seen and that some block needs the weight of."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.select(["bucket", "block", "grams"]).to_pylist()
        parts = [unpack(r.pop("grams"), *_kinds(n)) for r in rows]
        cuts = np.cumsum([0, *(len(p[0]) for p in parts)])
        for p in parts:
            p[0] = np.cumsum(p[0])
        *keys, w, own, low, low_total, spread = (np.concatenate([p[k] for p in parts]) for k in range(n + 4))
        del parts
        order = np.argsort(tuple_numbers(*keys, w))
        new_h = np.ones(len(w), bool)
        new_h[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
        new_g = new_h.copy()
        new_g[1:] |= w[order][1:] != w[order][:-1]
        start = np.flatnonzero(new_g)
        count = np.add.reduceat(own[order].astype(np.int64), start)
        mine, of = np.empty(len(w), np.int64), np.empty(len(w), np.int64)
        mine[order] = count[np.cumsum(new_g) - 1]
        of[order] = np.cumsum(new_h) - 1
        first = order[start]
        heads = np.flatnonzero(new_h[start])  # the first sequence of each history
        chance = unigrams.chance(low[first]) if n == 2 else shares(low[first], low_total[first], ratio)
        sums = {"c": np.add.reduceat(count, heads), "big": np.add.reduceat(np.where(count > GT_MAX, count, 0), heads)}
        for r in range(1, GT_MAX + 1):
            sums[f"m{r}"] = np.add.reduceat((count == r).astype(np.int64), heads)
        sums["seen"] = np.add.reduceat(np.where(count > 0, chance, 0.0), heads)
        hot = spread[first[heads]] != 0
        total = np.where(hot, 0, np.where(sums["big"] == sums["c"], -sums["c"], sums["c"]))
        known = hot | (sums["c"] > 0)
        kept, runs = hot.copy(), []
        for a, b in zip(cuts, cuts[1:]):
            at = np.flatnonzero(np.diff(of[a:b], prepend=-1))
            hs = of[a:b][at]
            asked = np.logical_or.reduceat(mine[a:b] == 0, at) & known[hs]
            kept[hs[asked]] = True
            runs.append((hs, asked))
        number = np.cumsum(kept) - 1
        told = []
        for r, a, b, (hs, asked) in zip(rows, cuts, cuts[1:], runs):
            far = np.flatnonzero(hot[hs])
            told.append(
                {
                    "block": r["block"],
                    "counts": pack(mine[a:b]),
                    "totals": pack(total[hs]),
                    "asked": pack(np.diff(number[hs[asked]], prepend=0)),
                    "spread": pack(far, number[hs[far]]),
                }
            )
        row = {"bucket": rows[0]["bucket"], "told": told, "kept": pack(*(sums[x][kept] for x in _SUMS))}
        row["hot"] = [
            {"h": [int(k[first[heads[i]]]) for k in keys], "at": int(number[i]), **{x: sums[x][i].item() for x in _SUMS}}
            for i in np.flatnonzero(hot).tolist()
        ]
        row |= {f"m{r}": int((count == r).sum()) for r in range(1, GT_MAX + 2)}
        return pa.Table.from_pylist([row], schema=_SUMMED)

    return run


_ANSWERS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("counts", pa.binary()), ("totals", pa.binary()), ("alphas", pa.binary())])
_ANSWERS_SQL = "block long, bucket int, counts binary, totals binary, alphas binary"


def _answered(ratio: list[float], hot: dict[tuple, list]):
    """Counts, totals and backoff weights told to each block; ``hot`` has the sums of spread histories."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                sums = dict(zip(_SUMS, unpack(row["kept"], *_SUM_KINDS)))
                for x in row["hot"]:
                    for name, value in zip(_SUMS, hot[tuple(x["h"])]):
                        sums[name][x["at"]] = value
                c = sums["c"]
                used = sums["big"].astype(np.float64)
                for r in range(1, GT_MAX + 1):
                    used = used + ratio[r] * r * sums[f"m{r}"]
                flat = sums["big"] == c  # nothing was discounted: one more occurrence is set aside
                alpha = np.where(flat, 1 / (c + 1), 1 - used / np.maximum(c, 1)) / (1 - sums["seen"])
                out = {x: [] for x in _ANSWERS.names}
                for r in row["told"]:
                    (total,) = unpack(r["totals"], "i8")
                    far, at = unpack(r["spread"], "i8", "i8")
                    total[far] = np.where(flat[at], -c[at], c[at])
                    out["block"].append(r["block"])
                    out["bucket"].append(row["bucket"])
                    out["counts"].append(r["counts"])
                    out["totals"].append(pack(total))
                    out["alphas"].append(pack(alpha[np.cumsum(unpack(r["asked"], "i8")[0])]))
                yield pa.RecordBatch.from_pydict(out, schema=_ANSWERS)

    return run


def _learnt(p: Grams, answers: list[dict] | None, buckets: int, most: int) -> None:
    """Set count, total and alpha of the highest order from the answers of the buckets."""
    top = p.levels[-1]
    told = sorted(answers or [], key=lambda x: x["bucket"])
    n = len(top.word)
    top.count, top.total, top.alpha = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    if not n:
        return
    bucket, order, _ = p.dealt(buckets, most)
    counts, totals = (np.concatenate([unpack(x[k], "i8")[0] for x in told]) for k in ("counts", "totals"))
    new = np.ones(n, bool)
    new[1:] = (np.diff(top.hist[order]) != 0) | (bucket[order][1:] != bucket[order][:-1])
    start, run = np.flatnonzero(new), np.cumsum(new) - 1
    alpha = np.ones(len(start))
    alpha[np.logical_or.reduceat(counts == 0, start) & (totals != 0)] = np.concatenate([unpack(x["alphas"], "f8")[0] for x in told])
    top.count[order] = counts
    top.total[order] = np.where(counts > 0, totals[run], 0)
    top.alpha[order] = np.where(counts > 0, 0.0, alpha[run])


def _levelled(n: int, buckets: int, most: int):
    """The blocks with what they were told of the sequences of n words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                p = Grams(row, n)
                _learnt(p, row.pop("answers"), buckets, most)
                top = p.levels[-1]
                row["levels"].append(pack(top.count, top.total, top.alpha))
                yield pa.RecordBatch.from_pylist([row], schema=_STATE)

    return run


def _scored(unigrams: Unigrams, ratios: list[list[float]], buckets: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                p = Grams(row, len(ratios) + 1)
                _learnt(p, row.pop("answers"), buckets, most)
                chance = unigrams.chance(p.counts)[p.token]
                for level, ratio in zip(p.levels, ratios):
                    # a sequence that was seen has no alpha, one that was not has no share; place -1 is the last item
                    share = np.append(shares(level.count, level.total, ratio), 0.0)
                    chance = share[level.place] + np.append(level.alpha, 1.0)[level.place] * chance
                n = len(p.sizes)
                owner = np.repeat(np.arange(n, dtype=np.int32), p.sizes)
                base = np.log10((p.counts + 1) / (unigrams.tokens + unigrams.words + 1))[p.token]
                total = lambda x: np.bincount(owner, weights=x, minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array([not t for t in row["train"]], pa.bool_()),
                        pa.array(p.sizes),
                        pa.array(total((p.counts > 0)[p.token]).astype(np.int64)),
                        pa.array(np.full(n, unigrams.tokens)),
                        pa.array(total(base)),
                        pa.array(total(np.log10(chance))),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def score(docs: DataFrame, held_out: Callable[[int | None], bool], order: int = 2, bucket_grams: int = BUCKET_GRAMS) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: counts and log10 probabilities.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens (N), base_score
    (add-one unigrams), score (Katz, histories of up to ``order`` - 1 words). Rows for
    whose id ``held_out`` is false train the model. Words are parted by ASCII blanks, A-Z
    lower-cased; each text ends with an end token. A null text counts as empty; a null id
    is passed on as None; repeated rows count as often as they occur. Without training
    rows only unknown words exist, with probability 1. Other columns are ignored.
    A bucket of sequences gets some ``bucket_grams`` tokens.
    """
    if order < 2:
        raise ValueError("order has to be 2 or more")
    spark = docs.sparkSession
    paths = {}

    def staged(df: DataFrame, name: str) -> DataFrame:
        paths[name] = new_path(spark, name)
        return stage(df, name, paths[name])

    def drop(*names: str) -> None:
        for name in names:
            drop_table(spark, paths[name])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    blocks = staged(rows.mapInArrow(_blocked(held_out), _BLOCK_SQL), "blocks")
    ms = [f"m{r}" for r in range(1, GT_MAX + 2)]
    n_words = blocks.agg(F.sum("n_words")).first()[0] or 0
    word_buckets = max(1, -(-n_words // BUCKET_WORDS))
    sent = blocks.select("block", "words", "counts").mapInArrow(
        _words_sent(word_buckets), "bucket int, block long, words binary, counts binary"
    )
    vocabulary = staged(sent.groupBy("bucket").applyInArrow(_words_summed(word_buckets), _UNIGRAM_SQL), "unigrams")
    told = vocabulary.where("block is null").agg(F.sum("c"), F.sum("n"), *map(F.sum, ms)).first()
    tokens, words, *counts = (x or 0 for x in told)
    unigrams = Unigrams(tokens, words, counts, [r * n for r, n in enumerate(counts, 1)])
    all_tokens = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0
    buckets = max(1, -(-all_tokens // bucket_grams))
    known = vocabulary.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("bucket", "ids")).alias("known"))
    joined = blocks.drop("words", "counts", "n_words").join(known, "block")
    state = staged(joined.mapInArrow(_numbered, _STATE_SQL), "state1")
    drop("blocks", "unigrams")
    ratios: list[list[float]] = []
    for n in range(2, order + 1):
        sent = state.mapInArrow(_sent(n, buckets, bucket_grams), "bucket int, block long, grams binary")
        summed = sent.groupBy("bucket").applyInArrow(_summed(n, unigrams, ratios[-1] if ratios else None), _SUMMED_SQL)
        summed = staged(summed, f"grams{n}")
        seen = summed.agg(*map(F.sum, ms)).first()
        ratios.append(discounts([x or 0 for x in seen]))
        # sums of the histories spread over buckets, each of which has over bucket_grams occurrences
        spread = summed.select(F.inline("hot")).groupBy("h").agg(*[F.sum(x).alias(x) for x in _SUMS])
        hot = {tuple(r["h"]): [r[x] for x in _SUMS] for r in spread.collect()}
        answered = summed.mapInArrow(_answered(ratios[-1], hot), _ANSWERS_SQL)
        answers = answered.groupBy("block").agg(F.collect_list(F.struct("bucket", "counts", "totals", "alphas")).alias("answers"))
        joined = state.join(answers, "block", "left")
        if n < order:
            state = staged(joined.mapInArrow(_levelled(n, buckets, bucket_grams), _STATE_SQL), f"state{n}")
            drop(f"state{n - 1}", f"grams{n}")
    return joined.mapInArrow(
        _scored(unigrams, ratios, buckets, bucket_grams),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
