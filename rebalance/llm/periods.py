"""Periodic runs of words, found by a dictionary of basic factors.

For every power of two L the dictionary names the stretches of L words, so that
equal names mean equal stretches (a name of length 2L is a pair of names of length
L). Stretches that occur once are dropped at once; in ordinary prose little is left
beyond a few words.

A run of period q, L <= q < 2L, has at its first word a stretch of L words that
occurs again q words later. The occurrences of a stretch that follow each other by at
most L/2 form an arithmetic progression (its difference is the stretch's own
period). Distances inside a progression are multiples of that smaller period and
propose nothing; distances between two progressions less than 2L apart are the
proposed periods, one for each difference. Every proposal is extended to both sides
by the dictionary, in steps from long to short, and proposals that give the same
stretch are one run with the smallest period.

All texts of a slice are worked on together, as arrays; names never agree across
texts. Time and memory are of the order of words times the logarithm of the longest
repeated stretch, also for texts that are one long repetition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rebalance.llm.common import byte_texts, row_slices

MIN_WORDS = 12
SLICE_BYTES = 2 << 20
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Level:
    """Stretches of one length that occur at least twice: their names and places."""

    def __init__(self, size: int, n: int, places: np.ndarray, keys: np.ndarray):
        self.size = size
        order = np.argsort(keys, kind="stable")  # places of one name stay in order
        keys = keys[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = keys[1:] != keys[:-1]
        number = np.cumsum(fresh) - 1
        repeated = np.bincount(number, minlength=1)[number] > 1 if len(keys) else np.zeros(0, bool)
        self.places = places[order][repeated]
        self.group = number[repeated]
        self.names = np.full(n, -1, np.int32)
        self.names[self.places] = self.group

    def next(self) -> Level:
        """The level of twice the length."""
        n, size = len(self.names), self.size
        places = np.sort(self.places)
        places = places[places + size < n]
        first, second = self.names[places], self.names[places + size]
        places, first, second = (x[second >= 0] for x in (places, first, second))
        return Level(2 * size, n, places, first.astype(np.int64) * (n + 1) + second)

    def proposals(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, period) from progressions of occurrences, size <= period < 2 * size."""
        p, size = self.places, self.size
        none = np.zeros(0, np.int64)
        if not len(p):
            return none, none
        cut = np.ones(len(p), bool)
        cut[1:] = (np.diff(self.group) != 0) | (2 * np.diff(p) > size)
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(p)) - 1
        first, last, of = p[starts], p[ends], self.group[starts]
        step = np.where(ends > starts, p[np.minimum(starts + 1, len(p) - 1)] - first, 0)
        places, periods = [none], [none]
        for ahead in range(1, len(first)):
            near = (of[ahead:] == of[:-ahead]) & (first[ahead:] - last[:-ahead] < 2 * size)
            if not near.any():
                break
            a = np.flatnonzero(near)
            b = a + ahead
            base = first[b] - first[a]
            low = np.maximum(size, first[b] - last[a])
            high = np.minimum(2 * size - 1, last[b] - first[a])
            d = np.maximum(step[a], step[b])
            low = np.where(d > 0, low + (base - low) % np.maximum(d, 1), base)
            fits = (low >= size) & (low <= high)
            a, b, low, high, d = a[fits], b[fits], low[fits], high[fits], np.maximum(d[fits], 1)
            single = np.maximum(step[a], step[b]) == 0
            times = np.where(single, 1, (high - low) // d + 1)
            turn = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            a, b = np.repeat(a, times), np.repeat(b, times)
            q = np.repeat(low, times) + turn * np.repeat(d, times)
            short = np.maximum(first[b] - q - first[a], 0)
            own = np.maximum(step[a], 1)
            places.append(first[a] + -(-short // own) * own)
            periods.append(q)
        i, q = np.concatenate(places), np.concatenate(periods)
        # the same proposal one word earlier gives the same run
        left, right = self.names[np.maximum(i - 1, 0)], self.names[np.maximum(i - 1, 0) + q]
        new = (i == 0) | (left < 0) | (left != right)
        return i[new], q[new]


def runs(names: np.ndarray, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs in a sequence of word numbers, by start, then period.

    Texts may be put one after the other if no number is in two of them.
    """
    n = len(names)
    levels = [Level(1, n, np.arange(n), names)]
    while len(levels[-1].places):
        levels.append(levels[-1].next())
    found = [level.proposals() for level in levels]
    start, q = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    end = start + q
    low, high = start.copy(), end.copy()  # equal stretches begin here
    for level in reversed(levels):
        left, right = start - level.size, low + q - level.size
        same = left >= 0
        here = level.names[np.maximum(left, 0)]
        same &= (here >= 0) & (here == level.names[np.maximum(right, 0)])
        start = np.where(same, left, start)
        low = start
        here, there = level.names[np.minimum(high - q, max(n - 1, 0))], level.names[np.minimum(high, max(n - 1, 0))]
        same = (high < n) & (here >= 0) & (here == there)
        high = np.where(same, high + level.size, high)
    length = high - start
    good = length >= np.maximum(least, 2 * q)
    start, length, q = start[good], length[good], q[good]
    order = np.lexsort((q, length, start))
    start, length, q = start[order], length[order], q[order]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, q = start[fresh], length[fresh], q[fresh]
    order = np.lexsort((q, start))
    return start[order], length[order], q[order]


def _found(names: list[str], least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text", SLICE_BYTES):
                index: dict[bytes, int] = {}
                words = [text.split() for text in byte_texts(part, "text")]
                sizes = np.array([len(x) for x in words], np.int64)
                flat = [np.fromiter((index.setdefault(w, len(index)) for w in x), np.int64, len(x)) for x in words]
                owner = np.repeat(np.arange(len(words)), sizes)
                word = np.concatenate(flat) if flat else np.zeros(0, np.int64)
                start, length, period = runs(owner * max(len(index), 1) + word, least)
                first = np.cumsum(sizes) - sizes
                of = owner[start] if len(start) else start
                steps = np.zeros(len(word) + 1, np.int64)
                np.add.at(steps, start + period, 1)
                np.add.at(steps, start + length, -1)
                kept = np.cumsum(steps)[:-1] == 0
                texts = []
                for x, a, size in zip(words, first.tolist(), sizes.tolist()):
                    own = kept[a : a + size]
                    left = x if own.all() else [w for w, yes in zip(x, own.tolist()) if yes]
                    texts.append(b" ".join(left))
                offsets = np.searchsorted(of, np.arange(len(words) + 1)).astype(np.int32)
                values = pa.StructArray.from_arrays(
                    [pa.array(start - first[of]), pa.array(length), pa.array(period)], fields=list(RUN)
                )
                added = [
                    pa.array(sizes),
                    pa.ListArray.from_arrays(pa.array(offsets), values),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                ]
                own = [part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays(own + added, names=[*names, "n_words", "runs", "collapsed"])

    return run


def find_runs(docs: DataFrame, *, least: int = MIN_WORDS) -> DataFrame:
    """``docs(..., text, ...)`` plus n_words, runs and collapsed.

    Words are parted by ASCII blanks. ``runs`` lists (start, length, period) in words
    from 0, by start, then period: every stretch of at least ``least`` words and twice its
    smallest period that no neighbouring word extends. ``collapsed`` joins by one blank
    the words that no run holds after its first period. A null or blank text has no
    words, no runs, and an empty ``collapsed``. Columns of ``docs`` with the three
    names are replaced; rows never meet, so repeats give equal results.
    """
    kept = docs.drop("n_words", "runs", "collapsed")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    schema += ", n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return kept.mapInArrow(_found(kept.columns, least), schema)
