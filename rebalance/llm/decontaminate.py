"""Benchmark decontamination by pigeonhole edit matching.

Texts are normalised (lower case; every run of other characters than letters,
digits and underscores becomes one space). An item of n characters may match
with ``k = n * rate`` edits. It is cut into k + 1 pieces, so one piece occurs
unchanged in any match. One automaton finds all pieces in one pass over every
whole text; each hit is confirmed by Myers' bit-parallel distance on the window
around it. Hits of one item on one diagonal band are confirmed together.

Items go to the tasks in chunks of at most ``CHUNK_CHARS`` characters (their sum
is measured first); a larger benchmark takes several passes over the documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rebalance.llm.common import row_slices

EDIT_RATE = 0.06
CHUNK_CHARS = 16_000_000
OTHER = re.compile(r"\W+")
SCHEMA = "doc_id long, item_id long, distance long, start long, end long"


def normalize(text: str) -> str:
    return OTHER.sub(" ", text.lower()).strip()


def origins(text: str) -> list[int]:
    """For every character of ``normalize(text)`` the place it comes from in ``text``."""
    low, place = [], []
    for i, c in enumerate(text):
        for x in c.lower():
            low.append(x)
            place.append(i)
    low, out = "".join(low), []
    last = 0
    for m in OTHER.finditer(low):
        out += place[last : m.start()]
        if out and m.end() < len(low):
            out.append(place[m.start()])
        last = m.end()
    return out + place[last:]


def budget(item: str, rate: float) -> int:
    return int(len(item) * rate)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length with their offsets."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(peq: dict[str, int], m: int, text: str, k: int) -> tuple[int, int] | None:
    """Smallest edit distance of the item to any part of ``text``, and where the part ends.

    None if it is over k. Ties take the first end.
    """
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = k + 1, 0
    get = peq.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return None if best > k else (best, end)


class Matcher:
    """Finds items, given as (item_id, normalised text), in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = [(i, t, budget(t, rate)) for i, t in items if t]
        self.masks = [(masks(t), masks(t[::-1])) for _, t, _ in self.items]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, k) in enumerate(self.items):
            for offset, piece in pieces(text, k):
                where.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of the best match of every item, in characters of ``text``."""
        if not self.items:
            return []
        low = normalize(text)
        diagonals: dict[tuple[int, int], int] = {}
        for last, (size, places) in self.automaton.iter(low):
            for n, offset in places:
                base = last + 1 - size - offset
                band = max(self.items[n][2], 1)
                diagonals.setdefault((n, base // band), base)
        best: dict[int, tuple[int, int, int]] = {}
        for (n, _), base in sorted(diagonals.items()):
            _, item, k = self.items[n]
            spare = 2 * max(k, 1)
            low_end = max(base - spare, 0)
            window = low[low_end : base + len(item) + spare]
            if found := myers(self.masks[n][0], len(item), window, k):
                distance, end = found
                # the reversed item meets the reversed part first where the match begins
                head = window[max(end - len(item) - k, 0) : end][::-1]
                back = myers(self.masks[n][1], len(item), head, k)
                length = back[1] if back and back[0] <= distance else min(len(item), end)
                got = (distance, low_end + end - length, low_end + end)
                best[n] = min(best.get(n, got), got)
        if not best:
            return []
        place = origins(text)
        return [(self.items[n][0], d, place[a], place[b - 1] + 1) for n, (d, a, b) in sorted(best.items())]


def _scan(items: list[tuple[int, str]], rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, rate)
        for batch in batches:
            for part in row_slices(batch, "text", 16 << 20):
                rows = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    if text:
                        rows += [(doc, *hit) for hit in matcher.find(text)]
                columns = list(zip(*rows)) or [[]] * 5
                names = ["doc_id", "item_id", "distance", "start", "end"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return run


def _without(items: list[tuple[int, str]], rate: float):
    """The rows of every batch in which no item is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, rate)
        for batch in batches:
            clean = [not (text and matcher.find(text)) for text in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run


def _chunks(benchmark: DataFrame, chunk_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items, normalised, in lists of about ``chunk_chars`` characters; at least one list."""
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks = max(1, -(-total // chunk_chars))
    for c in range(chunks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == c).collect()
        yield sorted({(r.item_id, normalize(r.text)) for r in part}, key=lambda x: (x[0] is None, x))


def matches(docs: DataFrame, benchmark: DataFrame, *, rate: float = EDIT_RATE, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, distance, start, end.

    ``docs(doc_id, text)`` and ``benchmark(item_id, text)`` may have more columns;
    they are ignored. distance is the least edit distance over normalised texts,
    start and end are code points of the original text. Null and empty texts,
    and items without a letter or digit, match nothing. Repeated rows each give
    their own result; an item text that several ids share is found for each.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    found = None
    for own in _chunks(benchmark, chunk_chars):
        hits = rows.mapInArrow(_scan(own, rate), SCHEMA)
        found = hits if found is None else found.unionByName(hits)
    return found


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, rate: float = EDIT_RATE, chunk_chars: int = CHUNK_CHARS
) -> DataFrame:
    """``docs``, all its columns, without the rows in whose text an item is found.

    Every row is judged by its own text, so ids may be missing or repeat. The chunks of a
    large benchmark are taken one after the other in one pass over the documents.
    """
    for own in _chunks(benchmark, chunk_chars):
        docs = docs.mapInArrow(_without(own, rate), docs.schema)
    return docs
