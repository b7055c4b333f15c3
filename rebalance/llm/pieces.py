"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The text is normalised by the model's own rules and cut before every run of the
blank mark, if no piece of the vocabulary has a blank mark behind another
character (this is looked up; else the text stays whole). No merge can cross
such a cut. Each segment is encoded with an agenda of its adjacent symbol pairs
ordered by score, then by place; the best live pair merges, and its new
neighbours join the agenda. The agendas of many short segments are columns of
one numpy table and advance together; a long segment has a heap of its own.
Segments repeat, so each Python worker remembers their ids from task to task.

Each new segment is checked against the sentencepiece library within its Arrow
batch. Should one differ, the library's ids count, and ``agrees`` is false.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain, compress, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from rebalance.llm.common import row_slices

BLANK = "▁"
REMEMBERED = 3 << 20  # characters of segments per Python worker, and EACH more for every segment
EACH = 8
FLAT = 48  # characters of a segment that shares a table with others
WIDE = 4096  # segments of a table
CHECKED = 64  # segments that the library encodes at once, as one text
NEVER = 1 << 62  # pairs that do not merge
DEAD = -1
SLICE_BYTES = 512 << 10  # of text at once; the work on them takes some 50 times that


def _ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs ``flat[start : start + size]`` one behind the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Pairs:
    """What two neighbouring symbols, given by number, merge to.

    Every left symbol has its own offset in one table, so that no two pairs share a slot.
    """

    def __init__(self, merges: list[tuple[int, int, int]], symbols: int):
        """``merges`` holds (left, right, value); numbers are below ``symbols``."""
        rows: dict[int, list[tuple[int, int]]] = {}
        for left, right, value in merges:
            rows.setdefault(left, []).append((right, value))
        room = max(8 * len(merges), 1)
        rng = np.random.default_rng(0)
        self.offset = np.zeros(symbols, np.int64)
        self.owner = np.full(room + symbols, DEAD, np.int32)
        self.value = np.full(room + symbols, NEVER, np.int64)
        for left in sorted(rows, key=lambda x: -len(rows[x])):
            right, value = np.array(rows[left], np.int64).T
            at = right
            while (self.owner[at] != DEAD).any():
                at = right + int(rng.integers(room))
            self.offset[left] = at[0] - right[0]
            self.owner[at], self.value[at] = left, value

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        at = self.offset[left] + right
        return np.where(self.owner[at] == left, self.value[at], NEVER)


class Encoder:
    """Ids of texts for one model file; see the module."""

    def __init__(self, model_file: str, check: bool = True):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.check = check
        self.cost: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.cost[piece], self.ids[piece] = -sp.get_score(i), i
        inner = any(BLANK in p.lstrip(BLANK) for p in self.ids)
        self.cuts = not inner
        self._number_symbols()
        # segments by number, and the ids of each, laid in a row
        self.place: defaultdict[str, int] = defaultdict()
        self.place.default_factory = self.place.__len__  # a new segment gets the next number
        self.flat, self.starts, self.sizes = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.same = np.empty(0, bool)
        self.met = np.empty(0, np.int64)  # slices that hold the segment, since the last ``_forget``
        self.weight = 0
        self.differ: set[str] = set()

    def _number_symbols(self) -> None:
        """Pieces have their id as number; ``none`` is no symbol; letters without an id follow as they are met."""
        self.none = self.library.get_piece_size()
        self.letter = np.full(0x110000, DEAD, np.int32)  # by code point
        self.spelt: list[list[int]] = []  # ids of the letters that follow
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.letter[ord(piece)] = i
        numbers = dict(self.ids)
        for c in sorted({c for p in self.ids for c in p} - numbers.keys()):
            numbers[c] = self._new_letter(c)
        rank = {x: i for i, x in enumerate(sorted(set(self.cost.values())))}
        merges = []
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                left, right = numbers.get(piece[:k]), numbers.get(piece[k:])
                if left is not None and right is not None:
                    # what the agenda sorts by: the rank of the score, (6 bits for the place,) the piece made
                    merges.append((left, right, rank[self.cost[piece]] << 38 | i))
        self.last = self.none + len(self.spelt)  # letters beyond are in no pair
        self.pairs = Pairs(merges, self.last + 2)

    def _new_letter(self, c: str) -> int:
        number = self.letter[ord(c)] = self.none + 1 + len(self.spelt)
        self.spelt.append([self.bytes[x] for x in c.encode()] if self.bytes else [self.library.unk_id()])
        return int(number)

    def _codes(self, segments: list[str]) -> np.ndarray:
        """The numbers of all characters, one behind the other."""
        points = np.frombuffer("".join(segments).encode("utf-32-le"), "<u4")
        codes = self.letter[points]
        if len(new := np.unique(points[codes == DEAD])):
            for x in new.tolist():
                self._new_letter(chr(x))
            codes = self.letter[points]
        return codes

    def merge(self, segment: str) -> list[int]:
        """Ids of one segment by a heap."""
        ids: list[int] = []
        for part in self._heap(segment):
            found = self.ids.get(part)
            if found is not None:
                ids.append(found)
            elif self.bytes:
                ids += [self.bytes[x] for x in part.encode()]
            elif not ids or ids[-1] != self.library.unk_id():
                ids.append(self.library.unk_id())
        return ids

    def _heap(self, segment: str) -> list[str]:
        """Symbols left; the agenda of a long segment is a heap, and symbols form a linked list."""
        cost, parts, n = self.cost.get, list(segment), len(segment)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[float, int, int, str]] = []

        def propose(i: int, j: int) -> None:
            both = parts[i] + parts[j]
            if (price := cost(both)) is not None:
                heappush(agenda, (price, i, j, both))

        for i in range(n - 1):
            propose(i, i + 1)
        while agenda:
            _, i, j, piece = heappop(agenda)
            if not parts[i] or not parts[j] or after[i] != j or parts[i] + parts[j] != piece:
                continue  # one side has merged meanwhile
            parts[i], parts[j] = piece, ""
            right = after[i] = after[j]
            if right < n:
                before[right] = i
                propose(i, right)
            if before[i] >= 0:
                propose(before[i], i)
        return [part for part in parts if part]

    def _together(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left of segments that lie one behind the other, and how many each has.

        Segments are columns, places are rows; a row above and the rows below hold no
        symbol. Each round merges the best pair of every column that still has one.
        """
        n, high = len(lengths), int(lengths.max()) + 2
        row = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1
        symbol = np.full((high, n), self.none, np.int32)
        symbol[row, np.repeat(np.arange(n), lengths)] = codes
        # a letter beyond ``last`` merges with nothing, so one number stands for all of them
        known = np.minimum(symbol, self.last + 1)
        agenda = self.pairs(known[:-1], known[1:])
        agenda += np.where(agenda < NEVER, np.arange(high - 1)[:, None] << 32, 0)
        live, cells = known.ravel(), agenda.ravel()
        after = np.arange(high * n) + n
        before = after - 2 * n

        def propose(left: np.ndarray, right: np.ndarray) -> None:
            found = self.pairs(live[left], live[right])
            cells[left] = np.where(found < NEVER, found + (left // n << 32), NEVER)

        while True:
            best = agenda.min(axis=0)
            columns = np.flatnonzero(best < NEVER)
            if not len(columns):
                break
            best = best[columns]
            i = (best >> 32 & 63) * n + columns
            j = after[i]
            live[i], live[j], cells[j] = best & 0xFFFFFFFF, DEAD, NEVER
            right = after[i] = after[j]
            before[right] = i
            propose(i, right)
            propose(before[i], i)
        left = np.where(known > self.last, symbol, known).T
        held = (left != DEAD) & (left != self.none)
        return left[held], held.sum(axis=1)

    def _short(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments, sorted by length, one behind the other, and how many each has."""
        if not segments:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        codes, ends = self._codes(segments), np.concatenate([[0], np.cumsum(lengths)])
        cuts = [*range(0, len(segments), WIDE), len(segments)]
        done = [self._together(codes[ends[a] : ends[b]], lengths[a:b]) for a, b in zip(cuts, cuts[1:])]
        symbols, counts = (np.concatenate(x) for x in zip(*done))
        # a letter without an id of its own becomes the ids of its bytes
        ids = np.array([*range(self.none + 1), *chain.from_iterable(self.spelt)], np.int32)
        sizes = np.array([1] * (self.none + 1) + [len(x) for x in self.spelt], np.int64)
        starts = np.cumsum(sizes) - sizes
        sizes = sizes[symbols]
        return _ragged(ids, starts[symbols], sizes), np.add.reduceat(sizes, np.cumsum(counts) - counts)

    def _learn(self, fresh: list[str]) -> None:
        """Lay down the ids of new segments; where the library disagrees, its ids."""
        lengths = np.fromiter(map(len, fresh), np.int64, len(fresh))
        alone = lengths > FLAT
        if not self.bytes:  # neighbouring letters without an id become one unknown
            alone |= [any(c not in self.ids for c in p) for p in fresh]
        order = np.lexsort((lengths, alone))
        ordered = [fresh[i] for i in order.tolist()]
        short = len(fresh) - int(alone.sum())
        flat, sizes = self._short(ordered[:short])
        own = [self.merge(p) for p in ordered[short:]]
        flat = np.concatenate([flat, np.array([*chain.from_iterable(own)], np.int32)])
        sizes = np.concatenate([sizes, np.array([len(x) for x in own], np.int64)])
        same = np.ones(len(fresh), bool)
        if self.check:
            flat, sizes = self._checked(ordered, flat, sizes, same)
        at = np.empty(len(fresh), np.int64)
        at[order] = np.arange(len(fresh))
        starts = np.cumsum(sizes) - sizes + len(self.flat)
        self.flat = np.concatenate([self.flat, flat])
        self.starts, self.sizes = np.concatenate([self.starts, starts[at]]), np.concatenate([self.sizes, sizes[at]])
        self.same = np.concatenate([self.same, same[at]])
        self.met = np.concatenate([self.met, np.zeros(len(fresh), np.int64)])

    def _checked(self, segments: list[str], flat: np.ndarray, sizes: np.ndarray, same: np.ndarray):
        """The ids after the library's word; ``same`` turns false where it differs."""
        ends = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        instead: dict[int, list[int]] = {}
        step = CHECKED if self.cuts else 1
        for a in range(0, len(segments), step):
            group = segments[a : a + step]
            # the library puts a blank mark in front, which these segments have
            theirs = self.library.encode("".join(group)[1:].replace(BLANK, " "))
            if flat[ends[a] : ends[a + len(group)]].tolist() == theirs:
                continue
            for i, p in enumerate(group, a):
                plain = p[1:].replace(BLANK, " ")
                if p[0] == BLANK and (ids := self.library.encode(plain)) != flat[ends[i] : ends[i + 1]].tolist():
                    if self.library.normalize(plain) == p:
                        instead[i] = ids
        if not instead:
            return flat, sizes
        self.differ.update(segments[i] for i in instead)
        same[list(instead)] = False
        own = [instead[i] if i in instead else flat[ends[i] : ends[i + 1]].tolist() for i in range(len(segments))]
        return np.array([*chain.from_iterable(own)], np.int32), np.array([len(x) for x in own], np.int64)

    def _cut(self, normal: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """For all segments their place among the distinct ones, segments of each text, distinct segments."""
        joined = "".join(normal)
        mark = next(c for c in map(chr, range(0xE000, 0x110000)) if c not in joined)
        if self.cuts:
            # a mark before every run of blanks
            normal = [x.replace(BLANK, mark + BLANK).replace(BLANK + mark, BLANK) for x in normal]
        lists = pa.compute.split_pattern(pa.array(normal, pa.string()), mark)
        coded = lists.flatten().dictionary_encode()
        which, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        bounds = lists.offsets.to_numpy()
        if "" in distinct:  # what lies before the mark of a first blank, and empty texts
            nothing = distinct.index("")
            held = which != nothing
            bounds = np.concatenate([[0], np.cumsum(held)])[bounds]
            which = which[held]
            which = which - (which > nothing)
            del distinct[nothing]
        return which, np.diff(bounds), distinct

    def _forget(self, numbers: np.ndarray, fresh: list[str]) -> None:
        """Once too much is remembered, keep what the most slices had, half of the room at most."""
        now = np.zeros(len(self.met), np.int64)
        now[numbers] = 1
        self.met += now
        self.weight += sum(map(len, fresh)) + EACH * len(fresh)
        if self.weight <= REMEMBERED:
            return
        weights = np.fromiter(map(len, self.place), np.int64, len(self.place)) + EACH
        least = 2
        while weights[self.met >= least].sum() > REMEMBERED // 2:
            least += 1
        keep = self.met >= least
        names = list(compress(self.place, keep))
        self.place.clear()
        self.place.update(zip(names, range(len(names))))
        self.flat = _ragged(self.flat, self.starts[keep], self.sizes[keep])
        self.sizes, self.same, self.met = self.sizes[keep], self.same[keep], np.zeros(len(names), np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.weight = int(weights[keep].sum())
        self.differ.intersection_update(names)

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all whole texts in a row, how many each has, and whether all its segments agree."""
        normal = [self.library.normalize(text) for text in texts]
        which, parts, distinct = self._cut(normal)
        before = len(self.place)
        own = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))
        numbers = own[which]
        fresh = list(islice(reversed(self.place), len(self.place) - before))[::-1]
        if fresh:
            self._learn(fresh)
        sizes = self.sizes[numbers]
        ids = _ragged(self.flat, self.starts[numbers], sizes)
        agree = np.ones(len(texts), bool)
        agree[np.repeat(np.arange(len(texts)), parts)[~self.same[numbers]]] = False
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(parts)])]
        self._forget(own, fresh)
        return ids, np.diff(ends), agree

    def encode(self, texts: list[str]) -> list[tuple[list[int], bool]]:
        """For each whole text its ids, and whether all its segments agree with the library."""
        ids, sizes, agree = self.encode_flat(texts)
        ids, ends = ids.tolist(), np.cumsum(sizes).tolist()
        return [(ids[end - size : end], same) for end, size, same in zip(ends, sizes.tolist(), agree.tolist())]


@functools.lru_cache(maxsize=1)
def encoder_of(model_file: str, check: bool) -> Encoder:
    """One encoder for each Python worker, whatever the number of its tasks."""
    return Encoder(model_file, check)


def _encoded(model_file: str, add_end: bool, check: bool, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model_file, check)
        decode, end = encoder.library.decode, encoder.library.eos_id()
        for batch in batches:
            for part in row_slices(batch, "text", SLICE_BYTES):
                ids, sizes, agree = encoder.encode_flat([text or "" for text in part.column("text").to_pylist()])
                if add_end:
                    ids, sizes = np.insert(ids, np.cumsum(sizes), end), sizes + 1
                ends, plain = np.cumsum(sizes), ids.tolist()
                texts = [decode(plain[b - n : b]) for b, n in zip(ends.tolist(), sizes.tolist())]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()))
                own = [part.column(c) for c in names]
                added = [lists, pa.array(texts, pa.string()), pa.array(agree, pa.bool_())]
                yield pa.RecordBatch.from_arrays(own + added, names=[*names, "ids", "decoded", "agrees"])
            # the worker lives on, idle or in other stages; Arrow would keep the room of what it has freed
            pa.default_memory_pool().release_unused()

    return run


def encode(docs: DataFrame, model_file: str, *, add_end: bool = True, check: bool = True) -> DataFrame:
    """``docs(..., text, ...)`` plus ids (array<int>), decoded (the ids' text) and agrees.

    ``model_file`` must be at the same place on every executor. A null text
    counts as empty: its ids are the end id alone. Columns of ``docs`` with the
    three names are replaced; rows never meet, so repeats give equal results.
    """
    kept = docs.drop("ids", "decoded", "agrees")
    names = kept.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    schema += ", ids array<int>, decoded string, agrees boolean"
    return kept.mapInArrow(_encoded(model_file, add_end, check, names), schema)
