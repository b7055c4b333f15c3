"""How two tokenizers cut the same texts: common cuts, linked tokens, and their counts.

Texts are shuffled whole and equal ones become one row with the number of its
documents; each distinct text is tokenised and aligned once. A text is cut where a single
blank stands between two characters that are no white space. There no token of either
kind crosses: a byte-level pre-tokenizer starts a new part at such a blank, and no piece
of the other vocabulary has a blank mark behind another character (looked up; else
texts stay whole). Segments repeat, so their alignment is remembered; a text's
alignment is that of its segments in a row.

Pairs of linked ids are counted in two steps: each block of texts adds up its own
pairs, weighted by the documents that share a text, and Spark sums the blocks' counts,
with partial sums before the shuffle. The counts go back to the blocks that asked, one
row for each block and pair, and every text adds up its links. Measures reach the
documents by the digest of the text; digests held by over a thousandth of all
documents are joined by broadcast, of which there are fewer than a thousand.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rebalance.llm.common import row_slices, text_of
from rebalance.staging import stage, stage_observed

SLICE_BYTES = 4 << 20
REMEMBERED_CHARS = 2_500_000  # characters of the segments in one generation of a Python worker's memory
HOT_SHARE = 1000  # a text is hot if over a thousandth of all rows hold it
BLANK = "▁"
CUT = re.compile(r"(?<=\S) (?=\S)")
MEASURES = ("n_a", "n_b", "n_groups", "n_links")


def byte_alphabet() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for.

    Printable bytes stand for themselves; the others take the characters from 256 on.
    """
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Aligns the tokens of a byte-level BPE file (A) and a piece model (B)."""

    def __init__(self, a_file: str, b_file: str):
        # Spark deals out the cores, one task each
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        letters = byte_alphabet()
        self.a_bytes = {i: self._plain(t, letters) for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        whole = any(BLANK in self.b.id_to_piece(i).lstrip(BLANK) for i in range(self.b.get_piece_size()))
        self.cut = None if whole else CUT
        size_a = max(self.a_bytes, default=-1) + 1
        self.a_sizes, self.b_sizes = np.zeros(size_a, np.int64), np.array([len(x) for x in self.b_bytes], np.int64)
        for i, token in self.a_bytes.items():
            self.a_sizes[i] = len(token)
        # how an id is written: within its side of a group, at the end of A's side, at the end of the group
        a_names, b_names = [str(i) for i in range(size_a)], [str(i) for i in range(len(self.b_bytes))]
        self.names = [x + end for names, ends in ((a_names, ",|"), (b_names, ",;")) for end in ends for x in names]
        self.name_sizes = np.array([len(x) for x in self.names], np.int64)
        self.known: tuple[dict[str, tuple | None], dict[str, tuple | None]] = ({}, {})
        self.chars = 0

    @staticmethod
    def _plain(token: str, letters: dict[str, int]) -> bytes:
        if all(c in letters for c in token):
            return bytes(letters[c] for c in token)
        return token.encode()

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace(BLANK, " ").encode()

    def parts(self, text: str) -> list[str]:
        """The segments of a blank and ``text``, each without its first blank."""
        return self.cut.split(text) if self.cut else [text]

    def align(self, theirs: list[list[int]], pieces: list[list[int]], raws: list[bytes]) -> list[tuple | None]:
        """(n_a, n_b, n_groups, groups, links) of every segment from its ids and bytes.

        Links are int64 ``a * size + b``, as bytes; None where the bytes do not come back.
        The tokens of all segments are laid in a row: cuts are the ends that both kinds
        share, and every stretch between neighbouring ends is a link.
        """
        out: list[tuple | None] = [None] * len(raws)
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (theirs, pieces))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((theirs, n_a), (pieces, n_b)))
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        whole = (n_a > 0) & (n_b > 0) & (sizes > 0)
        for ids, n, lengths in ((a, n_a, self.a_sizes), (b, n_b, self.b_sizes)):
            ends = np.concatenate([[0], np.cumsum(lengths[ids])])[np.concatenate([[0], np.cumsum(n)])]
            whole &= np.diff(ends) == sizes
        raw = b"".join(raws)
        if not (
            whole.all()
            and self.a_sizes[a].all()
            and self.b_sizes[b].all()
            and b"".join(map(self.a_bytes.__getitem__, a.tolist())) == raw
            and b"".join(map(self.b_bytes.__getitem__, b.tolist())) == raw
        ):
            # some do not come back: the others once more
            good = [i for i, (x, y, r) in enumerate(zip(theirs, pieces, raws)) if r and self._back(x, y, r)]
            if len(good) < len(raws):
                found = self.align([theirs[i] for i in good], [pieces[i] for i in good], [raws[i] for i in good])
                for i, x in zip(good, found):
                    out[i] = x
                return out
        if not len(raws):
            return out
        both = np.concatenate([np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])])
        order = np.argsort(both, kind="stable")  # two sorted runs
        both = both[order]
        new = np.ones(len(both), bool)
        new[1:] = both[1:] != both[:-1]
        every, slot = both[new], np.cumsum(new) - 1
        # the places of both kinds of ends among all ends
        a_at, b_at = slot[order < len(a)], slot[order >= len(a)]
        ends_a, ends_b = np.zeros(len(every), bool), np.zeros(len(every), bool)
        ends_a[a_at], ends_b[b_at] = True, True
        cut = ends_a & ends_b
        codes = a[np.cumsum(ends_a) - ends_a] * len(self.b_bytes) + b[np.cumsum(ends_b) - ends_b]
        n_links = np.searchsorted(every, np.cumsum(sizes), side="right")
        links, link_cut = codes.tobytes(), (n_links * 8).tolist()
        group = np.cumsum(cut)
        group_cut = group[n_links - 1]
        group -= cut
        # the groups in writing: A's tokens of a group, then B's
        a_last, b_last = cut[a_at], cut[b_at]
        width = len(self.a_sizes)
        name = np.empty(len(a) + len(b), np.int64)
        b_before = np.concatenate([[0], np.flatnonzero(b_last) + 1])[group[a_at]]
        a_before = (np.flatnonzero(a_last) + 1)[group[b_at]]
        name[np.arange(len(a)) + b_before] = a + width * a_last
        name[np.arange(len(b)) + a_before] = 2 * width + b + len(self.b_bytes) * b_last
        written = "".join(map(self.names.__getitem__, name.tolist()))
        text_cut = np.cumsum(self.name_sizes[name])[np.cumsum(n_a + n_b) - 1].tolist()
        counts = zip(n_a.tolist(), n_b.tolist(), np.diff(group_cut, prepend=0).tolist())
        spans = zip(counts, [0, *text_cut], text_cut, [0, *link_cut], link_cut)
        return [(*n, written[t : u - 1], links[x:y]) for n, t, u, x, y in spans]

    def _back(self, a: list[int], b: list[int], raw: bytes) -> bool:
        """Whether both kinds of tokens, none of them empty, give the bytes."""
        a_text, b_text = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        return all(a_text) and all(b_text) and b"".join(a_text) == raw == b"".join(b_text)

    def learn(self, distinct: list[str]) -> dict[str, tuple | None]:
        """The alignment of every segment; None for those whose bytes do not come back.

        Two generations are remembered: once the younger is full it becomes the older, and
        what is met again moves to the younger.
        """
        out, fresh = {}, []
        young, old = self.known
        for segment in distinct:
            if segment in young:
                out[segment] = young[segment]
            elif segment in old:
                out[segment] = young[segment] = old[segment]
                self.chars += len(segment)
            else:
                fresh.append(segment)
        if fresh:
            # without offsets, which nothing here reads
            theirs = [x.ids for x in self.a.encode_batch_fast(fresh, add_special_tokens=False)]
            pieces = self.b.encode([p[1:] for p in fresh], num_threads=1)
            found = dict(zip(fresh, self.align(theirs, pieces, [p.encode() for p in fresh])))
            young.update(found)
            out.update(found)
            self.chars += sum(map(len, fresh))
        if self.chars > REMEMBERED_CHARS:
            self.known, self.chars = ({}, young), 0
        return out


@functools.lru_cache(maxsize=1)
def aligner_of(a_file: str, b_file: str) -> Aligner:
    """One aligner for each Python worker, whatever the number of its tasks."""
    return Aligner(a_file, b_file)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _aligned(a_file: str, b_file: str):
    def block(aligner: Aligner, number: int, texts: list[str], copies: np.ndarray) -> pa.RecordBatch:
        place: defaultdict[str, int] = defaultdict()
        place.default_factory = place.__len__  # a new part gets the next number
        cut = []
        for t in texts:
            parts = aligner.parts(t) if t else []
            cut.append(np.fromiter(map(place.__getitem__, parts), np.int64, len(parts)))
        distinct = [" " + p for p in place]
        del place
        learnt = aligner.learn(distinct)
        good = [learnt[p] for p in distinct]
        del learnt, distinct
        segments = [x or (0, 0, 0, "", b"") for x in good]
        counts = np.array([x[:3] + (len(x[4]) // 8,) for x in segments], np.int64).reshape(-1, 4)
        strings = [x[3] for x in segments]
        links = np.frombuffer(b"".join([x[4] for x in segments]), np.int64)
        codes, pair = np.unique(links, return_inverse=True)
        starts = np.cumsum(counts[:, 3]) - counts[:, 3]
        bad = np.array([x is None for x in good], bool)
        sums, hashes, own_pairs, times, sizes = [], [], [], [], []
        weight = np.zeros(len(codes), np.int64)
        for at, n in zip(cut, copies.tolist()):
            if not len(at) or bad[at].any():
                sums.append((0, 0, 0, 0))
                hashes.append("")
                sizes.append(0)
                continue
            sums.append(counts[at].sum(axis=0))
            hashes.append(_digest(";".join([strings[i] for i in at.tolist()])))
            seg, often = np.unique(at, return_counts=True)
            many = counts[seg, 3]
            flat = np.repeat(starts[seg] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            pairs, inverse = np.unique(pair[flat], return_inverse=True)
            total = np.zeros(len(pairs), np.int64)
            np.add.at(total, inverse, np.repeat(often, many))
            weight[pairs] += n
            own_pairs.append(pairs.astype(np.int32))
            times.append(total.astype(np.int32))
            sizes.append(len(pairs))
        used = np.flatnonzero(weight)
        dense = np.cumsum(weight > 0) - 1  # pairs of good texts alone
        sums = np.array(sums, np.int64).reshape(-1, 4)
        offsets = pa.array(np.cumsum([0, *sizes]), pa.int32())
        flat_pairs = dense[np.concatenate(own_pairs)].astype(np.int32) if own_pairs else np.zeros(0, np.int32)
        flat_times = np.concatenate(times) if times else np.zeros(0, np.int32)
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (flat_pairs, flat_times)]
        docs = [pa.array([_digest(t) for t in texts]), *[pa.array(sums[:, k]) for k in range(4)], pa.array(hashes), *lists]
        table = pa.StructArray.from_arrays(docs, names=["digest", *MEASURES, "groups_sha256", "pairs", "times"])
        row = [
            pa.array([number]),
            pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), table),
            pa.ListArray.from_arrays(pa.array([0, len(used)], pa.int32()), pa.array(codes[used])),
            pa.ListArray.from_arrays(pa.array([0, len(used)], pa.int32()), pa.array(weight[used])),
        ]
        return pa.RecordBatch.from_arrays(row, names=["block", "texts", "codes", "weights"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, serial = aligner_of(a_file, b_file), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in row_slices(batch, "text", SLICE_BYTES):
                copies = part.column("copies").to_numpy(zero_copy_only=False)
                gc.disable()  # a block makes a million small objects and no cycles
                try:
                    out = block(aligner, serial, part.column("text").to_pylist(), copies)
                finally:
                    gc.enable()
                yield out
                serial += 1

    return run


_BLOCK = """block bigint, texts array<struct<digest:string,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,
  groups_sha256:string,pairs:array<int>,times:array<int>>>, codes array<bigint>, weights array<bigint>"""


def _measured(left: pa.Table, right: pa.Table) -> pa.Table:
    """One block: its texts, and the counts of its pairs."""
    n = right.num_rows
    count, top = np.zeros(n, np.int64), np.zeros(n, bool)
    if n:
        place = right["place"].to_numpy()
        count[place], top[place] = right["n"].to_numpy(), right["top"].to_numpy(zero_copy_only=False)
    texts = left["texts"].combine_chunks().flatten()
    field = dict(zip(texts.type.names, texts.flatten(), strict=True))
    pairs, times = field["pairs"], field["times"].flatten().to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(pairs.offsets.to_numpy()))
    at = pairs.flatten().to_numpy()
    best, total = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    np.add.at(best, owner, np.where(top[at], times, 0) if n else 0)
    np.add.at(total, owner, times * count[at] if n else 0)
    kept = {c: field[c] for c in ("digest", *MEASURES, "groups_sha256")}
    return pa.table(kept | {"n_best": pa.array(best), "count_sum": pa.array(total)})


def align(docs: DataFrame, a_file: str, b_file: str) -> tuple[DataFrame, DataFrame]:
    """(measures by text digest, counts of id pairs) for ``docs(text, ...)``.

    Measures: digest (SHA-256 of the text), n_a, n_b, n_groups, n_links, groups_sha256,
    n_best (links whose count is the highest of their a) and count_sum. Counts: a, b, n, top, where n
    is the number of rows whose text links the two ids, and top marks the highest n
    of an a. Both files must be at the same place on every executor. Null texts count
    as empty. Texts that are empty or do not come back from the tokens, byte by byte,
    have zeros, an empty groups_sha256 and no pairs.
    """
    texts = docs.groupBy(text_of("text").alias("text")).agg(F.count(F.lit(1)).alias("copies"))
    blocks = stage(texts.mapInArrow(_aligned(a_file, b_file), _BLOCK), "aligned")
    width = aligner_of(a_file, b_file).b.get_piece_size()
    asked = blocks.select("block", F.posexplode(F.arrays_zip("codes", "weights")).alias("place", "x"))
    asked = asked.select("block", "place", F.col("x.codes").alias("code"), F.col("x.weights").alias("weight"))
    counts = stage(asked.groupBy("code").agg(F.sum("weight").alias("n")), "pair-counts")
    a = F.expr(f"code div {width}").cast("int")
    # one row for each id of the first vocabulary
    highest = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    ranked = counts.withColumn("a", a).join(F.broadcast(highest), "a")
    ranked = ranked.select("code", "a", (F.col("code") % width).cast("int").alias("b"), "n", (F.col("n") == F.col("most")).alias("top"))
    told = asked.join(ranked, "code").select(F.col("block").alias("asker"), "place", "n", "top")
    done = blocks.select("block", "texts").groupBy("block").cogroup(told.groupBy("asker")).applyInArrow(
        _measured,
        "digest string, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
        "n_best bigint, count_sum bigint",
    )
    return done, ranked.drop("code")


def measure(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """``docs`` without its text, plus the measures of ``align`` for every row.

    Columns of ``docs`` with the names of measures are replaced. Repeated rows, and rows
    without id, each get their text's measures.
    """
    names = [*MEASURES, "groups_sha256", "n_best", "count_sum"]
    rest = [c for c in docs.columns if c not in ("text", "digest", *names)]
    rows = docs.select(*[F.col(f"`{c}`") for c in rest], F.sha2(text_of("text"), 256).alias("digest"))
    found, _ = align(docs, a_file, b_file)
    measures = stage(found, "measures")
    rows, counted = stage_observed(rows, "digests", n=F.count(F.lit(1)))
    held = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    hot = [r.digest for r in held.where(F.col("n") > counted["n"] // HOT_SHARE + 1).select("digest").collect()]
    is_hot = F.col("digest").isin(hot)
    out = rows.where(~is_hot).join(measures.where(~is_hot), "digest")
    if hot:
        out = out.unionByName(rows.where(is_hot).join(F.broadcast(measures.where(is_hot)), "digest"))
    return out.select(*[F.col(f"`{c}`") for c in rest], *names)
