"""Near-duplicate groups: SuperMinHash signatures, banding, exact confirmation, union-find.

Texts with equal shingle sets form one class (128-bit digest of the set); only
classes meet. Each class has a SuperMinHash signature cut into bands; classes
that share a band value are candidates. Equal candidate groups of different bands
are met once. A large group is dealt into chunks, and every pair of chunks is one
bounded unit of work (a tile), which reads the whole texts, compares the full
sets, and returns only the edges of a spanning forest of its links: no pair list
of a group is ever written. The forests are joined by alternating large-star and
small-star steps on tables in the shared folder.

A band is missed by a pair of similarity s with chance ``(1 - s**rows) ** bands``;
for 0.85 and 4 rows of 16 bands that is 7e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rebalance.llm.common import byte_texts, row_slices, text_of
from rebalance.operators.ranking import with_row_id
from rebalance.staging import stage

SLOTS, ROWS = 64, 4
SHINGLE_WORDS = 3
MIN_PERCENT = 85
CHUNK_DOCS, CHUNK_SHINGLES = 512, 400_000  # per chunk of a candidate group
SLICE_BYTES = 4 << 20
SLOT_COUNT = 1 << 20  # bounds the broadcast that keeps texts without candidates from moving

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection with well spread bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHashes(dict):
    """64-bit hash of a word, remembered for the common ones."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh64_intdigest(word)
        if len(self) < 300_000:
            self[word] = value
        return value


def shingle_sets(texts: list[bytes], width: int, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within a text, and the offsets of the texts."""
    words, sizes = [], []
    for text in texts:
        own = text.lower().split()
        words.append(np.fromiter(map(hashes.__getitem__, own), np.uint64, len(own)))
        sizes.append(len(own))
    n = np.array(sizes, np.int64)
    flat = np.concatenate(words) if words else np.empty(0, np.uint64)
    counts = np.where(n == 0, 0, np.maximum(n - width + 1, 1))
    owner = np.repeat(np.arange(len(n)), counts)
    starts = np.cumsum(n) - n
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[owner]
    value = np.zeros(len(owner), np.uint64)
    for k in range(width):
        inside = place + k < (starts + n)[owner]
        step = np.where(inside, flat[np.minimum(place + k, max(len(flat) - 1, 0))] if len(flat) else 0, 0)
        value = np.where(inside, _mix(value * _U(3) + step.astype(np.uint64) + _U(k + 1)), value)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[fresh], owner[fresh]
    return value, np.searchsorted(owner, np.arange(len(n) + 1))


def set_digests(values: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """128-bit digest of every sorted set."""
    import xxhash

    raw = values.tobytes()
    return [xxhash.xxh128_digest(raw[8 * a : 8 * b]) for a, b in zip(offsets[:-1], offsets[1:])]


def superminhash(values: np.ndarray, offsets: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures, one row per set; sets without elements get infinity.

    Element x visits the slots in its own random order (a Fisher-Yates shuffle
    driven by x) and offers slot ``p_j`` the value ``j + u_j``, so the ranks that
    one element gives to different slots differ. All elements take step j
    together. A set whose slots are all below j cannot change and stops.
    """
    sizes = np.diff(offsets)
    best = np.full(len(sizes) * slots, np.inf)
    owner, key = np.repeat(np.arange(len(sizes)), sizes), values
    order = None
    for j in range(slots):
        if not len(key):
            break
        draw = _mix(key + _U(0x9E3779B97F4A7C15 * (j + 1) & (2**64 - 1)))
        unit = (draw >> _U(11)).astype(np.float64) * 2.0**-53
        swap = j + ((draw & _U(0x7FF)) * _U(slots - j) >> _U(11)).astype(np.int64)
        if order is None:
            slot = swap
        else:
            rows = np.arange(len(key))
            slot = order[rows, swap].astype(np.int64)
            order[rows, swap] = order[rows, j]
        np.minimum.at(best, owner * slots + slot, unit + j)
        unfinished = best.reshape(-1, slots).max(axis=1) >= j + 1
        stay = unfinished[owner]
        if order is None:
            owner, key, swap = owner[stay], key[stay], swap[stay]
            order = np.tile(np.arange(slots, dtype=np.uint8), (len(key), 1))
            rows = np.arange(len(key))
            order[rows, swap] = order[rows, 0]
        elif not stay.all():
            owner, key, order = owner[stay], key[stay], order[stay]
    return best.reshape(-1, slots)


def band_keys(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit hash per band and set; the number of the band is part of it."""
    bits = signatures.view(np.uint64).reshape(len(signatures), -1, rows)
    keys = np.zeros(bits.shape[:2], np.uint64) + np.arange(1, bits.shape[1] + 1, dtype=np.uint64)
    for k in range(rows):
        keys = _mix(keys * _U(3) + bits[:, :, k])
    return keys.view(np.int64)


def _signed(width: int, slots: int, rows: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in row_slices(batch, "text", SLICE_BYTES):
                values, offsets = shingle_sets(byte_texts(part, "text"), width, hashes)
                keys = band_keys(superminhash(values, offsets, slots), rows)
                sizes = np.diff(offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(c) for c in names],
                        pa.array(sizes),
                        pa.array(set_digests(values, offsets), pa.binary()),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(len(keys) + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel())
                        ),
                    ],
                    names=[*names, "n_shingles", "cls", "bands"],
                )

    return run


def _roots(n: int, pairs: Iterator[tuple[int, int]]) -> list[int]:
    """Union-find: the smallest member of every element's set."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def linked(values: np.ndarray, offsets: np.ndarray, percent: int) -> np.ndarray:
    """Index pairs (a < b) of sets with ``100 * both >= percent * either``, compared in full.

    Shingles of one set alone meet nobody; the rest fill 0/1 blocks whose
    product counts the common ones of all pairs.
    """
    n, sizes = len(offsets) - 1, np.diff(offsets)
    owner = np.repeat(np.arange(n), sizes)
    _, code, times = np.unique(values, return_inverse=True, return_counts=True)
    keep = times[code] > 1
    code, owner = np.unique(code[keep], return_inverse=True)[1], owner[keep]
    both = np.zeros((n, n), np.float32)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    step = 4096
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, step):
        a, b = np.searchsorted(code, [low, low + step])
        block = np.zeros((n, min(step, int(code[-1]) + 1 - low)), np.float32)
        block[owner[a:b], code[a:b] - low] = 1
        both += block @ block.T
    common = both.astype(np.int64)
    either = sizes[:, None] + sizes[None, :] - common
    return np.argwhere(np.triu((100 * common >= percent * either) & (common > 0), 1))


def _forest(width: int, percent: int):
    """Over rows sorted by tile: spanning forest edges of the links inside each tile."""

    def solve(rows: list[tuple[bytes, bytes]], hashes: WordHashes) -> list[tuple[bytes, bytes]]:
        texts = list(dict(rows).items())
        if len(texts) < 2:
            return []
        values, offsets = shingle_sets([t for _, t in texts], width, hashes)
        roots = _roots(len(texts), map(tuple, linked(values, offsets, percent).tolist()))
        return [(texts[i][0], texts[r][0]) for i, r in enumerate(roots) if i != r]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, tile, rows, edges = WordHashes(), None, [], []

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays(
                [pa.array([e[k] for e in edges], pa.binary()) for k in (0, 1)], names=["u", "v"]
            )
            edges.clear()
            return got

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("bkey", "i", "j")))
            for key, cls, text in zip(keys, batch.column("cls").to_pylist(), byte_texts(batch, "text")):
                if key != tile:
                    edges += solve(rows, hashes)
                    tile, rows = key, []
                rows.append((cls, text))
            if len(edges) > 10_000:
                yield out()
        edges += solve(rows, hashes)
        yield out()

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(u, v)``; root is the smallest node reached.

    Alternates large-star and small-star until nothing changes. Each round is a
    table in the shared folder, so lineage stays short; grouped minima have
    map-side combine, and the joins back are plain joins that AQE can split.
    """
    edges = stage(edges.where("u <> v").distinct(), "edges")
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = stage(
            large.join(small, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct(),
            "edges",
        )
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        last = state


def _slot(key: str):
    return F.pmod(F.xxhash64(key), F.lit(SLOT_COUNT)).cast("int")


def near_duplicates(
    docs: DataFrame,
    *,
    width: int = SHINGLE_WORDS,
    percent: int = MIN_PERCENT,
    slots: int = SLOTS,
    rows: int = ROWS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, n_shingles, component_id, kept.

    Words are parted by ASCII blanks, A-Z is lower-cased. Fewer than ``width``
    words make one shingle; a null or blank text has none and is alone. Links
    need ``100 * both >= percent * either``. component_id is the smallest doc_id
    of the component, and ``kept`` marks it. Texts are told apart by a digest of
    their own, never by id: rows with one id stay rows of their own, and each is linked
    by its text; a row without id takes part in its group and is kept only when no
    row of the group has an id. ``keep`` names columns of ``docs`` to pass on,
    followed by ``grp``, the same for all rows of a component and null for texts without
    shingles. Other columns are ignored.
    """
    key = F.unhex(F.md5(F.encode(text_of("text"), "UTF-8"))).alias("key")
    texts = docs.select(*keep, F.col("doc_id").cast("long").alias("doc_id"), key, "text")
    own = [f for f in texts.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)
    signed = stage(
        texts.mapInArrow(
            _signed(width, slots, rows, [f.name for f in own]),
            f"{schema}, n_shingles long, cls binary, bands array<long>",
        ),
        "signed",
    )
    full = signed.where("n_shingles > 0")
    classes = full.groupBy("cls").agg(
        F.min("doc_id").alias("doc_id"),
        F.min("key").alias("key"),
        F.first("n_shingles").alias("n"),
        F.first("bands").alias("bands"),
    )
    classes = stage(classes, "classes")
    met = classes.select("cls", "key", "n", F.explode("bands").alias("bkey"))
    sums = met.groupBy("bkey").agg(
        F.count("*").alias("docs"),
        F.sum("n").alias("shingles"),
        F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("who"),
    )
    groups = sums.where("docs > 1").groupBy("docs", "shingles", "who").agg(F.min("bkey").alias("bkey"))
    parts = F.greatest(F.ceil(F.col("docs") / CHUNK_DOCS), F.ceil(F.col("shingles") / CHUNK_SHINGLES))
    groups = groups.select("bkey", F.least(parts, F.col("docs")).cast("int").alias("parts"))
    members = met.join(groups, "bkey").withColumn("own", F.pmod(F.xxhash64("cls", "bkey"), "parts").cast("int"))
    dealt = members.select(
        "bkey", "cls", "key", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    ).select("bkey", "cls", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    dealt = stage(dealt, "tiles")
    # texts of hash slots without a candidate need not move; there are SLOT_COUNT slots at most
    slots = dealt.select(_slot("key").alias("slot")).distinct()
    known = docs.select(key, "text").withColumn("slot", _slot("key")).where(F.col("text").isNotNull())
    known = known.join(F.broadcast(slots), "slot", "left_semi")
    # copies of a text become one before they move
    known = known.groupBy("key").agg(F.first("text").alias("text"))
    tiles = dealt.join(known, "key").select("bkey", "i", "j", "cls", "text")
    tiles = tiles.repartition("bkey", "i", "j").sortWithinPartitions("bkey", "i", "j")
    links = components(tiles.mapInArrow(_forest(width, percent), "u binary, v binary"))
    rooted = classes.join(links, F.col("cls") == F.col("node"), "left").select(
        "cls", "doc_id", F.coalesce("root", "cls").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = stage(rooted.join(least, "root").select("cls", "component_id", F.col("root").alias("grp")), "components")
    out = [*keep, "doc_id", "n_shingles", "component_id", *(["grp"] if keep else [])]
    grouped = full.select(*keep, "doc_id", "n_shingles", "cls").join(named, "cls", "left").select(*out)
    alone = signed.where("n_shingles = 0")
    alone = alone.withColumns({"component_id": F.col("doc_id"), "grp": F.lit(None).cast("binary")}).select(*out)
    return grouped.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest id; options as above.

    Rows, not ids, are chosen: of rows that share the smallest id one stays, rows without
    id come after all others, and rows without shingles all stay.
    """
    rows = with_row_id(docs, "_row")
    grouped = stage(near_duplicates(rows, keep=("_row",), **options).select("_row", "doc_id", "grp"), "grouped")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    first = grouped.where("grp is not null").groupBy("grp").agg(F.min(order).alias("x")).select("x._row")
    stays = first.unionByName(grouped.where("grp is null").select("_row"))
    return rows.join(stays, "_row", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
