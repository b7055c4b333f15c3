"""Toxicity from subword-bag embeddings averaged into a linear softmax.

A word is the bag of itself and its character n-grams between two marks; each entry is
hashed to one of ``BUCKETS`` vectors. A text is the mean of the vectors of all its words'
entries, and a linear softmax over that mean gives the two labels. Vectors and softmax
are trained together (Adagrad on mini-batches, numpy). A misspelt word that training
never saw shares most of its n-grams with the word it comes from.

Training reads a bounded sample: of the labelled rows that may be learnt from, the
first by a hash of the id, at most ``TRAIN_ROWS`` of each label and ``TRAIN_CHARS``
characters of whole texts. It runs in one task, which returns the model, two numbers for
each bucket and dimension. Scores read every whole text. Because the softmax is linear, a word
adds one number, which is remembered; a text adds up its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rebalance.llm.common import byte_texts, row_slices, text_of

BUCKETS = 1 << 17
DIMS = 4
SHORTEST, LONGEST = 3, 6  # characters of an n-gram, marks included
TRAIN_ROWS = 2000  # of each label
TRAIN_CHARS = 16_000_000
EPOCHS = 5
BATCH = 64
RATE = 0.5
INIT = 0.1  # of the bucket vectors: entries that training never saw say little
SEED = 11
THRESHOLD = 0.7
REMEMBERED = 400_000  # words per Python worker
SLICE_BYTES = 4 << 20


def entries(word: bytes) -> list[int]:
    """Buckets of a lower-cased word and its n-grams."""
    raw = b"<%b>" % word
    cuts = range(len(raw) + 1)  # where characters begin
    if not raw.isascii():
        cuts = [i for i, byte in enumerate(raw) if byte & 0xC0 != 0x80] + [len(raw)]
    n = len(cuts) - 1
    sizes = range(SHORTEST, min(LONGEST, n) + 1)
    out = [crc32(raw[a:b]) % BUCKETS for k in sizes for a, b in zip(cuts, cuts[k:])]
    if n > LONGEST:
        out.append(crc32(raw) % BUCKETS)
    return out


def words_of(text: bytes) -> list[bytes]:
    return text.decode("utf-8", "replace").lower().encode().split()


@dataclass
class Model:
    """Bucket vectors (BUCKETS x DIMS), softmax weights (DIMS x 2) and biases."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def margins(self) -> np.ndarray:
        """What every bucket adds to the log-odds of label 1, before averaging."""
        return (self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float64)


def _bags(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every text its distinct buckets, their shares, and the sizes of the texts."""
    index: dict[bytes, int] = {}
    own: list[np.ndarray] = []
    buckets, shares, sizes = [], [], []
    for text in texts:
        for word in set(words := words_of(text)):
            if word not in index:
                index[word] = len(own)
                own.append(np.array(entries(word), np.int32))
        which, times = np.unique(np.fromiter(map(index.__getitem__, words), np.int64, len(words)), return_counts=True)
        parts = [own[i] for i in which.tolist()]
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        weight = np.repeat(times, [len(p) for p in parts])
        which, inverse = np.unique(flat, return_inverse=True)
        buckets.append(which)
        shares.append(np.bincount(inverse, weights=weight, minlength=len(which)) / max(weight.sum(), 1))
        sizes.append(len(which))
    return np.concatenate(buckets), np.concatenate(shares), np.array(sizes, np.int64)


def train(texts: list[bytes], labels: np.ndarray, *, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Fit vectors and softmax together; both labels weigh the same in total.

    Without texts of both labels the model is the share of label 1 (an even chance without
    any), whatever the text.
    """
    rng = np.random.default_rng(seed)
    n = len(texts)
    vectors = np.zeros((BUCKETS, DIMS), np.float32)
    weights, bias = np.zeros((DIMS, 2), np.float32), np.zeros(2, np.float32)
    positive = int(labels.sum()) if n else 0
    if not 0 < positive < n:
        bias[1] = 4.0 if positive else -4.0 if n else 0.0
        return Model(vectors, weights, bias)
    vectors = rng.uniform(-INIT, INIT, (BUCKETS, DIMS)).astype(np.float32)
    weights = rng.uniform(-1, 1, (DIMS, 2)).astype(np.float32)
    bucket, share, sizes = _bags(texts)
    share = share.astype(np.float32)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    target = np.stack([1 - labels, labels], axis=1).astype(np.float32)
    importance = np.where(labels == 1, n / (2 * positive), n / (2 * (n - positive))).astype(np.float32)
    seen_v, seen_w, seen_b = np.full(BUCKETS, 1e-8), np.full(weights.shape, 1e-8), np.full(2, 1e-8)
    for epoch in range(epochs):
        order = rng.permutation(n)
        for low in range(0, n, BATCH):
            rows = order[low : low + BATCH]
            many = sizes[rows]
            owner = np.repeat(np.arange(len(rows)), many)
            at = np.repeat(cuts[rows] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            b, s = bucket[at], share[at]
            means = np.zeros((len(rows), DIMS), np.float32)
            parts = vectors[b] * s[:, None]
            filled = np.flatnonzero(many)
            if len(filled):
                means[filled] = np.add.reduceat(parts, (np.cumsum(many) - many)[filled], axis=0)
            scores = means @ weights + bias
            scores -= scores.max(axis=1, keepdims=True)
            chance = np.exp(scores)
            chance /= chance.sum(axis=1, keepdims=True)
            wrong = (chance - target[rows]) * importance[rows][:, None] / len(rows)
            back = wrong @ weights.T
            grad_w, grad_b = means.T @ wrong, wrong.sum(axis=0)
            # every bucket of the batch once
            which = np.flatnonzero(np.bincount(b, minlength=1))
            grad = np.empty((len(which), DIMS))
            for k in range(DIMS):
                grad[:, k] = np.bincount(b, weights=s * back[owner, k])[which]
            seen_v[which] += (grad * grad).mean(axis=1)
            vectors[which] -= (RATE * grad / np.sqrt(seen_v[which])[:, None]).astype(np.float32)
            seen_w += grad_w * grad_w
            seen_b += grad_b * grad_b
            weights -= (RATE * grad_w / np.sqrt(seen_w)).astype(np.float32)
            bias -= (RATE * grad_b / np.sqrt(seen_b)).astype(np.float32)
    return Model(vectors, weights, bias)


def training_rows(docs: DataFrame, labels: DataFrame, learnt: Column) -> DataFrame:
    """(toxic, text) of the bounded sample; see the module.

    ``learnt`` is a condition on doc_id. Labels other than 0 and 1, and rows without
    id, are left out; an id with both labels counts as toxic, and of rows with one id
    the sample takes the text that is least by its digest.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(learnt)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.withColumn("turn", F.xxhash64("doc_id", F.lit(SEED)))
    # each task finds its own first rows; at most 2 * TRAIN_ROWS are left
    first = [known.where(F.col("toxic") == t).orderBy("turn", "doc_id").limit(TRAIN_ROWS) for t in (0, 1)]
    place = F.row_number().over(Window.partitionBy("toxic").orderBy("turn", "doc_id"))
    picked = first[0].unionByName(first[1]).withColumn("n", place)
    texts = docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(picked), "doc_id")
    one = texts.groupBy("doc_id", "toxic", "n").agg(F.min_by("text", F.sha2("text", 256)).alias("text"))
    so_far = Window.partitionBy(F.lit(1)).orderBy("n", "toxic").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = one.withColumn("chars", F.sum(F.length("text")).over(so_far)).where(F.col("chars") <= TRAIN_CHARS)
    return fits.select("toxic", "text", "n")


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        rows += zip(batch.column("n").to_pylist(), batch.column("toxic").to_pylist(), byte_texts(batch, "text"))
    rows.sort()
    model = train([text for _, _, text in rows], np.array([toxic for _, toxic, _ in rows], np.int64))
    parts = [model.vectors, model.weights, model.bias]
    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in parts], pa.binary())], names=["part"])


def fit(docs: DataFrame, labels: DataFrame, learnt: Column) -> Model:
    """The model learnt from ``labels(doc_id, toxic)`` where ``learnt`` holds; see the module."""
    sample = training_rows(docs, labels, learnt).coalesce(1)
    parts = [r.part for r in sample.mapInArrow(_fitted, "part binary").collect()]
    if not parts:  # no rows and no task
        return train([], np.zeros(0, np.int64))
    vectors, weights, bias = (np.frombuffer(p, np.float32) for p in parts)
    return Model(vectors.reshape(BUCKETS, DIMS), weights.reshape(DIMS, 2), bias)


def _scored(margins: np.ndarray, bias: float, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[float, int]] = {}
        for batch in batches:
            for part in row_slices(batch, "text", SLICE_BYTES):
                scores = []
                for text in byte_texts(part, "text"):
                    total, many = 0.0, 0
                    for word in words_of(text):
                        told = known.get(word)
                        if told is None:
                            own = entries(word)
                            told = (float(margins[own].sum()), len(own))
                            if len(known) >= REMEMBERED:
                                known.clear()
                            known[word] = told
                        total += told[0]
                        many += told[1]
                    scores.append(total / max(many, 1) + bias)
                odds = np.clip(np.array(scores, np.float64), -700, 700)
                own = [part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*own, pa.array(1 / (1 + np.exp(-odds)))], names=[*names, "score"])

    return run


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs(..., text, ...)`` plus score (0 to 1, higher: likelier toxic) and predicted (0 or 1).

    A null, empty or blank text has the score of an empty bag, which the biases give.
    Columns of ``docs`` with the two names are replaced; no other column than text is
    read, and rows never meet, so repeats give equal results.
    """
    kept = docs.drop("score", "predicted")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + ", score double"
    bias = float(model.bias[1] - model.bias[0])
    scored = kept.mapInArrow(_scored(model.margins(), bias, kept.columns), schema)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
