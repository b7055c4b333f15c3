"""Runs, alignment and toxicity against plain versions, on given rows and on odd tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rebalance.llm import alignment, periods, queries, toxicity

SF = "/root/testdata/sf0.001"
FILES = queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer()


def plain_runs(w, least):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i - start + q
            if length >= max(least, 2 * q):
                found.setdefault((start, length), q)  # the smallest period comes first
    return sorted((s, q, n) for (s, n), q in found.items())


@pytest.mark.parametrize("seed", range(4))
def test_runs_against_every_period(seed):
    rng = random.Random(seed)
    for _ in range(300):
        letters = rng.choice([1, 2, 2, 3, 5])
        w = [rng.randrange(letters) for _ in range(rng.randint(0, 70))]
        if w and rng.random() < 0.6:
            a = rng.randrange(len(w))
            p = rng.randint(1, max(1, (len(w) - a) // 2))
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        least = rng.choice([2, 4, 12])
        start, length, period = (x.tolist() for x in periods.runs(np.array(w, np.int64), least))
        assert list(zip(start, period, length)) == plain_runs(w, least), w


def test_runs_of_fibonacci_words_and_one_word():
    a, b = [0], [0, 1]
    while len(b) < 300:
        a, b = b, b + a
    start, length, period = (x.tolist() for x in periods.runs(np.array(b)))
    assert list(zip(start, period, length)) == plain_runs(b, 12)
    assert [x.tolist() for x in periods.runs(np.zeros(200_000, np.int64))] == [[0], [200_000], [1]]


def changed_words(doc_id, text):
    """The words that op12 looks at, by the rule as it is worded."""
    w = [x.decode() for x in (text or "").encode().split()]
    h = zlib.crc32(str("" if doc_id is None else doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def test_op12_against_plain_version(spark):
    got = {r.doc_id: r for r in queries.op12_periods(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    checked = 0
    for r in docs:
        w = changed_words(r.doc_id, r.text)
        if len(w) > 900:
            continue
        checked += 1
        found = plain_runs(w, 12)
        drop = {i for s, q, n in found for i in range(s + q, s + n)}
        best = min(found, key=lambda x: (-x[2], x[0], x[1]), default=None)
        x = got[r.doc_id]
        assert x.n_runs == len(found)
        assert (x.start, x.period, x.length) == (best or (None,) * 3)
        assert x.exponent_milli == (best and 1000 * best[2] // best[1])
        lines = "".join(f"{s},{n},{q}\n" for s, q, n in found)
        assert x.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        left = " ".join(v for i, v in enumerate(w) if i not in drop)
        assert x.collapsed_sha256 == hashlib.sha256(left.encode()).hexdigest()
    assert checked > 150 and len(got) == 200


def test_runs_on_hard_and_empty_tables(hard, empty):
    clash = hard.withColumn("runs", F.lit(1)).withColumn("collapsed", F.lit("x"))
    rows = periods.find_runs(clash).select("doc_id", "n_words", "runs", "collapsed", "kept").collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.n_words, [tuple(x) for x in r.runs], r.collapsed, r.kept))
    assert by[3] == by[4] == by[5] == [(0, [], "", True)]
    assert by[6] == [(9001, [(0, 9000, 1)], "word end", True)] and by[7] == by[6] * 2
    assert by[None][0][:2] == (6, [])
    assert periods.find_runs(empty).collect() == []
    assert queries.with_periods(empty).collect() == []


def plain_alignment(aligner, text):
    """(a ids, b ids, groups, links) from byte ranges of whole texts; None without tokens."""
    raw = (" " + text).encode()
    a, b = aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)
    parts = [aligner.a_bytes[i] for i in a], [aligner.b_bytes[i] for i in b]
    if not text or any(b"".join(p) != raw for p in parts):
        return None
    ends = [np.cumsum([0, *map(len, p)]).tolist() for p in parts]
    cuts = sorted(set(ends[0]) & set(ends[1]))
    groups = []
    for low, high in zip(cuts, cuts[1:]):
        own = [[str(x) for x, s in zip(ids, e) if low <= s < high] for ids, e in zip((a, b), ends)]
        groups.append("|".join(map(",".join, own)))
    (ea, eb), links = map(np.array, ends), []
    for i, x in enumerate(a):
        first, last = np.searchsorted(eb, ea[i], "right") - 1, np.searchsorted(eb, ea[i + 1], "left")
        links += [(x, y) for y in b[first:last]]
    return a, b, groups, links


ODD = list(" \n\t　\x1c ▁abcDE12.,!?'é漢😀\x00​") + [" "] * 8 + ["</s>", "<|endoftext|>", "'s", "  ", "\n ", "\n  ", "the ", "ﬁ"]


def expected(texts):
    """The columns of op13 for given texts, all pairs in a plain dictionary."""
    aligner = alignment.Aligner(*FILES)
    found = [plain_alignment(aligner, t or "") for t in texts]
    counts = {}
    for x in found:
        for link in set(x[3]) if x else ():
            counts[link] = counts.get(link, 0) + 1
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for x in found:
        if x is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = x
        best = sum(counts[k] == most[k[0]] for k in links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((len(a), len(b), len(groups), len(links), best, sum(counts[k] for k in links), digest))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_against_whole_texts(spark, monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    texts += ["the cat sat on the mat", "the cat sat on the mat", "a cat, and the dog's end", None, "", "x" * 3000, "la " * 2000] * 3
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_a", F.lit("clash"))
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.measure(rows.repartition(5), *FILES).collect()}
    want = expected(texts)
    assert {i: got[i] for i in range(len(texts))} == dict(enumerate(want)) and len(got) == len(texts)


def test_alignment_counts_and_forgetting(spark):
    rows = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, "one")], "doc_id long, text string")
    _, counts = alignment.align(rows, *FILES)
    assert sorted(r.n for r in counts.collect()) == [2, 3]
    aligner = alignment.Aligner(*FILES)
    first = aligner.learn([" one", " two"])
    aligner.chars = alignment.REMEMBERED_CHARS + 1
    assert aligner.learn([" one"]) == {" one": first[" one"]}
    assert [list(x) for x in aligner.known] == [[], [" one", " two"]]
    assert aligner.learn([" two", " three"])[" two"] == first[" two"]
    assert [list(x) for x in aligner.known] == [[" two", " three"], [" one", " two"]]


def test_alignment_on_hard_and_empty_tables(hard, empty):
    rows = alignment.measure(hard, *FILES).select("doc_id", "kept", *COLUMNS).collect()
    want = expected([r.text for r in hard.collect()])
    key = lambda x: (x[0] is None, *map(str, x))
    assert sorted([(r.doc_id, *r[2:]) for r in rows], key=key) == sorted(
        [(r.doc_id, *w) for r, w in zip(hard.collect(), want)], key=key
    )
    assert alignment.measure(empty, *FILES).collect() == []


def test_toxicity_learns_words_and_misspellings(spark):
    rng = random.Random(7)
    plain = ["".join(rng.choice("aeioumnrstl") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    texts, toxic = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        bad = i % 3 == 0
        if bad:
            for _ in range(1 + len(words) // 15):
                words[rng.randrange(len(words))] = rng.choice(["scoundrelly", "blockheaded", "wretchful"])
        texts.append(" ".join(words))
        toxic.append(int(bad))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, x, 1) for i, x in enumerate(toxic)], "doc_id long, toxic int, quality int")
    held_out = queries.id_hash() % 3 == 1
    model = toxicity.fit(docs, labels, ~held_out)
    got = toxicity.score(docs.withColumn("held", held_out), model).collect()
    test = [r for r in got if r.held]
    right = [r.predicted == toxic[r.doc_id] for r in test]
    assert len(test) > 150 and sum(right) >= 0.97 * len(right)
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    words = " ".join(plain[:12])
    odd = spark.createDataFrame(
        [(1, f"{words} scoundrely"), (2, f"{words} blokheaded"), (3, words), (4, ""), (5, None)], "doc_id long, text string"
    )
    s = {r.doc_id: r.score for r in toxicity.score(odd, model).collect()}
    assert min(s[1], s[2]) > 0.7 > s[3] and s[4] == s[5] == pytest.approx(1 / (1 + np.exp(model.bias[0] - model.bias[1])))
    again = toxicity.fit(docs.repartition(3), labels.repartition(2), ~held_out)
    assert np.array_equal(model.vectors, again.vectors)
    # scores are what the softmax over the mean of the vectors gives
    one = toxicity.entries(b"wretchful") + toxicity.entries(b"sea")
    z = model.vectors[one].mean(axis=0).astype(float) @ model.weights + model.bias
    alone = spark.createDataFrame([("wretchful SEA",)], "text string")
    assert toxicity.score(alone, model).first().score == pytest.approx(1 / (1 + np.exp(z[0] - z[1])), rel=1e-4)


def test_toxicity_sample_is_bounded_and_clean(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_ROWS", 3)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)] + [(1, "text 0"), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(20)] + [(0, 1), (None, 1), (3, None), (5, 7)], "doc_id long, toxic int"
    )
    rows = toxicity.training_rows(docs, labels, F.col("doc_id") != 2).collect()
    assert len(rows) == 6 and len({r.text for r in rows}) == 6 and sum(r.toxic for r in rows) == 3


def test_toxicity_on_hard_and_empty_tables(spark, hard, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (6, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(hard, labels, F.lit(True))
    rows = toxicity.score(hard.withColumn("score", F.lit("clash")), model).collect()
    assert len(rows) == 9 and len({r.score for r in rows if not (r.text or "").strip()}) == 1
    assert len({r.score for r in rows if r.doc_id == 7}) == 1
    assert toxicity.score(empty, model).collect() == []
    nothing = toxicity.fit(empty, labels.where("false"), F.lit(True))
    assert {r.score for r in toxicity.score(hard, nothing).collect()} == {0.5}
    one = toxicity.fit(hard, labels.where("toxic = 0"), F.lit(True))
    assert {r.predicted for r in toxicity.score(hard, one).collect()} == {0}


def test_op11_never_learns_from_held_out_rows(spark):
    got = queries.op11_toxicity(spark, SF).collect()
    assert len(got) == 200
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert re.match(r"^\[\('doc_id', 'bigint'\), \('held_out', 'boolean'\)", str(queries.op11_toxicity(spark, SF).dtypes))


def test_segments_are_aligned_together_and_apart():
    """Segments whose bytes do not come back are left out; the others are as if alone."""
    aligner = alignment.Aligner(*FILES)
    segments = [" one", " Überzeugung", " x1,2|3;", " 　a", " don't", " 日本語", " a\tb"]
    a = [aligner.a.encode(s, add_special_tokens=False).ids for s in segments]
    b = [aligner.b.encode(s[1:]) for s in segments]
    raws = [s.encode() for s in segments]
    found = aligner.align(a, b, raws)
    assert found == [aligner.align([x], [y], [r])[0] for x, y, r in zip(a, b, raws)]
    for s, one in zip(segments, found):
        n_a, n_b, n_groups, groups, links = one or (0, 0, 0, "", b"")
        want = plain_alignment(aligner, s[1:])
        assert (one is None) == (not want or not want[0])
        if one:
            assert groups.count(";") == n_groups - 1 and (n_a, n_b) == (len(a[segments.index(s)]), len(b[segments.index(s)]))
    assert aligner.align([[], a[0]], [[], b[0]], [b"", raws[0]]) == [None, found[0]]
