"""Operators against plain versions on given rows."""

import re
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
import sentencepiece
from pyspark.sql import functions as F

from rebalance.llm import decontaminate, html_text, neardup, pieces, queries
from rebalance.llm.katz import discounts
from rebalance.llm.pieces import Encoder

SF = "/root/testdata/sf0.001"


def test_superminhash_against_plain_steps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 3, 40, 900)]
    values, offsets = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
    got, slots = neardup.superminhash(values, offsets, 16), 16
    for row, own in zip(got, sets):
        best = [float("inf")] * slots
        for x in own:
            order = list(range(slots))
            for j in range(slots):
                draw = int(neardup._mix(np.array([x + np.uint64(0x9E3779B97F4A7C15 * (j + 1) & (2**64 - 1))]))[0])
                k = j + ((draw & 0x7FF) * (slots - j) >> 11)
                order[j], order[k] = order[k], order[j]
                best[order[j]] = min(best[order[j]], (draw >> 11) * 2.0**-53 + j)
        assert row.tolist() == best


@pytest.mark.parametrize("name", ["near"])
def test_near_duplicates_brute_force(spark, name):
    got = {r.doc_id: r for r in queries.op8_near_duplicates(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    sets = {}
    for r in docs:
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 3]) for i in range(max(len(w) - 2, 1))} if w else set()
    root = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root[a], root[b]
                root = {d: min(x, y) if r in (x, y) else r for d, r in root.items()}
    assert {d: (r.n_shingles, r.component_id, r.kept) for d, r in got.items()} == {
        d: (len(s), root[d], root[d] == d) for d, s in sets.items()
    }


def test_pieces_equal_the_library():
    encoder = Encoder(queries.tokenizer())
    rng = random.Random(3)
    letters = " ▁  abthe\n\tcéñ漢😀\x00<s></s>#"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 90))) for _ in range(400)]
    assert [ids for ids, _ in encoder.encode(texts)] == encoder.library.encode(texts)
    assert not encoder.differ


class Asked:
    """The library, with a count of the texts it encodes; ``odd`` is a word it encodes otherwise."""

    def __init__(self, library, odd=None):
        self.library, self.odd, self.texts = library, odd, 0

    def __getattr__(self, name):
        return getattr(self.library, name)

    def encode(self, texts):
        if not isinstance(texts, str):
            return [self.encode(text) for text in texts]
        self.texts += 1
        if self.odd and self.odd in texts:
            return [5] if texts == self.odd else [5, *self.library.encode(texts)]
        return self.library.encode(texts)


def test_new_segments_are_merged_and_checked_together():
    encoder = Encoder(queries.tokenizer())
    encoder.library = library = Asked(encoder.library)
    rng = random.Random(8)
    words = ["".join(rng.choice("aeinorstéß.,\n😀") for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=40)) for _ in range(300)]
    got = encoder.encode(texts)
    assert library.texts < len(words) / 10  # one by one they cost most of the time
    assert got == [(ids, True) for ids in library.library.encode(texts)]
    asked = library.texts
    assert encoder.encode(texts) == got and library.texts == asked
    assert pieces.encoder_of(queries.tokenizer(), True) is pieces.encoder_of(queries.tokenizer(), True)


def test_the_word_of_the_library_counts():
    encoder = Encoder(queries.tokenizer())
    plain = encoder.library.encode
    encoder.library = Asked(encoder.library, "zqx")
    texts = ["first words here", "aa zqx bb", "", "last  words\nthere"]
    want = [(plain(text), True) for text in texts]
    want[1] = ([*plain("aa"), 5, *plain("bb")], False)
    assert encoder.encode(texts) == want == encoder.encode(texts)
    assert encoder.differ == {"▁zqx"}


def test_remembered_segments_are_bounded_by_their_size(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 5000)
    encoder = Encoder(queries.tokenizer())
    rng = random.Random(9)
    for n in range(60):
        texts = ["the cat and " + " ".join("".join(rng.choices("abcdef", k=rng.choice([3, 9, 60]))) for _ in range(30)) for _ in range(2)]
        assert [ids for ids, _ in encoder.encode(texts)] == encoder.library.encode(texts)
        assert encoder.weight == sum(len(p) + pieces.EACH for p in encoder.place) <= 5000
    assert {"▁the", "▁cat", "▁and"} <= encoder.place.keys()


def test_a_worker_encodes_a_batch_in_little_memory():
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 11))) for _ in range(100_000)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(800)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(800)), "text": texts})
    library = pieces.encoder_of(queries.tokenizer(), False).library
    run, got = pieces._encoded(queries.tokenizer(), False, False, ["doc_id"]), []
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    for part in run(iter([batch])):
        got.append(pa.compute.sum(part.column("ids").flatten()).as_py())
    most = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert sum(got) == sum(map(sum, library.encode(texts)))
    assert most < 56 << 20  # two such workers share an executor with a heap that earlier stages have filled


@pytest.mark.parametrize(
    "options",
    [
        {"byte_fallback": False},
        {"byte_fallback": True, "character_coverage": 0.98},
        {"byte_fallback": False, "add_dummy_prefix": False, "remove_extra_whitespaces": False},
        {"byte_fallback": False, "split_by_whitespace": False},
    ],
)
def test_pieces_of_other_models(tmp_path, options):
    rng = random.Random(10)
    words = ["".join(rng.choice("abcdeé漢") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    (tmp_path / "corpus").write_text("\n".join(" ".join(rng.choices(words, k=30)) for _ in range(200)))
    sentencepiece.SentencePieceTrainer.train(
        input=str(tmp_path / "corpus"), model_prefix=str(tmp_path / "m"), vocab_size=500, model_type="bpe", minloglevel=2, **options
    )
    encoder = Encoder(str(tmp_path / "m.model"))
    texts = ["".join(rng.choice(" ▁  abcdeé漢😀\n") for _ in range(rng.randint(0, 90))) for _ in range(300)]
    texts += [" ".join(rng.choices(words, k=20)) for _ in range(100)]
    assert encoder.encode(texts) == [(ids, True) for ids in encoder.library.encode(texts)]


def test_myers_and_pieces_find_edited_items():
    item = decontaminate.normalize("The quick brown fox, which jumps over 13 lazy dogs, runs away at dawn today!")
    matcher = decontaminate.Matcher([(5, item)], 0.06)
    text = "zzz " * 30 + "THE quick brown\nfox -- whch jumps over 13 lazy dogs; runs awayy at dawn today" + " yyy" * 9
    ((found, distance, start, end),) = matcher.find(text)
    assert (found, distance) == (5, 2) and text[start:end].startswith("THE") and text[start:end].endswith("today")
    assert matcher.find("the quick brown fox sleeps") == []
    rng = random.Random(4)
    for _ in range(200):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(1, 9)))
        b = "".join(rng.choice("ab") for _ in range(rng.randint(0, 14)))
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        got = decontaminate.myers(decontaminate.masks(a), len(a), b, len(a))
        assert (got[0] if got else len(a)) == min(row)


def test_base_spans(spark):
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def luhn(x):
        return sum(int(c) * (1 + i % 2) - 9 * (i % 2 and int(c) > 4) for i, c in enumerate(reversed(x))) % 10 == 0

    def fits(k, m):
        g = re.sub("[^0-9]", "", m)
        return k == "email" or (k == "ip" and all(int(p) < 256 for p in m.split("."))) or (
            k == "card" and 16 <= len(g) <= 19 and luhn(g)) or (k == "phone" and 8 <= len(g) <= 15)

    from rebalance.llm import pii

    rng = random.Random(5)
    parts = ["a@b.c", "%d@e.f", "1.2.3.4.5.6.7.8", "256.1.1.1", "10.0.0.1", "000.1.01.255", "0256.1.1.1", "4111 1111-11111111", "4111111111111112", "+1 (2) 345-6789)", "é", " ", "@", ".", "+", "12"]
    texts = ["".join(rng.choice(parts) for _ in range(12)) for _ in range(150)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find(rows).collect():
        want = [(k, m.start(), m.end()) for k, p in plain.items() for m in re.finditer(p, r.text) if fits(k, m[0])]
        assert [tuple(x) for x in r.base] == want


def test_shards_hold_the_law(spark):
    rows = queries.op10_shards(spark, SF).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == 200 and len(slots) == 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op10_shards(spark, SF).collect()))


def test_main_text():
    page = (
        "<html><head><title>T</title></head><body><nav><a href=x>Menu one</a></nav><div class='sidebar'><p>Side words here.</p></div>"
        "<article><header><h1>Head</h1></header><p>First  long&nbsp;paragraph &amp; more words, with a stop.<p>Ok.</article>"
        "<section id=comments><p>A reader says something long enough here.</p></section><form>Mail <input></form>"
        "<script>var a='<p>no</p>'</script><footer>&copy; X</footer></body></html>"
    )
    assert html_text.main_text(page) == "Head\n\nFirst long paragraph & more words, with a stop.\n\nOk."
    assert html_text.max_flow_side([3.0, -1.0, -9.0], [(0, 1, 2.0), (1, 2, 0.5)]) == [True, True, False]
    assert [html_text.main_text(x) for x in ("x", "<p>x</p>", "<p>One.<p>Two", "")] == ["x", "x", "One.\n\nTwo", ""]


def cut_cost(side, unary, edges):
    lost = sum(u for s, u in zip(side, unary) if u > 0 and not s) - sum(u for s, u in zip(side, unary) if u < 0 and s)
    return lost + sum(c for a, b, c in edges if side[a] != side[b])


def test_minimum_cut_against_all_labellings():
    rng = random.Random(6)
    for _ in range(150):
        n = rng.randint(1, 9)
        unary = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        got = cut_cost(html_text.max_flow_side(unary, edges), unary, edges)
        every = ([bool(k >> i & 1) for i in range(n)] for k in range(1 << n))
        assert got == pytest.approx(min(cut_cost(s, unary, edges) for s in every))


def test_the_cut_corrects_the_classifier():
    """Short and linked blocks inside unmarked prose stay, a lone sentence among menus goes."""
    long = "A sentence with a good number of words that nobody would take for a menu."
    prose = f"<div><p>{long}</p><p>{long}</p><p><a href=x>see there</a></p><p>{long}</p><p>{long}</p></div>"
    menu = "".join(f"<li><a href=/{i}>Entry {i}</a></li>" for i in range(6))
    page = html_text.blocks(f"<body><ul>{menu}<li>Top news today</li>{menu}</ul>{prose}<ul>{menu}</ul></body>")
    alone = [html_text.score(b, False) > 0 for b in page]
    wanted = [b.text == long or b.text == "see there" for b in page]
    assert html_text.label(page) == wanted != alone
    assert sum(a != w for a, w in zip(alone, wanted)) == 2


def test_wide_and_deep_pages_take_little_time():
    import time

    rng = random.Random(9)
    parts = []
    for i in range(10_000):
        word = "word " * rng.randint(1, 4)
        parts.append(f"<li><a href=x>{word}</a> {word}</li>" if rng.random() < 0.5 else f"<div>{word}<a>{word}</a></div>")
    start = time.process_time()
    page = html_text.blocks("".join(parts))
    html_text.label(page)
    assert time.process_time() - start < 2
    start = time.process_time()
    assert html_text.main_text("<div>" * 30_000 + "deep" + "</div>" * 30_000) == "deep"
    assert time.process_time() - start < 2


def test_discounts():
    plain = [1.0] + [(r - 0.5) / r for r in range(1, 6)]
    assert discounts([0, 1, 1, 1, 1, 1]) == plain and discounts([]) == plain and discounts([5]) == plain
    # an exact power law: the line and Turing's ratio agree
    law = [round(1e9 * r**-2.5) for r in range(1, 7)]
    common = 6**-1.5
    assert discounts(law)[1:] == pytest.approx([((1 + 1 / r) ** -1.5 - common) / (1 - common) for r in range(1, 6)], rel=1e-3)
    for counts in ([1000, 300, 140, 90, 60, 40], [193655, 25105, 6496, 2179, 2497, 618], [49663, 12919, 5197, 2729, 2383, 1067]):
        got = discounts(counts)
        assert all(0 < d < 1 for d in got[1:]) and got != plain


def plain_katz(texts, train):
    """(chance of w after h, vocabulary, histories, totals) with dictionaries."""
    from collections import Counter

    single, pairs = Counter(), Counter()
    for text, learnt in zip(texts, train):
        if learnt:
            words = [b"", *(text or "").encode().lower().split(), b""]
            single.update(words[1:])
            pairs.update(zip(words, words[1:]))
    followers = {}
    for (h, w), c in pairs.items():
        followers.setdefault(h, {})[w] = c
    of = lambda table: discounts([sum(c == r for c in table.values()) for r in range(1, 7)])
    d1, d2 = of(single), of(pairs)
    cut = lambda d, c: c * (d[c] if c < len(d) else 1.0)
    total, kept = sum(single.values()), sum(cut(d1, c) for c in single.values())
    unknown = 1 - kept / total
    scale = (1 - unknown) / kept
    one = lambda w: scale * cut(d1, single[w]) if w in single else unknown

    def chance(h, w):
        own = followers.get(h)
        if own is None:
            return one(w)
        c = sum(own.values())
        left, size = 1 - sum(cut(d2, x) for x in own.values()) / c, 1.0
        if left < 1e-12:
            left, size = 1 / (c + 1), c / (c + 1)
        if w in own:
            return cut(d2, own[w]) / c * size
        return left / (1 - sum(one(x) for x in own)) * one(w)

    return chance, single, followers, d2


def test_katz_against_plain_version(spark):
    from rebalance.llm import katz

    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = [r for r in rows if len(r.text) < 1500]
    train = [not katz.held_out_seventh(r.doc_id) for r in rows]
    chance, single, followers, ratios = plain_katz([r.text for r in rows], train)
    assert ratios[1] != 0.5  # Good-Turing, not the fallback
    for h in list(followers)[::40]:
        assert sum(chance(h, w) for w in single) + chance(h, b"never seen\n") == pytest.approx(1, abs=1e-9)
    docs = spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string")
    got = {r.doc_id: r for r in katz.score(docs.repartition(4), katz.held_out_seventh).collect()}
    n, v = sum(single.values()), len(single)
    for r in rows:
        words = [b"", *r.text.encode().lower().split(), b""]
        x = got[r.doc_id]
        want = sum(np.log10(chance(h, w)) for h, w in zip(words, words[1:]))
        base = sum(np.log10((single[w] + 1) / (n + v + 1)) for w in words[1:])
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(words) - 1, sum(w in single for w in words[1:]), n)
        assert x.score == pytest.approx(want, rel=1e-9) and x.base_score == pytest.approx(base, rel=1e-9)


def plain_katz_of_order(texts, train, order):
    """(chance of w after a history, words, histories) by recursion over dictionaries."""
    from collections import Counter

    sequences = [Counter() for _ in range(order)]
    for text, learnt in zip(texts, train):
        words = [b""] * (order - 1) + [*(text or "").encode().lower().split(), b""]
        for i in range(order - 1, len(words) if learnt else 0):
            for n in range(order):
                sequences[n][tuple(words[i - n : i + 1])] += 1
    followers = {}
    for table in sequences[1:]:
        for (*h, w), c in table.items():
            followers.setdefault(tuple(h), {})[w] = c
    ratios = [discounts([sum(c == r for c in table.values()) for r in range(1, 7)]) for table in sequences]
    cut = lambda n, c: c * (ratios[n][c] if c < len(ratios[n]) else 1.0)
    single, weights = sequences[0], {}
    total, kept = sum(single.values()), sum(cut(0, c) for c in single.values())
    unknown = 1 - kept / total

    def chance(h, w):
        if not h:
            return (1 - unknown) / kept * cut(0, single[w,]) if (w,) in single else unknown
        if h not in followers:
            return chance(h[1:], w)
        own = followers[h]
        c = sum(own.values())
        if h not in weights:
            left = 1 - sum(cut(len(h), x) for x in own.values()) / c
            flat = left < 1e-12
            left = 1 / (c + 1) if flat else left
            weights[h] = (c / (c + 1) if flat else 1.0, left / (1 - sum(chance(h[1:], x) for x in own)))
        size, alpha = weights[h]
        return cut(len(h), own[w]) / c * size if w in own else alpha * chance(h[1:], w)

    return chance, [w for (w,) in single], followers


@pytest.mark.parametrize("order, bucket_grams", [(3, 1_000_000), (3, 40), (4, 300), (2, 40)])
def test_katz_of_order_against_plain_recursion(spark, order, bucket_grams):
    from rebalance.llm import katz

    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(words[: 3 + i % 28], 1 + i % 23))) for i in range(150)]
    # seen sequences that recur, repeated and missing ids, empty texts, words that only held-out texts have
    rows += [(i, "a b a B c a b") for i in range(200, 230)] + [(7, "x y z x y"), (7, None), (None, ""), (8, " "), (5, "x q r x y z")]
    rows += [(j, "only z here a b") for j in range(300, 320)] + [(j, f"new{j} a b only x") for j in range(400, 440) if katz.held_out_seventh(j)]
    train = [not katz.held_out_seventh(i) for i, _ in rows]
    assert 0 < sum(train) < len(train)
    chance, single, followers = plain_katz_of_order([t for _, t in rows], train, order)
    assert any(len(h) == order - 1 for h in followers)
    for h in list(followers)[::9]:
        assert sum(chance(h, w) for w in single) + chance(h, b"never seen\n") == pytest.approx(1, abs=1e-9)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = katz.score(docs, katz.held_out_seventh, order=order, bucket_grams=bucket_grams).collect()
    want = []
    for i, text in rows:
        own = [b""] * (order - 1) + [*(text or "").encode().lower().split(), b""]
        score = sum(np.log10(chance(tuple(own[k - order + 1 : k]), own[k])) for k in range(order - 1, len(own)))
        want.append((i is None, i or 0, len(own) - order + 1, score))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.score) for r in got)
    for x, y in zip(got, sorted(want), strict=True):
        assert x[:3] == y[:3] and x[3] == pytest.approx(y[3], rel=1e-9)


def test_word_numbers_packing_and_tuples():
    import pyarrow as pa

    from rebalance.llm.katz import pack, tuple_numbers, unpack, word_numbers

    rng = random.Random(3)
    for k in (0, 1, 200):
        texts = [None if rng.random() < 0.1 else "".join(rng.choices("aAbÉé \t\n\x0b\r\x1c\x85\u2003\0", k=rng.randrange(12))) for _ in range(k)]
        words, number, sizes = word_numbers(pa.array(["cut off", *texts], pa.string()).slice(1))
        want = [[*(t or "").encode().lower().split(), b""] for t in texts]
        assert [words[i] for i in number] == sum(want, []) and sizes.tolist() == [len(w) for w in want]
        assert len(set(words)) == len(words) and b"" in words
    draw = np.random.default_rng(1)
    for n in (0, 1, 700):
        arrays = [draw.integers(-(2**62), 2**62, n), draw.integers(-1, 100, n), draw.random(n), draw.integers(0, 2**32, n).astype("u4")]
        back = unpack(pack(*arrays), "i8", "i8", "f8", "u4")
        assert all(x.dtype == y.dtype and x.tolist() == y.tolist() and y.flags.writeable for x, y in zip(arrays, back))
    wide = [draw.integers(-1, 5, 600) * 2**40 for _ in range(3)]  # more than 63 bits in all
    wide = [np.maximum(c, -1) for c in wide]
    number, tuples = tuple_numbers(*wide), list(zip(*(c.tolist() for c in wide)))
    assert [tuples[i] for i in np.argsort(number, kind="stable")] == sorted(tuples) and len(set(number.tolist())) == len(set(tuples))


def test_op5_uses_triples(spark, tmp_path):
    from rebalance.llm import katz

    rows = [(i, "a b c d") for i in range(20)] + [(i, "x b e f") for i in range(20, 40)] + [(i, f"g{i % 9} h{i % 4} b") for i in range(40, 90)]
    rows += [(900, "a b c d"), (901, "a b e f")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.score for r in queries.op5_katz_lm(spark, str(tmp_path)).collect()}
    chance, _, _ = plain_katz_of_order([t for _, t in rows], [not katz.held_out_seventh(i) for i, _ in rows], 3)
    for i, text in rows:
        own = [b"", b"", *text.encode().split(), b""]
        assert got[i] == pytest.approx(sum(np.log10(chance((a, b), w)) for a, b, w in zip(own, own[1:], own[2:])), rel=1e-9)
    assert got[901] < got[900]  # word pairs alone give both the same


def test_near_duplicates_by_row_not_by_id(spark):
    a = " ".join(f"w{i}" for i in range(200))
    near, other = a.replace("w100 ", ""), " ".join(f"v{i}" for i in range(50))
    third = " ".join(f"u{i}" for i in range(50))
    for rows in ([(7, a), (7, other), (9, near)], [(7, other), (7, a), (9, near)]):
        df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()} == {7: 7, 9: 7}
    rows = [(None, a), (None, other), (None, third), (7, near), (7, third + " x"), (None, None), (5, ""), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_row", F.lit("clash"))
    left = neardup.one_of_each(df, width=5, percent=80)
    assert left.columns == df.columns
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in left.collect())
    assert got == sorted([(False, 5, ""), (False, 5, ""), (False, 7, near), (False, 7, third + " x"), (True, 0, ""), (True, 0, other)])


def test_many_copies_without_ids_meet_once(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(None, " ".join([*base, f"end{i % 150}"])) for i in range(600)] + [(4, " ".join([*base, "end3"]))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 601 and {r.component_id for r in got} == {4} and sum(r.kept for r in got) == 1


def test_decontamination_by_row_not_by_id(spark):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (2, "another item of some length here")], "item_id long, text string")
    hit = "so: The quick brown fox jumped over the lazy dog!"
    rows = [(None, hit), (3, hit), (3, "clean"), (None, "clean too"), (4, None), (5, "Another item of some length, here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(1))
    for size in (16_000_000, 40):
        left = decontaminate.decontaminate(docs, bench, chunk_chars=size)
        assert left.columns == docs.columns
        assert sorted(str(r.text) for r in left.collect()) == ["None", "clean", "clean too"]


def test_matches_against_full_scan(spark):
    """Every item against every text by a plain edit distance over all ends."""

    def least(item, text):
        row = [0] * (len(text) + 1)
        for i, x in enumerate(item, 1):
            last, row = row, [i]
            for j, y in enumerate(text, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return min(row)

    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    items = [" ".join(rng.choice(words) for _ in range(9)) for _ in range(6)]
    texts = []
    for _ in range(60):
        body = list(rng.choice(items)) if rng.random() < 0.7 else []
        for _ in range(rng.randint(0, 5)):
            if body:
                body[rng.randrange(len(body))] = rng.choice(["", "x", "qq"])
        texts.append(" ".join([*rng.choices(words, k=4), "".join(body), *rng.choices(words, k=4)]))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = set()
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            norm = decontaminate.normalize(item)
            if (e := least(norm, decontaminate.normalize(text))) <= decontaminate.budget(norm, 0.06):
                want.add((d, i, e))
    for size in (16_000_000, 120):
        got = decontaminate.matches(docs, bench, chunk_chars=size).collect()
        assert {(r.doc_id, r.item_id, r.distance) for r in got} == want and len(got) == len(want) > 20


def test_many_spans_and_masks(spark):
    from rebalance.llm import pii

    n = 5000
    long = " ".join(f"x 10.0.{i % 256}.{i % 7} a{i}@b.org" for i in range(n))
    rows = [(1, long), (2, "1.1.1.1"), (3, "no"), (4, None), (5, "a@b.c,+12 345 678 90; 4111111111111111")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(docs).withColumn("m", pii.masked(F.coalesce("text", F.lit("")), F.col("spans"))).collect()}
    ips = [x for x in got[1].base if x.kind == "ip"]
    assert len(ips) == n and len(got[1].base) == 2 * n
    assert [(x.start, x.end) for x in ips] == [m.span() for m in re.finditer(r"[0-9]+(?:\.[0-9]+){3}", long)]
    assert got[1].m == re.sub(r"a[0-9]+@b.org", "[email]", re.sub(r"[0-9]+(\.[0-9]+){3}", "[ip]", long))
    assert (got[2].m, got[3].m, got[4].m) == ("[ip]", "no", "")
    assert got[5].m == "[email],[phone]; [card]"


def plain_quality(rows, trusted, bits=15):
    """All columns of ``quality.judge`` by doc_id, with loops and dictionaries."""
    import math

    import xxhash

    def buckets(words):
        out = []
        for i, w in enumerate(words):
            h = xxhash.xxh64_intdigest(w.encode(), seed=42)
            if i + 1 < len(words):
                h = xxhash.xxh64_intdigest(words[i + 1].encode(), seed=h)
            out.append(h & ((1 << bits) - 1))
        return out

    split = {i: [w.decode() for w in (t or "").encode().split()] for i, t in rows}
    size = 1 << bits
    good, every = [0] * size, [0] * size
    for i, words in split.items():
        for b in buckets(words):
            every[b] += 1
            good[b] += i in trusted
    n_good, n_every = sum(good), sum(every)
    weight = [
        math.log((g + 1) / (n_good + size)) - math.log((e + 1) / (n_every + size)) if n_good else 0.0
        for g, e in zip(good, every)
    ]
    out = {}
    for i, text in rows:
        words = split[i]
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        often = {w for w in windows if windows.count(w) > 1} if len(set(windows)) < len(windows) else set()
        repeated = {k + j for k, w in enumerate(windows) if w in often for j in range(8)}
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        seen, dup = set(), 0
        for x in lines:
            dup += x in seen
            seen.add(x)
        inked = "".join(words)
        llr = sum(weight[b] for b in buckets(words)) / len(words) if words else None
        failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
        symbols = sum(c in "#*$%&|<>" for c in inked)
        out[i] = (len(words), len(inked), symbols, dup, len(repeated), failed, llr, not failed and llr >= -0.12)
    return out


def test_quality_against_plain_version(spark):
    from rebalance.llm import quality

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    docs = [x for x in docs if len(x[1]) < 6000]
    docs += [(-1, None), (-2, ""), (-3, "a\n\nb\n \na\nb c"), (-4, "one two three four five six seven eight " * 4), (-5, "# | x\x1cy é<>")]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    trusted = quality.trusted_ids(labels)
    ids = {r.doc_id for r in trusted.collect()}
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    want = plain_quality(docs, ids)
    got = quality.judge(rows, trusted).collect()
    assert len(got) == len(want) and sum(r.kept for r in got) > 20
    for r in got:
        *counts, llr, kept = want[r.doc_id]
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed] == counts, r.doc_id
        assert r.llr == (None if llr is None else pytest.approx(llr, abs=1e-9)) and (r.kept == kept or abs(llr + 0.12) < 1e-9)


def test_pipeline_stages_on_odd_rows(spark, hard):
    """Every stage on nulls, repeats and missing ids: rows are judged one by one, none vanishes with another's id."""
    from rebalance.llm import stages

    flow = " ".join(f"word{i}" for i in range(40))
    rows = [(None, flow), (None, flow + " end"), (7, flow), (7, "some quite other text mail a.b@c.org " * 3), (8, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.lit(1)).withColumn("kept", F.lit("clash"))
    left = stages.near_dedup(spark, docs, SF)
    assert left.columns == docs.columns
    assert sorted((str(r.doc_id), r.text or "") for r in left.collect()) == sorted(
        [("7", flow), ("7", rows[3][1]), ("8", ""), ("8", "")]
    )
    clean = stages.benchmark_decontamination(spark, docs, SF)
    assert clean.columns == docs.columns and clean.count() == 6
    private = stages.private_data(spark, docs, SF)
    assert private.columns == docs.columns
    assert sum((r.text or "").count("[email]") for r in private.collect()) == 3
    done = stages.token_ids(spark, docs, SF)
    assert done.count() == 6 and {"doc_id", "ids", "text"} <= set(done.columns)
    good = stages.quality_rules(spark, docs, SF)
    assert good.columns == docs.columns
    assert {r.text for r in good.collect()} <= {r[1] for r in rows}
    for step in (stages.quality_rules, stages.near_dedup, stages.benchmark_decontamination, stages.private_data, stages.token_ids):
        assert step(spark, docs.where("false"), SF).collect() == []


def test_pipeline_is_its_stages_in_a_row(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, SF).persist()
    want = sorted((r.doc_id, tuple(r.ids)) for r in docs.collect())
    assert sorted((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, SF).collect()) == want and want
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "near-dedup", "benchmark decontamination", "personal data", "sentencepiece"
    ]


def test_added_spans_on_planted_credentials(spark):
    """Recall and precision of the learnt kind over documents with and without a credential."""
    from rebalance.llm import pii

    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rng = random.Random(10)
    known, more = set(), []
    for r in rows.collect():
        for m in re.finditer(r'token = "([0-9a-f]{40})"', r.text):
            known.add((r.doc_id, m.start(1), m.end(1)))
    frames = ['password: "{}" was set', "api_key={} in the file", "secret = {};", "export TOKEN={}"]
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    for i in range(60):
        value = "".join(rng.choice(letters) for _ in range(rng.randint(20, 40))) + "7a"
        text = "Some words before " + rng.choice(frames).format(value) + " and after it."
        more.append((-1 - i, text))
        known.add((-1 - i, text.index(value), text.index(value) + len(value)))
    plain = ["see https://example.org/articles/some-long-title-of-2024", "version_of_the_long_identifier_2", "the well-known-compound-word-no1 here"]
    more += [(-100 - i, t) for i, t in enumerate(plain)]
    docs = rows.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    found = {(r.doc_id, x.start, x.end) for r in pii.find(docs).collect() for x in r.spans if x.kind == "secret"}
    assert len(found & known) >= 0.95 * len(known) and len(found & known) >= 0.95 * len(found)
