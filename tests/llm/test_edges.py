"""Every operator on nulls, empty and long texts, repeats, clashing names and empty tables."""

import pytest
from pyspark.sql import functions as F

from rebalance.llm import chat, decontaminate, html_text, katz, neardup, pieces, pii, quality, sharding, urls
from rebalance.llm.queries import tokenizer


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (6, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int")


def runs(spark, labels):
    bench = spark.createDataFrame([(1, "aa bb cc dd"), (2, None), (3, "...")], "item_id long, text string")
    return {
        "quality": lambda d: quality.judge(d, quality.trusted_ids(labels)),
        "neardup": neardup.near_duplicates,
        "pieces": lambda d: pieces.encode(d, tokenizer()),
        "pii": pii.find,
        "katz": lambda d: katz.score(d, katz.held_out_seventh),
        "shards": lambda d: sharding.shards(d, 3, bucket_bytes=50_000),
        "matches": lambda d: decontaminate.matches(d, bench),
        "decontaminate": lambda d: decontaminate.decontaminate(d, bench),
    }


NAMES = ["quality", "neardup", "pieces", "pii", "katz", "shards", "matches", "decontaminate"]


@pytest.mark.parametrize("name", NAMES)
def test_rows_of_hard_table(spark, labels, hard, name):
    done = runs(spark, labels)[name](hard).collect()
    if name == "matches":
        assert sorted((r.doc_id, r.item_id, r.distance) for r in done) == [(1, 1, 0), (2, 1, 0)]
    elif name == "decontaminate":
        assert sorted(-1 if r.doc_id is None else r.doc_id for r in done) == [-1, 3, 4, 5, 6, 7, 7]
    else:
        assert len(done) == 9


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, labels, empty, name):
    assert runs(spark, labels)[name](empty).collect() == []


def test_filter_on_verdict(spark, labels, hard):
    judged = quality.judge(hard, quality.trusted_ids(labels))
    assert judged.where("kept").count() == judged.where("n_words >= 20 and not base_failed and kept").count()


def test_urls_and_pages_and_chats(spark):
    rules = spark.createDataFrame([("Example.com", "/a", "block"), (None, "/", "block"), ("com", "/", "allow")], "host string, path string, verdict string")
    pages = spark.createDataFrame(
        [(1, "http://X.EXAMPLE.com/ab?q", ""), (2, None, None), (3, "no url", "x"), (None, "http://com", "<p>")],
        "page_id long, url string, html string",
    )
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, rules).collect()}
    assert got == {
        1: ("x.example.com", "/ab", "example.com/a", "block"), 2: ("", "", None, "allow"),
        3: ("", "", None, "allow"), None: ("com", "", None, "allow"),
    }
    assert {r.verdict for r in urls.judge(pages, rules.where("false")).collect()} == {"allow"}
    assert urls.judge(pages.where("false"), rules).collect() == []
    assert {r.page_id: r.text for r in html_text.extract(pages).collect()} == {1: "", 2: "", 3: "x", None: ""}
    assert html_text.extract(pages.where("false")).collect() == []
    turns = "array<struct<role:string,content:string>>"
    odd = ["", "\\", "##", "###", "</turn>", "\\### a: </turn> b", "a:b", "x\n### y: z</turn>\n"]
    rows = [(1, [(r, t) for r, t in zip(odd, reversed(odd))], None, None), (2, None, "q", "a"), (3, None, None, "only"), (4, [], None, None)]
    chats = spark.createDataFrame(rows, f"id long, messages {turns}, prompt string, completion string")
    done = chat.format_chats(chats, ["messages", "prompt", "completion"])
    read = {r.id: r for r in done.select("id", "layout", chat.read_turns(F.col("formatted")).alias("t")).collect()}
    assert [(x.role, x.text) for x in read[1].t] == list(zip(odd, reversed(odd)))
    assert [(x.role, x.text) for x in read[2].t] == [("user", "q"), ("assistant", "a")]
    assert read[3].layout is None and read[4].layout is None
