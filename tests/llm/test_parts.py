"""Written shards, slices of batches, clashing columns, empty tables, and values on the table of hard rows."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rebalance.llm import chat, html_text, katz, pieces, pii, quality, sharding
from rebalance.llm.common import row_slices
from rebalance.llm.queries import tokenizer


def test_slices_hold_whole_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (3, 4, 50, 1, 1)] + [None, ""], "n": list(range(7))})
    got = [part.column("n").to_pylist() for part in row_slices(batch, "text", 7)]
    assert got == [[0, 1], [2], [3, 4, 5, 6]]
    assert list(row_slices(batch.slice(0, 0), "text", 7)) == []


def test_shards_are_written_in_order(spark, hard, tmp_path):
    path = str(tmp_path / "out")
    sharding.write_shards(hard, path, 2, bucket_bytes=50_000)
    rows = spark.read.parquet(path).collect()
    assert len(rows) == 9
    for s in (0, 1):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(5 - s))
    key = lambda r: (str(r.doc_id), str(r.text))
    assert sorted(map(key, rows)) == sorted(map(key, hard.collect()))
    dealt = {(r["of"].doc_id, r["of"].text, r.shard, r.slot) for r in sharding.shards(hard, 2, bucket_bytes=50_000).collect()}
    assert dealt == {(r.doc_id, r.text, r.shard, r.slot) for r in rows}


def test_a_text_column_of_pages_is_replaced(spark):
    page = "<article><p>One two three.</p></article>"
    rows = spark.createDataFrame([(1, page, "old", 2.0)], "page_id long, html string, text string, x double")
    out = html_text.extract(rows)
    assert out.columns == ["page_id", "x", "text"] and tuple(out.first()) == (1, 2.0, "One two three.")


def test_no_conversations(spark):
    kind = "id long, prompt string, completion string, turns int"
    assert chat.format_chats(spark.createDataFrame([], kind), ["prompt", "completion"]).collect() == []
    one = chat.format_chats(spark.createDataFrame([(1, "q", "a", 9)], kind), ["prompt", "completion"]).first()
    assert [(t.role, t.text) for t in one.turns] == [("user", "q"), ("assistant", "a")]


def by_id(df, *names):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(tuple(r[n] for n in names))
    return out


def test_values_on_hard_rows(spark, hard):
    labels = spark.createDataFrame([(1, 1, 0), (6, 1, None)], "doc_id long, quality int, toxic int")
    judged = by_id(quality.judge(hard, quality.trusted_ids(labels)), "n_words", "n_repeat_words", "base_failed", "kept")
    assert judged[1] == [(7, 0, True, False)] and judged[3] == judged[4] == judged[5] == [(0, 0, True, False)]
    assert judged[6] == [(9001, 9000, True, False)] and judged[7] == judged[6] * 2
    encoded = by_id(pieces.encode(hard, tokenizer()), "ids", "decoded")
    assert encoded[3] == encoded[4] == [([2], "")] and encoded[7][0] == encoded[7][1] == encoded[6][0]
    found = by_id(pii.find(hard), "base")
    assert [(x.kind, x.start, x.end) for x in found[1][0][0]] == [("email", 19, 28)]
    assert found[3] == found[6] == [([],)]
    scored = by_id(katz.score(hard, lambda i: i == 2), "held_out", "n_tokens", "n_known")
    assert scored[2] == [(True, 8, 8)] and scored[3] == scored[4] == scored[5] == [(False, 1, 1)]
    assert scored[7] == [(False, 9002, 9002)] * 2


@pytest.mark.parametrize("name", ["pii", "pieces"])
def test_clashing_names_are_replaced(hard, name):
    clash = hard.withColumns({c: F.lit("old") for c in ("base", "spans", "ids", "decoded", "agrees")})
    out = pii.find(clash) if name == "pii" else pieces.encode(clash, tokenizer())
    kinds = dict(out.dtypes)
    replaced = ("base", "spans") if name == "pii" else ("ids", "decoded", "agrees")
    assert all(len([c for c in out.columns if c == r]) == 1 for r in replaced)
    assert (kinds["base"] if name == "pii" else kinds["ids"]).startswith("array")
