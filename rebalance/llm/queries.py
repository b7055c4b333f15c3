"""The registered queries of this folder and their SQL twins."""

from __future__ import annotations

import os
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rebalance.llm import (
    alignment, chat, decontaminate, html_text, katz, neardup, periods, pieces, pii, quality, sharding, toxicity, urls,
)
from rebalance.llm.common import table, words_of

MODEL = "piece_bpe_32k.model"
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def tokenizer(name: str = MODEL) -> str:
    """The vocabulary file; TOKENIZER_DIR names another folder."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def conversation_records(conversations: DataFrame) -> DataFrame:
    """Conversations as nested records: prompt pairs, instructions, or message lists.

    The turns of a conversation meet in one row, since its formatted text is one value.
    """
    turns = conversations.select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content")).alias("x")
    )
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    roles = F.array_join(F.transform("x", lambda t: t["role"]), "|")
    pair, triple = roles == "user|assistant", roles == "system|user|assistant"

    def content(when, i: int):
        return F.when(when, F.get("x", F.lit(i))["content"])

    messages = F.transform("x", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    return own.select(
        "conv_id",
        F.when(~(pair | triple), messages).alias("messages"),
        content(pair, 0).alias("prompt"),
        content(pair, 1).alias("completion"),
        content(triple, 0).alias("instruction"),
        content(triple, 1).alias("input"),
        content(triple, 2).alias("output"),
    )


def op1_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    hard = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    records = conversation_records(rows)
    done = chat.format_chats(records, [c for c in records.columns if c != "conv_id"])
    read = done.select("conv_id", "layout", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        digest.alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "layout",
    )


OP1 = r"""with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (select *, replace(replace(replace(text, '\', '\\'), '##', '#\#'), '</turn', '<\/turn') as body,
  replace(replace(replace(replace(role, '\', '\\'), '##', '#\#'), '</turn', '<\/turn'), ':', '\:') as head from t),
g as (select conv_id, count(*) as n_turns,
  string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns,
  coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '') as loss,
  string_agg(role, '|' order by turn, role, text) as roles,
  sum(4 + length(head) + 2 + length(body) + 8)::bigint as formatted_chars from e group by conv_id)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256,
  formatted_chars, case roles when 'user|assistant' then 'prompt' when 'system|user|assistant' then 'instruction'
  else 'messages' end as layout from g"""


def op2_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    done = pieces.encode(table(spark, sf, "documents").select("doc_id", "text"), tokenizer())
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "agrees",
    )


def op3_pii(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.find(table(spark, sf, "documents").select("doc_id", "text"), keep_text=False)

    def count(kind: str):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, pii.KINDS), F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans")
    )


def op4_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf, "pages").select("page_id", "url"), rules)


OP4 = """with r(host, path, verdict) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u as (select page_id, case when url like '%://%' then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from u),
p as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from h)
select page_id, host, path,
  (select r.host || r.path from r where (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
   order by length(r.host || r.path) desc limit 1) as rule,
  coalesce((select verdict from r where (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
   order by length(r.host || r.path) desc limit 1), 'allow') as verdict from p"""


def op5_katz_lm(spark: SparkSession, sf: str) -> DataFrame:
    return katz.score(table(spark, sf, "documents").select("doc_id", "text"), katz.held_out_seventh, order=3)


def op6_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return quality.judge(docs, quality.trusted_ids(table(spark, sf, "labels"))).drop("text")


def op7_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op8_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf, "documents"))


def op9_html_text(spark: SparkSession, sf: str) -> DataFrame:
    done = html_text.extract(table(spark, sf, "pages").select("page_id", "url", "html"))
    return done.withColumn("n_chars", F.length("text").cast("long"))


def op10_shards(spark: SparkSession, sf: str) -> DataFrame:
    dealt = sharding.shards(table(spark, sf, "documents").select("doc_id", "text"), 16)
    text = F.coalesce("of.text", F.lit(""))
    return dealt.select(
        "of.doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def id_hash() -> Column:
    """crc32 of the decimal doc_id; a missing id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8"))


def op11_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    held_out = id_hash() % 3 == 1
    model = toxicity.fit(docs, table(spark, sf, "labels"), ~held_out)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def with_periods(docs: DataFrame) -> DataFrame:
    """Documents whose words from some place on repeat, for one id hash in ten."""
    g, n = F.floor(id_hash() / 10), F.size("w").cast("long")
    a = F.expr("g % n")
    p = F.expr("1 + floor((n - a) / (3 + g % 8))")
    split = docs.select("doc_id", "text", words_of("text").alias("w"), id_hash().alias("h"), g.alias("g"))
    sized = split.withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, a)).withColumn("p", F.when(F.col("n") > 0, p))
    repeated = F.transform(
        "w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    )
    chosen = (F.col("h") % 10 == 0) & (F.col("n") > 0)
    return sized.select("doc_id", F.when(chosen, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op12_periods(spark: SparkSession, sf: str) -> DataFrame:
    found = periods.find_runs(with_periods(table(spark, sf, "documents").select("doc_id", "text")))
    ranked = F.array_sort(
        F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))
    )
    first = found.select("doc_id", "runs", "collapsed", F.get(ranked, F.lit(0)).alias("x"))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return first.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("x.start").alias("start"),
        (-F.col("x.l")).alias("length"),
        F.col("x.period").alias("period"),
        F.expr("-x.l * 1000 div x.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_alignment(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return alignment.measure(docs, tokenizer("byte_bpe_50k.json"), tokenizer())


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if root not in sys.path:
        sys.path.insert(0, root)
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_format, op2_sentencepiece, op3_pii, op4_url_filter, op5_katz_lm, op6_quality_rules,
        op7_decontaminate, op8_near_duplicates, op9_html_text, op10_shards, op11_toxicity, op12_periods,
        op13_alignment, pipeline,
    )
}
ORACLES = {"op1_chat_format": OP1, "op4_url_filter": OP4}
