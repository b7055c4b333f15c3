"""Two-pass external shuffle into shards.

Pass one scatters the rows into memory-sized buckets by a seeded hash. Pass two
loads each bucket, puts it into a fixed order, shuffles it by Fisher-Yates
(``shuffle``) and writes it. Buckets follow each other in the shuffled order, so
a row's place is the number of rows in earlier buckets plus its place in its own;
the place gives shard (remainder) and slot (quotient): shard sizes differ by one
row at most. Only the count of every bucket is summed up in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rebalance.staging import new_path, stage

SEED = 20240229
BUCKET_BYTES = 8 << 20
BROADCAST_BUCKETS = 500_000  # starts of more buckets are joined by a shuffle


def scatter(docs: DataFrame, *, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The shuffled buckets, written and read back: (bucket, place, then the columns of ``docs``).

    The hash takes the number of the row in its input split beside its text, so
    equal rows spread like others. Given the same files and split settings the
    same seed gives the same order, also when tasks are run again.
    """
    spark, names = docs.sparkSession, docs.columns
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 1
    total = docs.agg(F.sum(size.cast("long"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("__of"))
    key = F.xxhash64(F.lit(seed), F.col("__row"), F.col("__of.text"))
    rows = rows.select(F.pmod(key, F.lit(buckets)).cast("int").alias("bucket"), "__row", "__of")
    rows = rows.repartition(buckets, "bucket")
    loaded = rows.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("__row", "__of"))).alias("rows"))
    shuffled = loaded.sortWithinPartitions("bucket").select("bucket", F.shuffle("rows", seed).alias("rows"))
    placed = shuffled.select("bucket", F.posexplode("rows").alias("place", "x"))
    placed = placed.select("bucket", "place", F.col("x.__of").alias("of"))
    path = new_path(spark, "buckets")
    placed.write.parquet(path)
    return spark.read.schema(placed.schema).parquet(path)


def shards(docs: DataFrame, count: int, *, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(of, shard, slot) for every row; ``of`` is a struct of the columns of ``docs``.

    ``docs`` needs a text column (its bytes size the buckets; null counts as
    empty). Shards are 0 to count - 1, slots gapless from 0. An empty table gives
    no rows. Equal rows are dealt as any others.
    """
    written = scatter(docs, seed=seed, bucket_bytes=bucket_bytes)
    sizes = stage(written.groupBy("bucket").agg(F.count("*").alias("n")), "bucket-sizes")
    before = F.sum("n").over(Window.orderBy("bucket")) - F.col("n")  # one short row for each bucket
    starts = sizes.select("bucket", before.alias("start"))
    if sizes.count() <= BROADCAST_BUCKETS:
        # two numbers for each bucket; without the hint the texts are shuffled before this is known
        starts = F.broadcast(starts)
    place = F.col("start") + F.col("place")
    return written.join(starts, "bucket").select(
        "of", (place % count).cast("int").alias("shard"), F.floor(place / F.lit(count)).cast("long").alias("slot")
    )


def write_shards(docs: DataFrame, path: str, count: int, **options) -> None:
    """Write one folder ``shard=<n>`` each with slot and the columns of ``docs``, sorted by slot."""
    dealt = shards(docs, count, **options).select("shard", "slot", "of.*")
    dealt.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
