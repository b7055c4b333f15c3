"""Synthetic minority rows between a row and one of its nearest neighbours."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rebalance.functions import draws
from rebalance.functions.vectors import check_metric, interpolate
from rebalance.operators.neighbors import neighbor_lists
from rebalance.operators.profile import (
    budget,
    check_percentage,
    check_plan,
    is_minority,
)
from rebalance.operators.ranking import global_rank, with_row_id
from rebalance.operators.scaling import (
    Features,
    scaled_vector,
    summarize,
    unscaled,
    unscaled_vector,
)
from rebalance.staging import stage

SEED = 1286082570  # fixed value: the default seed
RUN = 10_000  # copies of one seed that are made in a row
ROWS_PER_TASK = 1_000_000
QUOTA_SHIFT = 65536  # quota draws fall into 2^32 / 65536 histogram buckets


def minority(df: DataFrame, label: str, minority: Any) -> DataFrame:
    """The minority rows; the filter reaches the scan."""
    return df.where(is_minority(label, minority))


def quota_draw(seed: int, id_col: str) -> Column:
    return draws.draw32(draws.digest(seed, "quota", F.col(id_col)))


def allocate_copies(
    seeds: DataFrame, num_syn: int, num_pos: int | None = None, seed: int = SEED, id_col: str = "id"
) -> DataFrame:
    """``copies`` per seed, adding up to exactly ``num_syn``.

    Every seed gets ``num_syn`` divided by the number of seeds; the remainder goes, one
    each, to the seeds with the lowest draws. The seeds are counted here; a ``num_pos``
    that says otherwise is refused, and so is a number to create without seeds. Seeds that
    share an id share its draw; if just some of them are to get one copy more, any do.
    """
    copies = _copies(seeds, num_syn, num_pos, seed, id_col)
    if copies is None:
        told_apart = global_rank(seeds, id_col, rank="_row")
        copies = _copies(told_apart, num_syn, num_pos, seed, id_col, "_row")
        return told_apart.withColumn("copies", copies).drop("_row")
    return seeds.withColumn("copies", copies)


def _copies(
    seeds: DataFrame, num_syn: int, num_pos: int | None, seed: int, id_col: str, row: str | None = None
) -> Column | None:
    """See ``allocate_copies``. ``row`` numbers the seeds in the order of their ids, if these repeat.

    A histogram of the draws tells in which bucket the last seed with one copy more
    lies; that bucket alone, a 65536th of the rows, is sorted to find it. What is left
    is a comparison with two literals, and no row has to move. None where the last seed
    shares its id with the next one, so that only a ``row`` tells them apart.
    """
    place = row or id_col
    draw = quota_draw(seed, id_col)
    bucket = F.floor(draw / QUOTA_SHIFT).cast("int")
    counts = seeds.groupBy(bucket.alias("b")).count().orderBy("b").collect()
    total = sum(row["count"] for row in counts)
    if num_pos is not None and num_pos != total:
        raise ValueError(f"{total} seeds, not {num_pos}")
    if not total:
        if num_syn:
            raise ValueError("there are no seeds to copy")
        return F.lit(0).cast("bigint")
    base, extra = divmod(num_syn, total)
    copies = F.lit(base).cast("bigint")
    if not extra:
        return copies
    before = 0
    for row in counts:
        if before + row["count"] >= extra:
            break
        before += row["count"]
    last = (
        seeds.where(bucket == row.b)
        .select(draw.alias("d"), F.col(place).alias("i"))
        .orderBy("d", "i")
        .offset(extra - before - 1)
        .limit(2)
        .collect()
    )
    if len(last) > 1 and last[0] == last[1]:
        return None
    more = (draw < last[0].d) | ((draw == last[0].d) & (F.col(place) <= F.lit(last[0].i)))
    return copies + F.when(more, 1).otherwise(0)


def pick_neighbor(lists: DataFrame, seed: int = SEED, nbrs: str = "nbrs", nth: str | None = None) -> DataFrame:
    """Draw, for every (id, copy), one neighbour and the gap to walk towards it.

    ``nbrs`` is the neighbour list of the seed in rank order. A shorter list is
    drawn from as it is, an empty one gives a null neighbour. ``nth`` tells seeds that
    share an id apart; where it is null, the draws are those of an id of its own.
    """
    keys = [F.col(c) for c in ("id", "copy", nth) if c]
    drawn = lists.withColumn("_hex", draws.digest(seed, "copy", *keys))
    n = F.when(F.size(nbrs) > 0, F.size(nbrs))
    return (
        drawn.withColumn("nbr_rank", (draws.draw32(F.col("_hex")) % n + 1).cast("int"))
        .withColumn("gap", draws.draw_unit(F.col("_hex")))
        .withColumn("nbr", F.try_element_at(nbrs, F.coalesce("nbr_rank", F.lit(1))))
        .drop("_hex")
    )


def _copied(counted: DataFrame, num_syn: int) -> DataFrame:
    """One row per copy.

    A small minority may be copied very often. Then its rows are first dealt out
    in runs of ``RUN`` copies, so that no task has to make far more than
    ``ROWS_PER_TASK`` rows.
    """
    one, run = F.lit(1).cast("bigint"), F.lit(RUN).cast("bigint")
    wanted = counted.where(F.col("copies") > 0)
    if num_syn <= ROWS_PER_TASK:
        return wanted.withColumn("copy", F.explode(F.sequence(one, "copies")))
    runs = wanted.withColumn("first", F.explode(F.sequence(one, F.col("copies"), run)))
    dealt = runs.repartition(-(-num_syn // ROWS_PER_TASK), "id", "first")
    last = F.least(F.col("first") + run - 1, F.col("copies"))
    return dealt.withColumn("copy", F.explode(F.sequence("first", last))).drop("first")


def _numbered(seeds: DataFrame) -> DataFrame:
    """Seeds (id, vec) with a ``row`` number in the order of (id, vec), and ``nth``: null for the first of an id."""
    rows = stage(global_rank(seeds, "id", "vec", rank="row"), "numbered")
    firsts = rows.groupBy("id").agg(F.min("row").alias("first"))
    return rows.join(firsts, "id").select("id", "vec", "row", F.nullif(F.col("row") - F.col("first"), F.lit(0)).alias("nth"))


def _as_rows(drawn: DataFrame, f: Features, ranges, label: str, label_value: Column) -> DataFrame:
    """Interpolate, put back into original units, and name the columns."""
    other = F.coalesce("nbr_vec", "vec")
    if f.is_vector:
        features = [unscaled_vector(interpolate("vec", other, "gap"), ranges).alias(f.columns[0])]
    else:
        features = []
        for j, name in enumerate(f.columns):
            s, t = F.col("vec")[j], other[j]
            features.append(unscaled(s + (t - s) * F.col("gap"), ranges.mins[j], ranges.maxs[j]).alias(name))
    return drawn.select(
        F.col("id").alias("seed_id"),
        F.col("copy"),
        F.col("nbr_id"),
        F.col("gap"),
        *features,
        label_value.alias(label),
    )


def smote(
    df: DataFrame,
    label: str,
    minority: Any,
    features: str | Sequence[str],
    id_col: str | None = None,
    k: int = 5,
    over_pct: int = 100,
    seed: int = SEED,
    metric: str = "euclidean",
    blocks: int | None = None,
    num_partitions: int | None = None,
    repeated_ids: bool = False,
) -> DataFrame:
    """The synthetic minority rows that bring the minority to its target.

    Returns (seed_id, copy, nbr_id, gap, features..., label). Features are
    scaled by the ranges of all rows for the neighbour search and returned in
    original units. ``id_col`` must be unique among the minority rows; without
    one, rows are numbered for this call. With ``repeated_ids`` rows may share an id, and
    each is a seed of its own, with copies numbered from 1; an id held once gives the same
    rows as without.

    The search returns ids; neighbours are drawn first, and the vectors of those drawn are
    looked up by one equi-join, which Spark does by broadcast where the minority is small.
    """
    check_percentage(over_pct)
    check_metric(metric)
    if k < 1:
        raise ValueError("k must be at least 1")
    if blocks is not None and blocks < 1:
        raise ValueError("blocks must be at least 1")
    f = Features.of(df, features)
    label_value = F.lit(minority).cast(df.schema[label].dataType)
    if id_col and df.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} must be an integer column")
    seen = summarize(df, f, is_minority(label, minority))
    numbers = df.sparkSession.sql(f"select {seen.num_all}L as num_all, {seen.num_pos}L as num_pos")
    plan = check_plan(budget(numbers, over_pct, k).first())
    if seen.num_bad:
        raise ValueError("features must not be null, NaN or infinite, and vectors must be of one length")
    ranges = seen.ranges

    key = F.col(id_col).cast("bigint").alias("id") if id_col else None
    rows = df.where(is_minority(label, minority)).select(
        *([key] if id_col else []), scaled_vector(f, ranges).alias("vec")
    )
    if num_partitions:
        rows = rows.repartition(num_partitions, *(["id"] if id_col else []))
    if id_col:
        seeds = stage(rows, "seeds")
        held = seeds.groupBy("id").count().where("count > 1 or id is null")
        if repeated_ids:
            numbers = held.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id").isNull()).alias("n_null")).first()
            if numbers.n_null:
                raise ValueError(f"{id_col} must not be null among the minority rows")
            repeated_ids = numbers.n > 0
        elif not held.isEmpty():
            raise ValueError(f"{id_col} must be unique and not null among the minority rows")
    else:
        repeated_ids = False
        seeds = with_row_id(rows)
    if plan.num_syn == 0:
        none = seeds.limit(0).selectExpr("id", "vec", "1L as copy", "0D as gap", "id as nbr_id", "vec as nbr_vec")
        return _as_rows(none, f, ranges, label, label_value)
    if repeated_ids:
        found = _by_row(stage(_numbered(seeds), "seeds"), plan, k, metric, blocks, seed)
        return _as_rows(found, f, ranges, label, label_value)
    lists = neighbor_lists(seeds, None, k, metric, blocks=blocks, written=True)
    counted = lists.withColumn("copies", _copies(seeds, plan.num_syn, plan.num_pos, seed, "id"))
    drawn = pick_neighbor(_copied(counted, plan.num_syn), seed).select("id", "vec", "copy", "gap", "nbr.nbr_id")
    vectors = seeds.select(F.col("id").alias("of"), F.col("vec").alias("nbr_vec"))
    found = drawn.join(vectors, F.col("nbr_id") == F.col("of"), "left")
    return _as_rows(found, f, ranges, label, label_value)


def _by_row(seeds: DataFrame, plan, k: int, metric: str, blocks: int | None, seed: int) -> DataFrame:
    """The drawn copies of ``_numbered`` seeds with the neighbours' ids and vectors; seeds are searched by row."""
    by_row = seeds.select(F.col("row").alias("id"), "vec")
    lists = neighbor_lists(by_row, None, k, metric, blocks=blocks, written=True)
    named = lists.select(F.col("id").alias("row"), "nbrs").join(seeds, "row")
    counted = named.withColumn("copies", _copies(seeds, plan.num_syn, plan.num_pos, seed, "id", "row"))
    drawn = pick_neighbor(_copied(counted, plan.num_syn), seed, nth="nth")
    drawn = drawn.select("id", "vec", "copy", "gap", F.col("nbr.nbr_id").alias("nbr_row"))
    of = seeds.select(F.col("row").alias("of"), F.col("id").alias("nbr_id"), F.col("vec").alias("nbr_vec"))
    return drawn.join(of, F.col("nbr_row") == F.col("of"), "left")
