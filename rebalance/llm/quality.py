"""Quality rules: surface counts of a text and a hashed n-gram likelihood ratio.

Two multinomials over hashed words and word pairs are counted, one over trusted
rows and one over the whole corpus. A document's verdict is the mean, over its
features, of ``log(p_trusted / p_corpus)`` against a fixed threshold. The hash
space is fixed, so each model is one array of ``2**bits`` numbers whatever the
corpus; both come from one grouped count with map-side sums, and reach the
scoring projection as a scalar subquery. Nothing is sampled and no row moves
for the scoring: it is one projection over the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rebalance.llm.common import words_of

BITS = 15
TRUSTED_ROWS = 20_000  # at most so many trusted ids train the target model
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30  # percent of the words
MIN_LLR = -0.12  # nats per feature; a hundredth of the rows labelled good is below -0.10 (sf0.1, ids not trained on)
SYMBOLS = "[#*$%&|<>]+"
WORDY = "[^\\x20\\x09-\\x0D]"


def _at(array: Column, index: Column) -> Column:
    return F.get(array, index)


def features(words: Column, bits: int = BITS) -> Column:
    """Hash bucket of every pair of neighbouring words; the last word stands alone."""
    mask = (1 << bits) - 1
    return F.transform(words, lambda w, i: F.xxhash64(w, _at(words, i + 1)).bitwiseAND(F.lit(mask)).cast("int"))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words inside a window of words that the text has more than once.

    Windows are compared by 64-bit hashes. Only texts with an equal pair of
    windows are sorted; there, each covered word counts once.
    """
    n = F.size(words) - (window - 1)
    windows = _let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(h, i, window))),
    )

    def covered(of: Column) -> Column:
        ranked = F.sort_array(F.transform(of, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(r: Column) -> Column:
            def equal(x: Column, k: Column) -> Column:
                return F.coalesce(_at(r, k)["h"] == x["h"], F.lit(False))

            flagged = F.transform(r, lambda x, k: F.when(equal(x, k - 1) | equal(x, k + 1), x["i"]))
            return F.sort_array(F.filter(flagged, lambda i: i.isNotNull()))

        starts = _let(ranked, places)
        return _let(
            starts,
            lambda s: F.aggregate(
                F.transform(s, lambda p, k: F.least(F.coalesce(_at(s, k + 1) - p, F.lit(window)), F.lit(window))),
                F.lit(0),
                lambda a, x: a + x,
            ),
        )

    counted = _let(windows, lambda ws: F.when(F.size(F.array_distinct(ws)) < F.size(ws), covered(ws)).otherwise(0))
    return F.when(n > 1, counted).otherwise(0).cast("long")


def _let(value: Column, body) -> Column:
    """Bind an expression once: a lambda over an array of one element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def duplicate_lines(text: Column) -> Column:
    """Lines that have a word and equal an earlier line of the text."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORDY))
    return _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def trusted_ids(labels: DataFrame, most: int = TRUSTED_ROWS) -> DataFrame:
    """Ids of rows labelled good and not toxic, at most ``most`` of them, chosen by hash."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    ids = good.select("doc_id").distinct()
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def llr_weights(docs: DataFrame, trusted: DataFrame, bits: int = BITS) -> Column:
    """Scalar subquery: an array with ``log(p_trusted / p_corpus)`` of every bucket.

    ``trusted`` holds distinct ids and has a proven bound, so it is broadcast.
    Counts are smoothed by one; without trusted rows all weights are 0.
    """
    size = 1 << bits
    marked = docs.select("doc_id", words_of("text").alias("words")).join(
        F.broadcast(trusted.select("doc_id", F.lit(1).alias("good"))), "doc_id", "left"
    )
    pairs = marked.select("good", F.explode(features(F.col("words"), bits)).alias("bucket"))
    seen = pairs.groupBy("bucket").agg(F.count("good").alias("t"), F.count(F.lit(1)).alias("n"))
    every = docs.sparkSession.range(size).select(F.col("id").cast("int").alias("bucket"), F.lit(0).alias("t"), F.lit(0).alias("n"))
    sums = seen.unionByName(every).groupBy("bucket").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    model = sums.agg(
        F.sort_array(F.collect_list(F.struct("bucket", "t", "n"))).alias("m"), F.sum("t").alias("t"), F.sum("n").alias("n")
    )
    ratio = F.transform(
        "m",
        lambda x: F.when(F.col("t") == 0, 0.0).otherwise(
            F.ln((x["t"] + 1) / (F.col("t") + size)) - F.ln((x["n"] + 1) / (F.col("n") + size))
        ),
    )
    return model.select(ratio.alias("weights")).scalar()


def judge(
    docs: DataFrame,
    trusted: DataFrame,
    *,
    bits: int = BITS,
    min_llr: float = MIN_LLR,
    min_words: int = MIN_WORDS,
    max_repeated: int = MAX_REPEATED,
) -> DataFrame:
    """``docs`` plus counts and verdict of every row.

    Added: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (longs),
    base_failed, llr (double, null without words), kept. A null text has no
    words: counts are 0 and it fails. Columns of ``docs`` with these names are
    replaced. Every row is judged by itself, so repeated rows get equal results.
    """
    named = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")
    weights = llr_weights(docs, trusted, bits)
    words, inked = F.col("__words"), F.col("__inked")
    split = docs.drop(*named).withColumn("__words", words_of("text"))
    split = split.withColumn("__inked", F.array_join(words, "")).withColumn("__weights", weights)
    total = F.aggregate(features(words, bits), F.lit(0.0), lambda a, b: a + F.get(F.col("__weights"), b))
    counts = F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(inked).cast("long").alias("word_chars"),
        (F.length(inked) - F.length(F.regexp_replace(inked, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.coalesce(duplicate_lines(F.col("text")), F.lit(0)).alias("n_dup_lines"),
        repeated_words(words).alias("n_repeat_words"),
        F.when(F.size(words) > 0, total / F.size(words)).alias("llr"),
    )
    # a generated row: a filter on the verdict stays above it, and words are split once
    kept = [F.col(f"`{c}`") for c in split.columns if not c.startswith("__")]
    counted = split.select(*kept, F.explode(F.array(counts)).alias("__c")).select(*kept, "__c.*")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("llr") >= min_llr))
