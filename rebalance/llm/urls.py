"""URL filter rules: host suffixes and path prefixes met by short hashes.

A rule names a host (which covers its subdomains) and the beginning of a path.
Rules come in few shapes (labels of the host, characters of the path); a URL is
expanded into one expression for every shape it is long enough for. Expressions
meet the rules on a short hash prefix in an equi-join, then on the full digest.
The longest rule wins; of equally long ones that with the longer host, then the
blocking one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rebalance.llm.common import ascii_lower

PREFIX = 8  # hexadecimal digits of the short hash


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def _digest(host: Column, path: Column) -> Column:
    """Digest of an expression; the blank, which no host has in a rule, parts its halves."""
    return F.sha2(F.concat(host, F.lit(" "), path), 256)


def prepare(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with shape, digest, short hash and precedence; repeats dropped."""
    host, path = ascii_lower(F.col("host")), F.coalesce("path", F.lit(""))
    named = rules.where("host is not null and verdict is not null").select(
        host.alias("rule_host"), path.alias("rule_path"), F.col("verdict").alias("rule_verdict")
    ).distinct()
    digest = _digest(F.col("rule_host"), F.col("rule_path"))
    return named.select(
        F.concat("rule_host", "rule_path").alias("rule"),
        "rule_verdict",
        _labels(F.col("rule_host")).alias("labels"),
        F.length("rule_path").alias("path_chars"),
        digest.alias("rule_digest"),
        F.substring(digest, 1, PREFIX).alias("short"),
        F.struct(
            F.length(F.concat("rule_host", "rule_path")).alias("size"),
            F.length("rule_host").alias("host"),
            (F.col("rule_verdict") == "block").cast("int").alias("block"),
            F.concat("rule_host", "rule_path").alias("rule"),
            F.col("rule_verdict").alias("verdict"),
        ).alias("rank"),
    )


def judge(pages: DataFrame, rules: DataFrame, *, default: str = "allow") -> DataFrame:
    """Every row of ``pages(page_id, url)`` with host, path, rule (or null) and verdict.

    ``rules(host, path, verdict)``: verdict ``allow`` or ``block``; ``default``
    stands where no rule fits. Rules without host or verdict are left out. Other
    columns of ``pages`` are ignored; repeated rows are all judged, and pages meet their
    verdict by host and path, so neither ids nor row numbers matter. The distinct
    shapes of the rules are gathered first (a few numbers each); Spark broadcasts
    the rules only when their size allows it.
    """
    host, path = host_and_path(F.col("url"))
    ready = prepare(rules)
    shapes = [(r.labels, r.path_chars) for r in ready.select("labels", "path_chars").distinct().collect()]
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    # every address once, however many pages have it
    distinct = urls.where("host <> ''").select("host", "path").distinct()
    judged = distinct.select("*", F.array(*[F.struct(F.lit(a).alias("l"), F.lit(b).alias("c")) for a, b in sorted(shapes)]).alias("shapes")) \
        if shapes else distinct.withColumn("shapes", F.array().cast("array<struct<l:int,c:int>>"))
    fitting = F.filter("shapes", lambda s: (_labels(F.col("host")) >= s["l"]) & (F.length("path") >= s["c"]))
    suffix = F.expr("substring_index(host, '.', -shape.l)")
    asked = judged.select("host", "path", F.explode(fitting).alias("shape")).select(
        F.col("host").alias("of_host"), F.col("path").alias("of_path"), _digest(suffix, F.expr("left(path, shape.c)")).alias("digest")
    ).withColumn("short", F.substring("digest", 1, PREFIX))
    met = asked.join(ready, "short").where(F.col("digest") == F.col("rule_digest"))
    best = met.groupBy("of_host", "of_path").agg(F.max("rank").alias("best"))
    same = (F.col("host") == F.col("of_host")) & (F.col("path") == F.col("of_path"))
    return urls.join(best, same, "left").select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
