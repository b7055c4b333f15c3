"""Personal data in texts: strict patterns, and credentials found by weak supervision.

Base kinds (email, ip, card, phone) are leftmost matches of a pattern that pass a
check; they always stay. Further candidates are long mixed tokens. Four labelers
vote on every candidate (for, against, or not at all): its pattern, a gazetteer of
prefixes, the words before it, and its make-up. Expectation-maximisation over the
counts of vote patterns (at most 3**4 rows) estimates how reliable each labeler
is, starting from, and held by some pseudo-counts near, labelers that are more often
right than wrong; its posteriors then train a naive Bayes span classifier over hashed
features, counted over all documents, which decides about the candidates.

Everything on rows is DataFrame functions. Texts are read once, and the spans
found are staged; later passes read only those.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rebalance.llm.common import text_of
from rebalance.staging import stage

KINDS = ("email", "ip", "card", "phone")
# Possessive forms match as the plain ones do and never go back. A run of the
# first class is entered at its start or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{16,}+",
}
#: A text without this string has no match.
NEEDS = {"email": "@", "phone": "+"}
#: Four parts of at most 255; zeros in front do not count, and a part may be all zeros.
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"
GAZETTEER = r"^(?:AKIA|ASIA|gh[oprsu]_|github_pat_|glpat-|sk-|[rs]k_live_|xox[abprs]-|AIza|ya29|eyJ|npm_|hf_)"
CONTEXT = (
    r"(?i)(?:passw(?:or)?d|passphrase|pwd|token|secret|api[_ -]?key|access[_ -]?key|key|auth|bearer|credential)s?"
    r"\s{0,2}(?:[=:]|\bis\b)?\s{0,2}[\"'`]?$"
)
ADDRESS = r"(?i)(?:https?://\S*|www\.\S*|/)$"
BEFORE = 24  # characters before a span that the context labeler sees
PART = 64  # spans whose places are added up together
FEATURES = 1024
PER_SPAN = 6.0  # features of a span
SMOOTH = 0.1  # added to the sums of every feature
LABELERS = 4
ROUNDS = 30
PSEUDO = 10.0  # spans that speak for the expected reliability of a labeler


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def luhn(digits: Column) -> Column:
    total = F.aggregate(
        F.transform(
            F.split(F.reverse(digits), ""),
            lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
                c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)
            ),
        ),
        F.lit(0),
        lambda a, b: a + b,
    )
    return total % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """Whether a match of the kind's pattern counts."""
    if kind == "ip":
        return value.rlike(OCTETS)
    if kind in ("card", "phone"):
        digits = F.regexp_replace(value, "[^0-9]", "")
        low, high = (16, 19) if kind == "card" else (8, 15)
        fits = F.length(digits).between(low, high)
        return F.when(fits, luhn(digits)).otherwise(False) if kind == "card" else fits
    return F.lit(True)


def _cut(items: Column) -> Column:
    """An array as an array of parts of ``PART`` items; adding to an array copies it."""
    parts = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / PART).cast("int"))
    return F.transform(parts, lambda i: F.slice(items, i * PART + 1, F.lit(PART)))


def _before(parts: Column, total, join, first: Column) -> Column:
    """For every part what ``join`` makes of the totals of the parts before it."""
    begin = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))

    def step(state: Column, part: Column) -> Column:
        return F.struct(join(state["at"], total(part)).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out"))

    return F.aggregate(parts, begin, step, lambda s: s["out"])


def matches(text: Column, kind: str) -> Column:
    """Array of (kind, start, end, value, before) of all valid matches, in code points.

    The parts between matches and the matches themselves give the places. ``before`` is
    what stands between a match and the one before it, ``BEFORE`` characters at most.
    """
    pattern = PATTERNS[kind]
    shape = "array<struct<start:int,end:int,value:string,before:string>>"

    def places(part: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.array().cast(shape).alias("out"))

        def step(state: Column, x: Column) -> Column:
            start = state["at"] + F.length(x["gap"])
            end = start + F.coalesce(F.length(x["value"]), F.lit(0))
            before = F.right(x["gap"], F.lit(BEFORE)).alias("before")
            span = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), before)
            out = F.when(x["value"].isNotNull() & valid(kind, x["value"]), F.concat(state["out"], F.array(span)))
            return F.struct(end.alias("at"), out.otherwise(state["out"]).alias("out"))

        return F.aggregate(part, begin, step)

    def moved(part: Column, by: Column) -> Column:
        return F.transform(
            part["out"],
            lambda s: F.struct(
                F.lit(kind).alias("kind"),
                (s["start"] + by).alias("start"),
                (s["end"] + by).alias("end"),
                s["value"].alias("value"),
                s["before"].alias("before"),
            ),
        )

    def placed(hits: Column) -> Column:
        both = F.zip_with(F.split(text, pattern), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("value")))
        parts = _let(both, lambda x: F.transform(_cut(x), places))
        shifts = lambda x: _before(x, lambda part: part["at"], lambda a, b: a + b, F.lit(0))
        return _let(parts, lambda x: F.flatten(F.zip_with(x, shifts(x), moved)))

    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string,before:string>>")
    found = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda h: F.when(F.size(h) > 0, placed(h)).otherwise(none))
    if kind in NEEDS:
        return F.when(F.instr(text, NEEDS[kind]) > 0, found).otherwise(none)
    return F.when(text.rlike("[0-9]"), found).otherwise(none)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 2).when(no, 1).otherwise(0)


def votes(span: Column) -> Column:
    """The labelers' votes as one number in base 3: 2 for, 1 against, 0 none."""
    value, before = span["value"], span["before"]
    # digests and key ids, or words put together
    pattern = _vote(
        value.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|[A-Z0-9]{20})$"),
        value.rlike("^[A-Za-z]+(?:[-_/][A-Za-z]+)+[-_/]?[0-9]*$"),
    )
    gazetteer = _vote(value.rlike(GAZETTEER), F.lit(False))
    context = _vote(before.rlike(CONTEXT), before.rlike(ADDRESS))
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    make = _vote(digits * 5 >= F.length(value), digits * 10 < F.length(value))
    return pattern + 3 * gazetteer + 9 * context + 27 * make


def span_features(span: Column) -> Column:
    """Hashed features of the final classifier: make-up, length, start, the word before, and the votes."""
    value, before = span["value"], span["before"]
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0")
    named = {
        "shape": F.substring(shape, 1, 12),
        "size": F.length(value).cast("string"),
        "start": F.substring(value, 1, 4),
        "mark": F.substring(before, -2, 2),
        "word": F.regexp_extract(F.lower(before), r"(\w+)\W*$", 1),
        "votes": votes(span).cast("string"),
    }
    return F.array(
        *[F.pmod(F.xxhash64(F.lit(n), span["kind"], v), F.lit(FEATURES)).cast("int") for n, v in named.items()]
    )


def reliabilities(counts: dict[int, int], rounds: int = ROUNDS) -> list[float]:
    """Chance that a span is personal, for every vote pattern, by expectation-maximisation.

    Each labeler has, for either truth, a distribution over its three votes.
    ``counts`` has at most 3 ** LABELERS entries.
    """
    patterns = [[p // 3**k % 3 for k in range(LABELERS)] for p in range(3**LABELERS)]
    # votes (none, against, for) of either truth; no vote says nothing at first
    expected = [[0.4, 0.5, 0.1], [0.4, 0.1, 0.5]]
    theta = [[list(votes) for votes in expected] for _ in range(LABELERS)]
    prior = 0.5
    chance = [0.5] * len(patterns)
    for _ in range(rounds):
        for p, pattern in enumerate(patterns):
            odds = math.log(prior / (1 - prior))
            odds += sum(math.log(theta[k][1][v] / theta[k][0][v]) for k, v in enumerate(pattern))
            chance[p] = 1 / (1 + math.exp(-max(min(odds, 500), -500)))
        total = sum(counts.values())
        prior = (sum(n * chance[p] for p, n in counts.items()) + 1) / (total + 2)
        for k in range(LABELERS):
            for truth in (0, 1):
                sums = [PSEUDO * e for e in expected[truth]]
                for p, n in counts.items():
                    sums[patterns[p][k]] += n * (chance[p] if truth else 1 - chance[p])
                theta[k][truth] = [s / sum(sums) for s in sums]
    return chance


def find(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """``docs`` (without text, if so wanted) plus base and spans.

    ``base`` holds the spans of KINDS as (kind, start, end), by kind as listed, then
    start; ``spans`` has those plus the accepted candidates (kind ``secret``) after
    them. A null text counts as empty. Columns of ``docs`` with these two names are
    replaced; repeated rows give equal results.
    """
    text = F.col("__text")
    every = [matches(text, k) for k in KINDS]
    names = [c for c in docs.columns if c not in ("base", "spans") and (keep_text or c != "text")]
    own = [F.col(f"`{c}`") for c in names]
    found = docs.withColumn("__text", text_of("text"))
    found = found.select(*own, F.concat(*every).alias("__b"), matches(text, "secret").alias("__s"))

    def rated(spans: Column) -> Column:
        return F.transform(
            spans,
            lambda x: F.struct(
                x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
                votes(x).alias("votes"), span_features(x).alias("features"),
            ),
        )

    def bare(spans: Column) -> Column:
        return F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    found = stage(found.select(*own, bare(F.col("__b")).alias("base"), rated(F.col("__s")).alias("__s")), "spans")
    spans = found.select(F.explode("__s").alias("x"))
    counts = {r.votes: r.n for r in spans.groupBy("x.votes").agg(F.count("*").alias("n")).collect()}
    chance = F.array(*[F.lit(float(c)) for c in reliabilities(counts)])
    sums = (
        spans.select(F.explode("x.features").alias("f"), F.get(chance, F.col("x.votes")).alias("p"))
        .groupBy("f")
        .agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    )
    every_feature = docs.sparkSession.range(FEATURES).select(
        F.col("id").cast("int").alias("f"), F.lit(0.0).alias("yes"), F.lit(0.0).alias("no")
    )
    sums = sums.unionByName(every_feature).groupBy("f").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    model = sums.agg(
        F.sort_array(F.collect_list(F.struct("f", "yes", "no"))).alias("m"), F.sum("yes").alias("y"), F.sum("no").alias("n")
    )
    weights = F.transform(
        "m",
        lambda x: F.ln((x["yes"] + SMOOTH) / (F.col("y") + SMOOTH * FEATURES))
        - F.ln((x["no"] + SMOOTH) / (F.col("n") + SMOOTH * FEATURES)),
    )
    # one span of either kind, to begin with
    model = model.select(weights.alias("w"), F.ln((F.col("y") + PER_SPAN) / (F.col("n") + PER_SPAN)).alias("prior"))
    scored = found.withColumn("__m", model.select(F.struct("w", "prior")).scalar())

    def accepted(x: Column) -> Column:
        score = F.aggregate(x["features"], F.col("__m.prior"), lambda a, f: a + F.get(F.col("__m.w"), f))
        return score > 0

    return scored.select(*own, "base", F.concat("base", bare(F.filter("__s", accepted))).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; overlapping spans become one."""
    ordered = F.sort_array(F.transform(spans, lambda x: F.struct(x["start"].alias("a"), x["end"].alias("b"), x["kind"].alias("k"))))

    def last(part: Column) -> Column:
        return F.array_max(F.transform(part, lambda x: x["b"]))

    def written(part: Column, at: Column) -> Column:
        """The text from ``at`` to the end of the part's last span, which is cut out once."""

        def run(own: Column) -> Column:
            begin = F.struct(at.alias("at"), F.array().cast("array<string>").alias("out"))

            def step(state: Column, x: Column) -> Column:
                gap = F.substring(own, state["at"] - at + 1, F.greatest(x["a"] - state["at"], F.lit(0)))
                fresh = F.concat(state["out"], F.array(gap, F.concat(F.lit("["), x["k"], F.lit("]"))))
                return F.struct(
                    F.greatest(state["at"], x["b"]).alias("at"),
                    F.when(x["a"] >= state["at"], fresh).otherwise(state["out"]).alias("out"),
                )

            return F.aggregate(part, begin, step, lambda s: F.array_join(s["out"], ""))

        return _let(F.substring(text, at + 1, F.greatest(last(part) - at, F.lit(0))), run)

    def whole(parts: Column) -> Column:
        starts = _before(parts, last, lambda a, b: F.greatest(a, b), F.lit(0))
        end = F.array_max(F.transform(parts, last))
        return F.concat(F.array_join(F.zip_with(parts, starts, written), ""), F.substring(text, end + 1, F.length(text)))

    return F.when(F.size(spans) > 0, _let(_let(ordered, _cut), whole)).otherwise(text)
