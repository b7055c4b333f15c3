"""spark-submit job: balance a KEEL data set and write it as text.

    spark-submit balance_job.py --header h.txt --input d.csv --output out
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, Observation, SparkSession

from rebalance.operators.encode import decode_label, encode_labeled, explode_features
from rebalance.operators.profile import class_counts, report
from rebalance.operators.synth import SEED
from rebalance.plans.balance import balance
from rebalance.sources.keel import read_keel, read_keel_header, write_balanced
from rebalance.staging import staging_run


def run(
    spark: SparkSession,
    header: str,
    path: str,
    output: str,
    minority: str = "positive",
    k: int = 5,
    over_pct: int = 100,
    seed: int = SEED,
    delimiter: str = ", ",
    input_delimiter: str = ",",
    blocks: int | None = None,
    num_partitions: int | None = None,
    format: str = "text",
    on_error: str = "fail",
) -> DataFrame:
    """Write the balanced data set to ``output``; returns the final class counts.

    With the counts come ``num_lines`` and ``num_rejected``: the data lines of the
    input, and those left out. A class that the header does not declare stops the job, or
    is rejected. What the job stages is its own and deleted at the end; results made
    elsewhere in the session stay readable.
    """
    schema = read_keel_header(spark, header)
    if minority not in schema.classes:
        raise ValueError(f"{minority!r} is not one of the classes {schema.classes}")
    with staging_run(spark):
        read, written = Observation(), Observation()
        table = read_keel(spark, schema, path, input_delimiter, on_error, read)
        encoded = encode_labeled(table, schema.features, schema.label, schema.dictionary, on_error=on_error)
        # a class may be given by its code
        named = decode_label(encoded.drop("label"), "label_code", schema.dictionary, schema.label, schema.label)
        rows = explode_features(named.drop("label_code"), schema.features)
        out = balance(
            rows, schema.label, minority, schema.features,
            k=k, over_pct=over_pct, seed=seed, blocks=blocks, num_partitions=num_partitions,
        )
        # counted while they are written
        out = out.observe(written, *class_counts(schema.label, minority))
        write_balanced(out, output, format, [*schema.features, schema.label], delimiter)
        lines, counts = read.get, written.get
    numbers = spark.sql(f"select {counts['num_all']}L as num_all, {counts['num_pos']}L as num_pos")
    return report(numbers).selectExpr(
        "*", f"{lines['num_lines']}L as num_lines", f"{lines['num_rejected']}L as num_rejected"
    )


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--header", required=True)
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--minority", default="positive")
    p.add_argument("--k", type=int, default=5)
    p.add_argument("--over-pct", type=int, default=100)
    p.add_argument("--seed", type=int, default=SEED)
    p.add_argument("--delimiter", default=", ", help="of the output")
    p.add_argument("--input-delimiter", default=",")
    p.add_argument("--blocks", type=int)
    p.add_argument("--num-partitions", type=int)
    p.add_argument("--format", default="text")
    p.add_argument("--on-error", choices=("fail", "reject"), default="fail")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("rebalance").getOrCreate()
    run(
        spark, a.header, a.input, a.output, a.minority, a.k, a.over_pct, a.seed, a.delimiter,
        a.input_delimiter, a.blocks, a.num_partitions, a.format, a.on_error,
    ).show()

