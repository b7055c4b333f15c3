import gzip
import glob

import pytest

from rebalance.operators import encode
from rebalance.plans.job import run
from rebalance.sources import keel

HEADER = """@relation shells
@attribute sex {M, F, I}
@attribute length [0.075, 0.815]
@attribute rings [1, 29]
@attribute class {positive, negative}
@inputs sex, length, rings
@outputs class
"""
LINES = """@data
M, 0.455, 15, negative
F,0.35,7,positive

M,0.4,9
M,0.4,9,positive,x
M,0.4,9,
M,0.4,9,positive,
M,?,9,positive
"""


@pytest.fixture()
def files(tmp_path):
    (tmp_path / "h.txt").write_text(HEADER)
    (tmp_path / "d.csv").write_text(LINES)
    return str(tmp_path / "h.txt"), str(tmp_path / "d.csv")


def test_header(spark, files):
    schema = keel.read_keel_header(spark, files[0])
    assert schema.columns == ["sex", "length", "rings", "class"]
    assert schema.dictionary["sex"] == {"M": 0.0, "F": 1.0, "I": 2.0}
    assert schema.dictionary["class"] == {"positive": 0.0, "negative": 1.0}
    assert schema.ranges == {"length": (0.075, 0.815), "rings": (1.0, 29.0)}
    assert (schema.num_classes, schema.numeric_columns) == (2, ["length", "rings"])
    assert schema.dictionary_frame(spark).count() == 5
    kinds = {f.name: f.metadata["kind"] for f in schema.struct_type()}
    assert kinds == {"sex": "categorical", "length": "numeric", "rings": "numeric", "class": "class"}


def test_labels_keep_inner_blanks():
    schema = keel.parse_header("@attribute a { New York ,Rome}\n@attribute Class{yes, no}\n@input a\n")
    assert schema.dictionary == {"a": {"New York": 0.0, "Rome": 1.0}, "Class": {"yes": 0.0, "no": 1.0}}


def test_bad_headers():
    for text in ("@attribute class {a, b}\n", "@attribute x [0,1]\n@inputs x\n", HEADER.replace("sex, length", "sex")):
        with pytest.raises(ValueError):
            keel.parse_header(text)


def test_reject_mode(spark, files):
    schema = keel.read_keel_header(spark, files[0])
    table = keel.read_keel(spark, schema, files[1], on_error="reject")
    assert [tuple(r) for r in table.collect()] == [
        ("M", 0.455, 15.0, "negative"),
        ("F", 0.35, 7.0, "positive"),
        ("M", 0.4, 9.0, "positive"),
    ]
    assert encode.numeric_columns(table) == ["length", "rings"]
    out = encode.encode_labeled(table, schema.features, schema.label, schema.dictionary).collect()
    assert [(r.features, r.label, r.label_code) for r in out][:2] == [
        ([0.0, 0.455, 15.0], "negative", 1.0),
        ([1.0, 0.35, 7.0], "positive", 0.0),
    ]
    bad = {(r.value, r.reason) for r in keel.read_keel_rejects(spark, schema, files[1]).collect()}
    assert bad == {
        ("", "fields"),
        ("M,0.4,9", "fields"),
        ("M,0.4,9,positive,x", "fields"),
        ("M,0.4,9,", "fields"),
        ("M,?,9,positive", "value"),
    }


def test_fail_mode(spark, files):
    schema = keel.read_keel_header(spark, files[0])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        keel.read_keel(spark, schema, files[1]).collect()
    with pytest.raises(ValueError):
        keel.read_keel(spark, schema, files[1], on_error="skip")


def test_labelled_point_example(spark):
    """A coded first feature and seven numbers."""
    schema = keel.parse_header(
        "@attribute sex {M, F, I}\n" + "".join(f"@attribute f{j} [0, 2]\n" for j in range(7))
        + "@attribute class {positive, negative}\n@inputs " + ", ".join(["sex"] + [f"f{j}" for j in range(7)]) + "\n"
    )
    line = spark.createDataFrame([("M, 0.56, 0.45, 0.185, 1.07, 0.3805, 0.175, 0.41, positive",)], "value string")
    table = keel._parsed(keel.well_formed(line, 9), schema, ",", "fail")
    row = encode.encode_labeled(table, schema.features, schema.label, schema.dictionary).first()
    assert (row.label_code, row.features) == (0.0, [0.0, 0.56, 0.45, 0.185, 1.07, 0.3805, 0.175, 0.41])


def test_tabs_around_fields(spark):
    schema = keel.parse_header(HEADER)
    line = spark.createDataFrame([("\tF\t,\t0.35 , 7,\tpositive ",), ("\t@data,a,b,c",)], "value string")
    table = keel._parsed(keel.well_formed(line, 4), schema, ",", "fail").drop("value")
    assert [tuple(r) for r in table.collect()] == [("F", 0.35, 7.0, "positive")]


def test_unknown_label_is_read_as_a_number(spark):
    df = spark.createDataFrame([("a", "1"), ("7.5", "2")], "c string, l string")
    out = encode.encode_labeled(df, ["c"], "l", {"c": {"a": 3.0}}).collect()
    assert [(r.features, r.label_code) for r in out] == [([3.0], 1.0), ([7.5], 2.0)]
    found = encode.category_dictionary(df.where("c = 'a'"), ["c"])
    out = encode.encode_labeled(df, ["c"], "l", found, categorical=["c"]).collect()
    assert sorted(r.features[0] for r in out) == [0.0, 7.5]


def test_rows_as_text(spark):
    df = spark.createDataFrame([("b ", "1.50", "x y")], "c string, n string, l string")
    coded = encode.encode_rows(df, ["c", "n"], {"c": {"a": 0.0, "b": 1.0}}, label="l", label_as="text", as_text=True)
    assert coded.first().value == "1.0,1.5,x y"
    kept = encode.encode_rows(df, ["c", "n"], {"c": {"b": 1.0}}, as_text=True, keep_numeric_text=True)
    assert kept.first().value == "1.0,1.50"
    vec = spark.sql("select array(1.5D, 2D) as features, 'p' as label")
    assert keel.format_rows(vec, delimiter=";").first().value == "1.5;2.0;p"


def test_decode_declared(spark):
    df = spark.sql("select 0D as code union all select 1D union all select 9D")
    got = {r.code: r.label for r in encode.decode_label(df, "code", {"c": {"no": 0.0, "yes": 1.0}}, "c").collect()}
    assert got == {0.0: "no", 1.0: "yes", 9.0: None}


@pytest.mark.parametrize("format", ["text", "parquet", "csv", "json", "orc"])
def test_write_replaces(spark, tmp_path, format):
    df, path = spark.range(3), str(tmp_path / "out")
    keel.write_balanced(spark.range(9), path, format)
    keel.write_balanced(df, path, format)
    assert spark.read.format(format).load(path).count() == 3


def test_job(spark, tmp_path):
    (tmp_path / "h.txt").write_text(HEADER)
    rows = [f"{'MFI'[i % 3]},{0.1 + i / 100},{i % 13},{'positive' if i < 12 else 'negative'}" for i in range(60)]
    (tmp_path / "d.csv").write_text("\n".join(["@data", *rows, "broken,1"]))
    out = str(tmp_path / "out")
    report = run(spark, str(tmp_path / "h.txt"), str(tmp_path / "d.csv"), out, k=3, delimiter=";").first()
    assert (report.num_pos, report.num_neg, report.pos_pct) == (48, 48, 100)
    text = [line for p in glob.glob(out + "/*.gz") for line in gzip.open(p, "rt").read().splitlines()]
    assert len(text) == 96
    assert all(len(line.split(";")) == 4 for line in text)
    assert sum(line.endswith(";positive") for line in text) == 48
    assert "0.0;0.1;0.0;positive" in text
    with pytest.raises(ValueError):
        run(spark, str(tmp_path / "h.txt"), str(tmp_path / "d.csv"), out, minority="other")
