"""Scans, header repair, sinks and document jobs on small files."""

import pytest
from pyspark.sql import functions as F

from kinfold.operators import documents as docs
from kinfold.sources import documents as docsrc
from kinfold.sources import sinks
from kinfold.sources import tables as tab


@pytest.mark.parametrize("encoding,name", [("utf-8", "UTF-8"), ("cp1252", "windows-1252"), ("latin-1", "ISO-8859-1")])
def test_banner_csv(spark, tmp_path, encoding, name):
    cell = {"utf-8": "μg – é", "cp1252": "µ – “é”", "latin-1": "é\x81"}[encoding]
    f = tmp_path / "a.csv"
    f.write_bytes(f'Sample,,Outcome\nKey,Note,Note\n1,"{cell}",x\n2,"a, b",\n'.encode(encoding))
    assert tab.detect_encoding(spark, str(f)) == name
    got = tab.read_banner_csv(spark, str(f)).orderBy("Key").collect()
    assert [tuple(r) for r in got] == [("1", cell, "x"), ("2", "a, b", None)]
    assert got[0].__fields__ == ["Key", "Note", "Note_2"]


def test_headers(spark):
    assert tab.flatten_two_level(["A", "B", None], ["x", "Unnamed: 1", None]) == ["x", "B", "Unnamed_2"]
    df = spark.createDataFrame([("1", None, "z")], "` a ` string, b string, `Unnamed: 2` string")
    assert tab.normalise_header(df).columns == ["a"]
    with pytest.raises(KeyError):
        tab.resolve_columns(["Pressure"], {"doi": "DOI"})
    assert tab.resolve_columns(["DOI link"], {"doi": "DOI"}) == {"doi": "DOI link"}


def test_extraction_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"s1": {"rows": [{"fsr": 1.5, "doi": null}, {"fsr": "x"}]}, "s2": {"conditions": [{"notes": "n"}], "rows": []}, "s3": {"rows": []}}')
    got = docsrc.read_extractions(spark, str(tmp_path)).orderBy("source_chunks", "row_pos").collect()
    assert [(r["source_chunks"], r["fsr"], r["notes"]) for r in got] == [("s1", "1.5", None), ("s1", "x", None), ("s2", None, "n")]


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([(1, "x")], "b int, a string")
    c = spark.createDataFrame([(2.5,)], "c double")
    sinks.write_union_csv([a, c], str(tmp_path / "u"))
    back = spark.read.option("header", True).csv(str(tmp_path / "u"))
    assert back.columns == ["a", "b", "c"] and back.count() == 2
    with pytest.raises(ValueError):
        sinks.write_union_csv([a.limit(0)], str(tmp_path / "v"))
    text = sinks.summary_json(spark.createDataFrame([(1, None)], "a int, b string")).first()["json"]
    assert text == '{"a":1,"b":null}'


MD = """# Title
intro line

## Experimental setup
PMMA rods of 10 mm were tested at 101 kPa.
<!-- image -->
Ignition was observed.


Fig. 2 The chamber

## References
[1] Smith, 20 mm PMMA ignition tested
"""


def test_chunks_and_render(spark):
    df = spark.createDataFrame([("d", MD)], "doc string, md string")
    got = docs.paragraph_chunks(df, "doc", "md").orderBy("line_start").collect()
    assert [(r["type"], r["section"], r["line_start"], r["line_end"]) for r in got] == [
        ("other_paragraph", None, 1, 2), ("setup_paragraph", "Experimental setup", 5, 7),
        ("caption_context", "Experimental setup", 10, 10), ("other_paragraph", "References", 13, 13)]
    assert got[1]["text"] == "PMMA rods of 10 mm were tested at 101 kPa. Ignition was observed."
    u = docs.unique_chunks(docs.paragraph_chunks(df, "doc", "md"), "doc")
    src = spark.createDataFrame([("d", "d.md"), ("e", "e.md")], "doc string, source string")
    out = {r["doc"]: r["markdown"] for r in docs.render_excerpts(u, "doc", src).collect()}
    assert out["d"].startswith("# Extracted Experimental Context\n\nSource markdown: d.md\nTotal selected excerpts: 2\n\n## Excerpt 1\n\n- Type: setup_paragraph\n- Section: Experimental setup\n- Lines: 5-7\n\nPMMA")
    assert out["d"].endswith("Fig. 2 The chamber\n") and out["e"].endswith("excerpts: 0\n")


def test_lenient_json(spark):
    texts = ['{"a": 1}', 'x ```json\n{"a": 2}\n``` y', 'so {"a": 3} there', "none", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.orderBy("i").select(F.get_json_object(docs.lenient_json(F.col("t")), "$.a")).collect()
    assert [r[0] for r in got] == ["1", "2", "3", None, None]


def test_clean_and_truncate(spark):
    df = spark.createDataFrame([("a  \r\n\x00b\r\n\r\n\r\n\r\nc ",)], "t string")
    assert df.select(docs.clean_markdown(F.col("t"))).first()[0] == "a\nb\n\nc\n"
    assert df.select(docs.truncate_context(F.lit(" abcdef "), 3)).first()[0] == "abc\n\n[TRUNCATED]\n"


def test_quoted_line_breaks_stay_in_one_record(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Banner,,\nKey,Note,N\n1,"two\nlines",5\n2,plain,6\n')
    rows = tab.read_banner_csv(spark, str(tmp_path))
    assert sorted(map(tuple, rows.collect())) == [("1", "two\nlines", "5"), ("2", "plain", "6")]
