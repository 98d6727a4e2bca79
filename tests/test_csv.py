"""Encodings and record boundaries of labelled CSV files, in one split and in many."""

import csv
import io
import os
import tempfile

import pytest

from marketlens.sources import load_labeled_csv
from marketlens.sources.csv_records import detect_encoding

ROWS = [["1", "plain", "a"], ["2", "two\nlines, and a \"quote\"", "b"], ["3", "café – naïve", "a"], ["4", "", "c"],
        ["5", "three\n\nlines\n", "b"], *[[str(i), f"row {i}", "a"] for i in range(6, 300)], ["300", "end, \"of\" it\nall", "c"]]


def _write(raw: bytes) -> str:
    path = os.path.join(tempfile.mkdtemp(prefix="ml-csv-"), "t.csv")
    with open(path, "wb") as f:
        f.write(raw)
    return path


def _text(rows, end="\n") -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows([["id", "question", "label"], *rows])
    return out.getvalue()


def _read(spark, path, encoding=None):
    df = load_labeled_csv(spark, path, encoding)
    assert df.columns == ["id", "question", "label"]
    return sorted(([r["id"], r["question"] or "", r["label"]] for r in df.collect()), key=lambda r: int(r[0]))


@pytest.mark.parametrize("split", [128 << 20, 700])
@pytest.mark.parametrize("encoding,found", [("utf-8", "utf-8"), ("utf-8-sig", "utf-8"), ("cp1252", "cp1252")])
def test_encodings(spark, encoding, found, split):
    path = _write(_text(ROWS).encode(encoding))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        assert detect_encoding(spark, path) == found
        assert _read(spark, path) == ROWS
        assert _read(spark, path, encoding) == ROWS
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_replacement_character_is_text_and_latin_is_last(spark):
    rows = [["1", "odd � sign", "a"]]
    assert _read(spark, _write(_text(rows).encode())) == rows
    path = _write(_text([["1", "caf\xe9 \x81", "a"]]).encode("latin-1"))
    assert detect_encoding(spark, path) == "latin-1"
    assert _read(spark, path) == [["1", "caf\xe9 \x81", "a"]]


def test_line_ends_and_session_settings(spark):
    rows = [["1", "x", "a"], ["2", "é", "b"]]
    before = spark.conf.get("spark.sql.legacy.javaCharsets")
    assert _read(spark, _write(_text(rows, "\r\n").encode("cp1252"))) == rows
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == before
