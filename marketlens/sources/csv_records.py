"""Labelled CSV files of unknown encoding (S6, S7), read in splits.

The lines are read as bytes, in as many splits as the files have. Whether all
are valid UTF-8 is one aggregate over them; U+FFFD in valid UTF-8 is text like
any other. A quoted field may hold line breaks: whether a line starts a
record follows from the number of quotes before it, a prefix sum over splits,
and only the lines of such records are put together. No setting of the
session is touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: The order in which encodings are tried; a BOM is taken off whichever UTF-8 is meant.
ENCODINGS = ("utf-8", "utf-8-sig", "cp1252", "latin-1")
_UTF8 = {"utf-8", "utf8", "utf-8-sig", "utf_8", "utf_8_sig"}
_CP1252 = {"cp1252", "windows-1252"}
_LATIN = {"latin-1", "latin1", "iso-8859-1"}

# Code points 0x80-0x9F of cp1252, from the codec itself; five of them are not defined.
_HIGH = [bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)]
_FROM = "".join(chr(0x80 + i) for i, c in enumerate(_HIGH) if c)
_TO = "".join(_HIGH)
_UNDEFINED = "[" + "".join(f"\\x{0x80 + i:02x}" for i, c in enumerate(_HIGH) if not c) + "]"

_SPLIT = ["file", "block"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value): the lines as they are, and where they lie."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                      F.monotonically_increasing_id().alias("at"), "value")


def _latin(value: Column) -> Column:
    return F.decode(value.cast("binary"), "ISO-8859-1")


def detect_encoding(spark: SparkSession, path: str) -> str:
    """The first of ``ENCODINGS`` that every line can be read in (latin-1 can read any)."""
    bad = ~F.is_valid_utf8("value")
    found = _lines(spark, path).agg(F.count_if(bad).alias("bad"), F.count_if(_latin(F.col("value")).rlike(_UNDEFINED)).alias("undefined")).first()
    if not found["bad"]:
        return "utf-8"
    return "latin-1" if found["undefined"] else "cp1252"


def _decoded(value: Column, encoding: str) -> Column:
    name = encoding.lower()
    if name in _UTF8:
        return F.make_valid_utf8(value)
    if name in _CP1252:
        return F.translate(_latin(value), _FROM, _TO)
    if name in _LATIN:
        return _latin(value)
    return F.decode(value.cast("binary"), encoding)


def _records(lines: DataFrame) -> DataFrame:
    """(file, record, text): whole records in file order, counted from 1 per file; empty lines are left out."""
    d = lines.withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    # quotes before a line: those of the splits before its own (a row per split), and of the lines before it in the split
    per = d.groupBy(*_SPLIT).agg(F.sum("quotes").alias("quotes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*_SPLIT, F.coalesce(F.sum("quotes").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy(*_SPLIT).orderBy("at")
    d = d.join(per, _SPLIT).withColumn("ahead", F.col("ahead") + F.sum("quotes").over(inside) - F.col("quotes"))
    d = d.withColumn("starts", (F.col("ahead") % 2 == 0).cast("long"))
    firsts = d.groupBy(*_SPLIT).agg(F.sum("starts").alias("starts"))
    firsts = firsts.select(*_SPLIT, F.coalesce(F.sum("starts").over(before), F.lit(0)).alias("records"))
    d = d.join(firsts, _SPLIT).withColumn("record", F.col("records") + F.sum("starts").over(inside))
    single = (F.col("starts") == 1) & (F.col("quotes") % 2 == 0)
    whole = d.where(single).select("file", "record", F.col("value").alias("text"))
    parts = d.where(~single).groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("p"))
    parts = parts.select("file", "record", F.array_join(F.transform("p", lambda p: p["value"]), "\n").alias("text"))
    return whole.unionByName(parts).withColumn("text", F.regexp_replace("text", "\r$", "")).where("text <> ''")


def _read(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    lines = _lines(spark, path).withColumn("value", _decoded(F.col("value"), encoding))
    if encoding.lower() in _UTF8:
        lines = lines.withColumn("value", F.when(F.col("block") == 0, F.regexp_replace("value", "^﻿", "")).otherwise(F.col("value")))
    records = _records(lines)
    heads = records.groupBy("file").agg(F.min_by("text", "record").alias("text"), F.min("record").alias("first"))
    head = heads.orderBy("file").first()  # one line
    if head is None:
        return spark.createDataFrame([], T.StructType([]))
    width = spark.range(1).select(F.size(F.split(F.lit(head["text"]), ","))).first()[0]
    options = {"escape": '"', "quote": '"', "sep": ","}
    wide = ", ".join(f"c{i} string" for i in range(width))
    names = spark.range(1).select(F.from_csv(F.lit(head["text"]), wide, options).alias("h")).first()["h"]
    names = [n for n in names if n is not None]
    ddl = ", ".join(f"c{i} string" for i in range(len(names)))
    body = records.join(heads.select("file", "first"), "file").where("record <> first")
    row = F.from_csv("text", ddl, options).alias("r")
    return body.select(row).select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])


def load_labeled_csv(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """Header CSV as text columns; an explicit encoding wins, otherwise the first of ``ENCODINGS`` that fits."""
    return _read(spark, path, encoding or detect_encoding(spark, path))
