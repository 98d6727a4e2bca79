"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a small table that one task writes, and the fewest tasks.
ROWS_PER_TASK, LEAST_TASKS = 10_000, 4

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark (the folder may be in any store Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def few(d: DataFrame, rows: int, each: int = ROWS_PER_TASK) -> DataFrame:
    """``d``, which has about ``rows`` rows, in no more partitions than these need: a file costs as much with one row as with thousands."""
    return d.coalesce(max(LEAST_TASKS, -(-rows // each)))


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def row_key(id_col: str, text_col: str) -> list[Column]:
    """(row_id, row_hash): rows equal in id and text share a key, all others differ."""
    return [F.col(id_col).alias("row_id"), F.xxhash64(F.col(text_col)).alias("row_hash")]
