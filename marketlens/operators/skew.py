"""Hot keys in ordered per-key windows.

``lag``/``lead``/rolling frames partitioned by a key put all of its rows into
one task. Keys with more rows than a task should take are *hot*: their rows, and
only theirs, are range-partitioned and sorted by (key, time, tie-break),
whatever the number of hot keys and the size of one, and each partition is cut
by position into *chunks* of at most the rows that a task takes. Windows run
per (key, chunk), and what crosses a chunk's edge is carried from
one-row-per-chunk summaries. Chunks may be many and small; the partitions
follow from the rows, not from the number of chunks.

The chunked rows are written to the shared folder: range bounds come from a
sample, and the written rows keep the bounds of one run for every later step,
also after executors are lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketlens.session import write_table

CHUNK = "_chunk"

#: Rows of one key that a task takes; tests and the ``_split`` queries pass small values to force splitting.
ROWS_PER_TASK = 4_000_000
#: Range bounds are sampled: partitions are planned at this part of their rows so that none exceeds them.
PLANNED = 0.5


class HotKeys:
    """The hot keys as a written one-column table, and how many rows they have together."""

    def __init__(self, keys: DataFrame, rows: int, rows_per_task: int):
        self.keys, self.rows, self.rows_per_task = keys, rows, rows_per_task

    def pieces(self, parallel: int) -> int:
        """Partitions of the hot rows: one per chunk up to ``parallel``, beyond that only as many as their rows need."""
        def of(rows: int) -> int:
            return -(-self.rows // max(1, int(rows * PLANNED)))

        return max(2, min(of(self.rows_per_task), parallel), of(max(self.rows_per_task, ROWS_PER_TASK)))


def hot_keys(df: DataFrame, key: str, rows_per_task: int = ROWS_PER_TASK) -> HotKeys | None:
    """The keys with more than ``rows_per_task`` rows, None if there are none.

    One grouped count; what is read back is one row. ``df`` may hold more rows
    than those that are split later: the plan then has more pieces than needed.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > rows_per_task) & F.col(key).isNotNull())
    found = counts.agg(F.count(F.lit(1)).alias("keys"), F.sum("_n").alias("rows")).first()
    if not found["keys"]:
        return None
    return HotKeys(write_table(counts.select(key), "hot-keys"), found["rows"], rows_per_task)


def split(df: DataFrame, key: str, order: tuple[str, ...], hot: HotKeys) -> tuple[DataFrame, DataFrame]:
    """(rows of the other keys, rows of the hot keys with ``_chunk``); the chunks of a key are in ``order``."""
    normal = df.join(hot.keys, key, "left_anti")
    pieces = hot.pieces(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.join(hot.keys, key, "left_semi").repartitionByRange(pieces, key, *order).sortWithinPartitions(key, *order)
    # the id counts a partition's rows in order, above 33 bits is the partition's number
    position = F.pmod(F.monotonically_increasing_id(), F.lit(1 << 33))
    chunk = F.spark_partition_id() * F.lit(1 << 33) + F.floor(position / F.lit(hot.rows_per_task))
    return normal, write_table(rows.withColumn(CHUNK, chunk), "hot-rows")


def split_hot_keys(df: DataFrame, key: str, *order: str, rows_per_task: int = ROWS_PER_TASK) -> tuple[DataFrame, bool]:
    """``df`` with ``_chunk`` (0 for ordinary keys) and whether any key was split."""
    hot = hot_keys(df, key, rows_per_task)
    if hot is None:
        return df.withColumn(CHUNK, F.lit(0).cast("long")), False
    normal, chunked = split(df, key, order, hot)
    return normal.withColumn(CHUNK, F.lit(0).cast("long")).unionByName(chunked), True


def chunk_window(key: str, *order: str | Column) -> Window:
    return Window.partitionBy(key, CHUNK).orderBy(*order)


def next_chunk_first(chunk_stats: DataFrame, key: str, first_cols: list[str]) -> DataFrame:
    """For per-(key, chunk) stats, attach the given first-row columns of the
    *next* chunk of the same key (NULL for the last chunk). The table has one
    row per chunk, so the key window here is small even for a hot key."""
    w = Window.partitionBy(key).orderBy(CHUNK)
    out = chunk_stats
    for c in first_cols:
        out = out.withColumn(f"next_{c}", F.lead(c).over(w))
    return out
