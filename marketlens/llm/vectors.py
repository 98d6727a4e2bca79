"""Reading vector tables, and batches of whole key groups for Arrow functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, id_col: str, vec_col: str, zero_ok: bool) -> DataFrame:
    """(vec_id, vec) of the rows that take part.

    Rows take no part if the id or the vector is null or empty, if a component
    is null or not finite, or, unless ``zero_ok``, if all components are zero.
    """
    d = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    d = d.filter(F.col("vec_id").isNotNull() & (F.size("vec") > 0) & sound)
    if not zero_ok:
        d = d.filter(F.exists("vec", lambda x: x != 0))
    return d


def matrix(column: pa.Array, dtype) -> np.ndarray:
    """The vectors of a list column (all of one length) as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1)


def packed(column: pa.Array) -> np.ndarray:
    """The rows of a column of equally long int8 blobs as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(len(column), -1)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 20_000) -> Iterator[pa.Table]:
    """Join sorted batches into tables of at least ``least`` rows that end where the key changes.

    Memory holds ``least`` rows and one group; callers see to it that a group is bounded.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        cut = t.num_rows - 1
        differs = np.zeros(cut, bool)
        for k in keys:
            c = t[k].to_numpy()
            differs |= c[1:] != c[:-1]
        ends = np.flatnonzero(differs)
        if len(ends):
            at = int(ends[-1]) + 1
            yield t.slice(0, at)
            held = t.slice(at).to_batches()
            rows = t.num_rows - at
        else:
            held = t.to_batches()
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Index of the first row of each run of equal keys (rows sorted by the keys)."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)
