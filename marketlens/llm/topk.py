"""Exact top-k by inner product of integer vectors, pruned by segment statistics.

A vector is cut into segments; of each segment the mean and the standard
deviation are kept, at several resolutions (few long segments to many short
ones). For a query q and a row x

    |q - x|^2  >=  sum over segments of  n * ((mean_q - mean_x)^2 + (dev_q - dev_x)^2)

and, as the squared lengths are known, the inner product is bounded from
above by half of |q|^2 + |x|^2 less that bound. Pairs are dropped from coarse
to fine as soon as the bound falls below the k-th best score found so far;
survivors are scored exactly.

Queries and rows are packed into blocks by a hash of the id, each pair of a
query block and a row block is one group, and a group returns its k best per
query; a window keeps the k best over all groups. Work grows with queries x
rows, as an exact search against every row must; memory per task is one pair
of blocks.

Defined cases: rows with a null id, a null or empty vector, or a null or
non-finite component take no part; a candidate must have the query's number
of components; rows repeated in full count once; of rows that share an id the
best score counts, and none of them is a candidate for that id; ties go to
the smaller id; a query without candidates has no row. Scores beyond the long
range are clamped to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlens.llm.vectors import usable

#: Segments per vector, coarse to fine.
RESOLUTIONS = (4, 8, 16)
ROWS_PER_BLOCK = 4096
QUERIES_PER_BLOCK = 1024
#: Rows scored exactly first, best bound first, to get a threshold.
PILOT = 64
_LONG = 2**63 - 1


def segment_stats(m: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each segment, scaled by the root of its length, side by side."""
    edges = np.unique(np.linspace(0, m.shape[1], min(segments, m.shape[1]) + 1).astype(int))
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        part = m[:, a:b]
        out += [part.mean(axis=1) * np.sqrt(b - a), part.std(axis=1) * np.sqrt(b - a)]
    return np.stack(out, axis=1)


def _exact(q: np.ndarray, rows: np.ndarray, plain: bool) -> np.ndarray:
    if plain:
        return (rows @ q).astype(np.int64)
    total = [sum(int(a) * int(b) for a, b in zip(q, r, strict=True)) for r in rows]
    return np.array([max(-_LONG, min(_LONG, t)) for t in total], np.int64)


def block_top(qid: np.ndarray, q: np.ndarray, rid: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of the k best ids of this block of rows, for each query of a block."""
    limit = float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1]
    plain = limit < 2**52  # products and sums are whole numbers a double holds exactly
    q2, x2 = (q * q).sum(axis=1), (x * x).sum(axis=1)
    qs, xs = [segment_stats(q, r) for r in RESOLUTIONS], [segment_stats(x, r) for r in RESOLUTIONS]
    slack = 1e-9 * float(q2.max() + x2.max()) + 1e-6

    def bounds(i: int, level: int, among: np.ndarray) -> np.ndarray:
        d = xs[level][among] - qs[level][i]
        return (q2[i] + x2[among] - (d * d).sum(axis=1)) / 2 + slack

    # |a-b|^2 = |a|^2 + |b|^2 - 2ab for all pairs of the coarsest level at once
    a, b = qs[0], xs[0]
    coarse = (q2[:, None] + x2 - ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T)) / 2 + slack
    for i in range(len(q)):
        other = np.flatnonzero(rid != qid[i])
        if not len(other):
            continue
        ub = coarse[i][other]
        if len(other) > PILOT:
            first = np.argpartition(-ub, PILOT - 1)[:PILOT]
        else:
            first = np.arange(len(other))
        best_id, best = _best(rid[other[first]], _exact(q[i], x[other[first]], plain), k)
        left = np.ones(len(other), bool)
        left[first] = False
        at = other[left]
        if len(best) == k:
            at = at[ub[left] >= best[-1]]
            for level in range(1, len(RESOLUTIONS)):
                at = at[bounds(i, level, at) >= best[-1]] if len(at) else at
        if len(at):
            best_id, best = _best(np.concatenate([best_id, rid[at]]), np.concatenate([best, _exact(q[i], x[at], plain)]), k)
        yield int(qid[i]), best_id, best


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best distinct ids, highest score first, ties to the smaller id."""
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    if len(np.unique(ids)) < len(ids):
        _, first = np.unique(ids, return_index=True)
        first.sort()
        ids, scores = ids[first], scores[first]
    return ids[:k], scores[:k]


def top_k(rows: DataFrame, queries: DataFrame, k: int, scale: int | None = 256) -> DataFrame:
    """query_id, rank, vec_id, score for (vec_id, vec) relations; components become floor(scale * x)."""
    spark = rows.sparkSession

    def pack(df: DataFrame, per_block: int) -> tuple[DataFrame, DataFrame]:
        d = df.withColumn("dim", F.size("vec"))
        # one row per vector length: the number of blocks it needs
        sizes = d.groupBy("dim").agg(F.ceil(F.count("*") / per_block).alias("blocks"))
        d = d.join(sizes, "dim").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks"))

        def to_blob(group: pa.Table) -> pa.Table:
            m = group["vec"].combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)
            m = np.floor(m * scale) if scale else m
            return pa.table({
                "dim": group["dim"][:1], "block": group["block"][:1],
                "ids": pa.array([group["vec_id"].to_numpy().astype("<i8").tobytes()], pa.binary()),
                "data": pa.array([m.astype("<f8").tobytes()], pa.binary()),
            })

        blobs = d.select("dim", "block", "vec_id", "vec").groupBy("dim", "block").applyInArrow(
            to_blob, "dim int, block long, ids binary, data binary")
        return blobs, sizes

    x, x_sizes = pack(rows, ROWS_PER_BLOCK)
    q, q_sizes = pack(queries, QUERIES_PER_BLOCK)
    # every query block meets every row block of its vector length: the stated query set against all rows, in blocks
    x = x.join(q_sizes, "dim").withColumn("q_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    q = q.join(x_sizes, "dim").withColumnsRenamed({"block": "q_block", "ids": "q_ids", "data": "q_data"}).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        ids: list = []
        out: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            qid = np.frombuffer(left["q_ids"][0].as_py(), "<i8")
            qm = np.frombuffer(left["q_data"][0].as_py(), "<f8").reshape(len(qid), -1)
            rid = np.frombuffer(right["ids"][0].as_py(), "<i8")
            xm = np.frombuffer(right["data"][0].as_py(), "<f8").reshape(len(rid), -1)
            for one, ids, scores in block_top(qid, qm, rid, xm, k):
                out[0].append(np.full(len(ids), one, np.int64))
                out[1].append(ids)
                out[2].append(scores)
        cat = [np.concatenate(c) if c else np.empty(0, np.int64) for c in out]
        return pa.table({"query_id": cat[0], "vec_id": cat[1].astype(np.int64), "score": cat[2].astype(np.int64)})

    by = ["dim", "block", "q_block"]
    found = q.groupBy(*by).cogroup(x.groupBy(*by)).applyInArrow(search, "query_id long, vec_id long, score long")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_table(df: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Queries: the rows whose id is divisible by ``every``; candidates: all other rows."""
    rows = usable(df, id_col, vec_col, zero_ok=True)
    return top_k(rows, rows.filter(F.col("vec_id") % every == 0), k)


#: DuckDB form over ``embeddings`` (vec_id, embedding): 256 ** 2 times smaller than the double range, sums are exact.
TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, x -> floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(list_dot_product(q.v, c.v))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
  GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
