"""Approximate nearest neighbours by cosine: NN-descent graph, greedy graph search.

Nodes are the distinct vectors (equal vectors share a node; of its members
the smallest ids are kept, as many as an answer can hold), stored as int8 for
building and searching; answers are rescored in double on the vectors given.

Building. Random hyperplanes split the nodes into leaves of bounded size;
the best neighbours inside a leaf start the graph. Each round of NN-descent
is a Spark join of neighbours of neighbours: the edges, in both directions,
bring every node the vectors of its neighbours; all pairs among them are
compared, and a pair is sent on only if it beats the worst neighbour its node
has so far; the lists are then merged to the best K. Nodes that are
neighbours of very many others have their lists dealt over several groups.

Search. A query starts from its own node's neighbours and repeatedly expands
the best nodes seen that are not yet expanded (a beam), by joining them with
the graph and the vectors, until none of the best is left to expand.

The index covers every row. Recall is measured against brute force in
tests/llm/test_nn_descent.py and in the README.

Defined cases: rows with a null id, a null, empty or zero vector, or a null
or non-finite component take no part; only vectors of one length are
compared; rows that share an id and a vector count once; an id is no
candidate for itself; ties go to the smaller id; a query with no candidate
has no row. Columns other than the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlens.llm.common import partitions
from marketlens.llm.vectors import matrix, packed, starts_of, usable, whole_groups
from marketlens.session import write_table

#: Neighbours per node, random splits that start the graph, rounds of NN-descent.
NEIGHBOURS = 48
SPLITS = 2
ROUNDS = 3
#: Nodes per leaf of a split; neighbours compared at once in a round.
LEAF = 400
LIST = 128
#: Pairs sent on per node and list.
SENT = 12
#: Nodes a query may expand per step, and steps at most (the beam closes before that).
BEAM = 96
STEPS = 8



def _unit(q: np.ndarray) -> np.ndarray:
    m = q.astype(np.float32)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)


def nodes_of(rows: DataFrame, k: int) -> DataFrame:
    """(node, members, vec, dim, q8): one row per distinct vector; node is its
    smallest id, members its k + 1 smallest ids in order."""
    place = W.partitionBy("vec").orderBy("vec_id")
    few = rows.withColumn("place", F.dense_rank().over(place)).filter(F.col("place") <= k + 1).dropDuplicates(["vec", "place"])
    n = few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
    n = n.withColumn("top", F.array_max(F.transform("vec", F.abs)))
    q8 = F.transform("vec", lambda x: F.round(x / F.col("top") * 127).cast("tinyint"))
    return n.select(F.element_at("members", 1).alias("node"), "members", "vec", F.size("vec").alias("dim"), q8.alias("q8"))


def _pack(nodes: DataFrame) -> DataFrame:
    """(node, dim, q8 as a blob)."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.column("q8")
            flat, at = c.flatten().to_numpy(zero_copy_only=False).astype(np.int8), np.cumsum([0, *b.column("dim").to_pylist()])
            blobs = [flat[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({"node": b.column("node"), "dim": b.column("dim"), "q8": pa.array(blobs, pa.binary())})

    return nodes.select("node", "dim", "q8").mapInArrow(f, "node long, dim int, q8 binary")


def _rank_lists(node: np.ndarray, cand: np.ndarray, sim: np.ndarray, k: int) -> pa.Table:
    """Best k distinct candidates of each node as lists."""
    order = np.lexsort((-sim, cand, node))
    node, cand, sim = node[order], cand[order], sim[order]
    first = np.ones(len(node), bool)
    first[1:] = (node[1:] != node[:-1]) | (cand[1:] != cand[:-1])
    first &= node != cand
    node, cand, sim = node[first], cand[first], sim[first]
    order = np.lexsort((cand, -sim, node))
    node, cand, sim = node[order], cand[order], sim[order]
    at = starts_of(node)
    sizes = np.diff(np.append(at, len(node)))
    keep = np.arange(len(node)) - np.repeat(at, sizes) < k
    offsets = np.concatenate([[0], np.cumsum(np.minimum(sizes, k))]).astype(np.int32)
    return pa.table({
        "node": node[at],
        "cands": pa.ListArray.from_arrays(offsets, cand[keep]),
        "sims": pa.ListArray.from_arrays(offsets, sim[keep].astype(np.float32)),
    })


_LISTS = "node long, cands array<long>, sims array<float>"


def _merge(lists: DataFrame, k: int) -> DataFrame:
    """One row per node from any number of candidate lists."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["node"]):
            c = t["cands"].combine_chunks()
            node = np.repeat(t["node"].to_numpy(), np.diff(c.offsets.to_numpy()))
            out = _rank_lists(node, c.flatten().to_numpy(), t["sims"].combine_chunks().flatten().to_numpy(), k)
            yield from out.to_batches()

    n = partitions(lists.sparkSession)
    return lists.repartition(n, "node").sortWithinPartitions("node").mapInArrow(f, _LISTS)


def _leaf_lists(packed_nodes: DataFrame, split: int, count: int, k: int) -> DataFrame:
    """Candidate lists from one random split into leaves."""
    bits = max(0, int(np.ceil(np.log2(max(1, count / LEAF)))))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.array(b.column("dim").to_pylist())
            out = np.zeros(len(dims), np.int64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                planes = np.random.default_rng([split, int(dim)]).normal(size=(dim, bits)).astype(np.float32)
                side = _unit(packed(b.column("q8").take(pa.array(at)))) @ planes > 0
                out[at] = side @ (1 << np.arange(bits, dtype=np.int64)) if bits else 0
            yield pa.RecordBatch.from_pydict({"node": b.column("node"), "dim": b.column("dim"), "q8": b.column("q8"), "code": out})

    d = packed_nodes.mapInArrow(code, "node long, dim int, q8 binary, code long")
    # a leaf that many nodes fall in is cut into parts of about LEAF nodes
    parts = d.groupBy("dim", "code").agg(F.ceil(F.count("*") / (2 * LEAF)).alias("parts"))
    d = d.join(parts, ["dim", "code"]).withColumn("part", F.pmod(F.xxhash64("node", F.lit(split)), "parts")).drop("parts")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["dim", "code", "part"], 1):
            at = np.append(starts_of(t["dim"].to_numpy(), t["code"].to_numpy(), t["part"].to_numpy()), t.num_rows)
            for a, b in zip(at[:-1], at[1:], strict=True):
                ids, m = t["node"].to_numpy()[a:b], _unit(packed(t["q8"].slice(a, b - a)))
                if len(ids) < 2:
                    continue
                s = m @ m.T
                np.fill_diagonal(s, -2)
                few = min(k, len(ids) - 1)
                near = np.argpartition(-s, few - 1, axis=1)[:, :few]
                offsets = np.arange(0, few * len(ids) + 1, few, dtype=np.int32)
                yield pa.RecordBatch.from_pydict({
                    "node": ids,
                    "cands": pa.ListArray.from_arrays(offsets, ids[near].ravel()),
                    "sims": pa.ListArray.from_arrays(offsets, np.take_along_axis(s, near, 1).ravel().astype(np.float32)),
                })

    keys = ["dim", "code", "part"]
    return d.repartition(partitions(d.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(best, _LISTS)


def _round(graph: DataFrame, packed_nodes: DataFrame) -> DataFrame:
    """Candidate lists from comparing all neighbours of each node with one another."""
    spark = graph.sparkSession
    e = graph.select("node", F.explode("cands").alias("other"))
    e = e.union(e.select("other", "node"))
    hubs = e.groupBy("node").agg(F.ceil(F.count("*") / LIST).alias("lists")).filter("lists > 1")
    info = packed_nodes.join(graph.select("node", F.element_at("sims", -1).alias("worst"), F.size("sims").alias("has")), "node")
    info = info.withColumnRenamed("node", "other")
    e = e.join(info, "other").join(hubs, "node", "left")
    e = e.withColumn("list", F.pmod(F.xxhash64("other"), F.coalesce("lists", F.lit(1)))).drop("lists")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["node", "list"]):
            ids, m = t["other"].to_numpy(), _unit(packed(t["q8"].combine_chunks()))
            worst = np.where(t["has"].to_numpy() < NEIGHBOURS, -2, t["worst"].to_numpy()).astype(np.float32)
            at = starts_of(t["node"].to_numpy(), t["list"].to_numpy())
            sizes = np.diff(np.append(at, len(ids)))
            width = int(sizes.max())
            if width < 2:
                continue
            for lo in range(0, len(at), 64):  # a few lists at a time, padded to one width
                a, n = at[lo : lo + 64], sizes[lo : lo + 64]
                place = a[:, None] + np.minimum(np.arange(width), n[:, None] - 1)
                void = np.arange(width) >= n[:, None]
                v = m[place]
                s = v @ v.transpose(0, 2, 1)
                u = ids[place]
                s[(u[:, :, None] == u[:, None, :]) | void[:, None, :]] = -2
                few = min(SENT, width - 1)
                near = np.argpartition(-s, few - 1, axis=2)[:, :, :few]
                sim = np.take_along_axis(s, near, 2)
                good = (sim > worst[place][:, :, None]) & ~void[:, :, None]
                cand = np.take_along_axis(np.broadcast_to(u[:, None, :], s.shape), near, 2)
                rows = good.any(axis=2)
                counts = good.sum(axis=2)[rows]
                if not len(counts):
                    continue
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "node": u[rows],
                    "cands": pa.ListArray.from_arrays(offsets, cand[good]),
                    "sims": pa.ListArray.from_arrays(offsets, sim[good]),
                })

    cols = ["node", "list", "other", "q8", "worst", "has"]
    return e.select(*cols).repartition(partitions(spark), "node", "list").sortWithinPartitions("node", "list").mapInArrow(compare, _LISTS)


def build(packed_nodes: DataFrame, k: int = NEIGHBOURS, splits: int = SPLITS, rounds: int = ROUNDS) -> DataFrame:
    """The neighbour graph: (node, cands, sims), best first. Each round is a written table."""
    count = packed_nodes.count()
    lists = _leaf_lists(packed_nodes, 0, count, k)
    for i in range(1, splits):
        lists = lists.union(_leaf_lists(packed_nodes, i, count, k))
    graph = write_table(_merge(lists, k), "graph")
    for _ in range(rounds):
        graph = write_table(_merge(graph.union(_round(graph, packed_nodes)), k), "graph")
    return graph


def _score_pairs(pairs: DataFrame, with_queries: DataFrame, packed_nodes: DataFrame) -> DataFrame:
    """(query, node, sim) for (query, node) pairs."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, v = b.column("query_q8"), b.column("q8")
            same = np.array(b.column("query_dim")) == np.array(b.column("dim"))
            sim = np.full(b.num_rows, -2, np.float32)
            for dim in np.unique(np.array(b.column("dim"))[same]):
                at = np.flatnonzero(same & (np.array(b.column("dim")) == dim))
                sim[at] = np.einsum("ij,ij->i", _unit(packed(q.take(pa.array(at)))), _unit(packed(v.take(pa.array(at)))))
            yield pa.RecordBatch.from_pydict({"query": b.column("query"), "node": b.column("node"), "sim": sim})

    d = pairs.join(packed_nodes, "node").join(with_queries, "query")
    return d.select("query", "node", "q8", "dim", "query_q8", "query_dim").mapInArrow(f, "query long, node long, sim float")


def search(graph: DataFrame, packed_nodes: DataFrame, query_nodes: DataFrame, beam: int = BEAM, steps: int = STEPS) -> DataFrame:
    """(query, node, sim): the nodes seen by a greedy search from each query's node (``query_nodes``: node)."""
    qv = query_nodes.join(packed_nodes, "node").select(F.col("node").alias("query"), F.col("q8").alias("query_q8"), F.col("dim").alias("query_dim"))
    own = query_nodes.join(graph, "node").select(F.col("node").alias("query"), F.explode(F.arrays_zip("cands", "sims")).alias("c"))
    seen = own.select("query", F.col("c.cands").alias("node"), F.col("c.sims").alias("sim"), F.lit(False).alias("expanded"))
    seen = seen.union(query_nodes.select("node", "node", F.lit(1.0).cast("float"), F.lit(True)))
    seen = write_table(seen, "seen")
    best_first = W.partitionBy("query").orderBy(F.desc("sim"), "node")
    for _ in range(steps):
        ranked = seen.withColumn("place", F.row_number().over(best_first))
        now = (F.col("place") <= beam) & ~F.col("expanded")
        frontier = ranked.filter(now).select("query", "node")
        if frontier.isEmpty():
            break
        reached = frontier.join(graph, "node").select("query", F.explode("cands").alias("node")).distinct()
        new = reached.join(seen.select("query", "node"), ["query", "node"], "left_anti")
        old = ranked.select("query", "node", "sim", (F.col("expanded") | now).alias("expanded"))
        seen = write_table(old.union(_score_pairs(new, qv, packed_nodes).withColumn("expanded", F.lit(False))), "seen")
    return seen.select("query", "node", "sim")


def search_table(df: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: queries are the rows whose id is divisible by ``every``."""
    rows = usable(df, id_col, vec_col, zero_ok=False)
    nodes = write_table(nodes_of(rows, k), "nodes")
    small = write_table(_pack(nodes), "packed")
    graph = build(small)
    # a query searches from the node of its vector; queries with one vector share the search
    queries = rows.filter(F.col("vec_id") % every == 0).join(nodes.select("vec", "node"), "vec").select(
        F.col("vec_id").alias("query_id"), F.col("node").alias("query"))
    queries = write_table(queries.distinct(), "queries")
    seen = search(graph, small, queries.select(F.col("query").alias("node")).distinct())
    near = seen.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(F.desc("sim"), "node")))
    near = near.filter(F.col("place") <= 8 * k)  # int8 similarities choose, exact ones order
    v = near.join(nodes.select("node", "members", "vec"), "node").join(
        nodes.select(F.col("node").alias("query"), F.col("vec").alias("q_vec")), "query")
    scored = v.mapInArrow(_exact_scores, "query long, members array<long>, score double")
    found = queries.join(scored, "query").select("query_id", F.explode("members").alias("vec_id"), "score").filter("vec_id <> query_id")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _exact_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cosines in double of the vectors as given."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = np.diff(b.column("vec").offsets.to_numpy())
        out = np.zeros(b.num_rows)
        for dim in np.unique(sizes):
            at = pa.array(np.flatnonzero(sizes == dim))
            x, q = matrix(b.column("vec").take(at), np.float64), matrix(b.column("q_vec").take(at), np.float64)
            # scaled by the largest component first, so that squares neither overflow nor vanish
            x, q = (m / np.abs(m).max(axis=1, keepdims=True) for m in (x, q))
            norms = np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", q, q))
            out[at.to_numpy()] = np.einsum("ij,ij->i", x, q) / norms
        yield pa.RecordBatch.from_pydict({"query": b.column("query"), "members": b.column("members"), "score": out})


