"""Bulk-synchronous best-fit packing of documents into sequences.

Documents longer than a sequence are cut; whole pieces are then placed in
rounds. In a round the pieces and the gaps (free ends of open sequences) are
range-sorted by size into partitions. Each partition sweeps its range from
the largest piece down, giving each the smallest gap that holds it (its
successor in size order, ties by id); a gap that still fits the range is
offered again. Pieces whose successor lies in a partition of larger sizes are
matched across partitions: each partition reports how many pieces and gaps it
has left, a sweep over those counts pairs them as intervals of ranks, and the
conflict of several pieces for one gap is thereby settled by rank (largest
piece, smallest gap first). Gaps are updated and the next round begins.

A round gives a gap of another partition one piece. Where pieces are small and few get
a place so, gaps are filled in bulk: pieces and gaps, largest first, are laid
along two lines by distributed prefix sums of their sizes, and each gap takes the
run of pieces that lies within it. Only if that places few as well are new
sequences opened by the largest pieces left, as many as the free space that
fits them falls short of. Once what is left fits
one partition its sweep opens sequences itself, and packing ends; a table
that small is packed by exact best-fit decreasing in one round.

State between rounds is (piece, length) and (sequence, gap), written tables;
texts and ids never move. The driver sees a few counts per partition.

Defined cases: null text is read as empty; every document has at least the
end id and hence a piece; repeated rows are packed each; an empty table packs
into nothing; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.common import text_or_empty
from marketlens.llm.tokens import encoder
from marketlens.session import write_table

CAPACITY = 2048
#: Pieces and gaps per partition of a sweep.
ROWS_PER_SWEEP = 200_000
#: A round that places less than this share of the pieces left opens new sequences.
LEAST_PLACED = 0.1
#: Up to so many pieces of one size are chosen exactly to open sequences.
FIRST_OPENED = 1000

_SWEPT = "kind string, id long, size int, part int, sequence long, gap int, place long"


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and a unique ``id`` of every piece."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in batches:
            out: tuple[list, list, list, list, list] = ([], [], [], [], [])
            for i, blob in zip(b.column("id").to_pylist(), enc.encode(b.column("text").to_pylist()), strict=True):
                ids = memoryview(blob + end)
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for c, v in zip(out, (i, n, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(out[0], pa.int64()), "piece": pa.array(out[1], pa.int32()), "start": pa.array(out[2], pa.int64()),
                "length": pa.array(out[3], pa.int64()), "ids_crc32": pa.array(out[4], pa.int64())})

    d = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    p = d.mapInArrow(f, "doc_id long, piece int, start long, length long, ids_crc32 long")
    return write_table(p.withColumn("id", F.monotonically_increasing_id()), "pieces")


def sweep(sizes: np.ndarray, ids: np.ndarray, gaps: np.ndarray, sequences: np.ndarray, least: int, open_new: bool, capacity: int = CAPACITY):
    """Best-fit decreasing within one partition.

    Pieces and gaps come largest first. Returns, for each piece, its sequence
    and the gap it went to (-1: none), the gaps left as (sequence, gap), and
    whether each was changed. A changed gap below ``least``, the smallest size
    of this partition, is not offered again here.
    """
    order: list[tuple[int, int, bool]] = []  # (gap, sequence, changed), smallest first
    out_sequence, out_gap = np.full(len(sizes), -1, np.int64), np.zeros(len(sizes), np.int64)
    given: list[tuple[int, int]] = sorted(zip(gaps.tolist(), sequences.tolist(), strict=True))
    order = [(g, s, False) for g, s in given]
    below: list[tuple[int, int, bool]] = []
    for k, (size, one) in enumerate(zip(sizes.tolist(), ids.tolist(), strict=True)):
        at = bisect.bisect_left(order, (size,))
        if at < len(order):
            gap, sequence, _ = order.pop(at)
        elif open_new:
            gap, sequence = capacity, one
        else:
            continue
        out_sequence[k], out_gap[k] = sequence, gap
        left = gap - size
        if left >= max(1, least):
            bisect.insort(order, (left, sequence, True))
        elif left > 0:
            below.append((left, sequence, True))
    return out_sequence, out_gap, order + below


def _round(state: DataFrame, parts: int, capacity: int) -> DataFrame:
    """One sweep over (kind, id, size); kind 'p': pieces, 'g': gaps.

    Returned rows: pieces with their sequence and gap, or sequence null and
    place, their rank among the partition's unmatched; gaps left likewise
    (gaps made in this round have sequence -1 and no place: they are offered
    in the next one).
    """
    open_new = parts == 1

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        is_gap, ids, sizes = (np.array(t["kind"].to_pylist()) == "g"), t["id"].to_numpy(), t["size"].to_numpy().astype(np.int64)
        part = TaskContext.get().partitionId()
        sequence, gap, left = sweep(sizes[~is_gap], ids[~is_gap], sizes[is_gap], ids[is_gap], 1 if open_new else int(sizes.min()), open_new, capacity)
        lost = sequence < 0
        place = np.where(lost, np.cumsum(lost) - 1, -1)
        left.sort(key=lambda g: (-g[0], g[1]))
        fresh = np.array([c for *_, c in left], bool)
        old_place = np.where(fresh, -1, np.cumsum(~fresh) - 1)
        n, m = len(sequence), len(left)
        yield pa.RecordBatch.from_pydict({
            "kind": pa.array(["p"] * n + ["g"] * m),
            "id": np.concatenate([ids[~is_gap], np.array([s for _, s, _ in left], np.int64)]),
            "size": np.concatenate([sizes[~is_gap], np.array([g for g, *_ in left], np.int64)]).astype(np.int32),
            "part": np.full(n + m, part, np.int32),
            "sequence": pa.array(np.concatenate([sequence, np.where(fresh, -1, 0)]), pa.int64()),
            "gap": np.concatenate([gap, np.zeros(m, np.int64)]).astype(np.int32),
            "place": np.concatenate([place, old_place]).astype(np.int64),
        })

    d = state.select("kind", "id", F.col("size").cast("int").alias("size"))
    order = (F.desc("size"), F.xxhash64("id"))
    d = d.repartitionByRange(parts, *order) if parts > 1 else d.coalesce(1)
    return write_table(d.sortWithinPartitions(F.desc("size"), "id").mapInArrow(f, _SWEPT), "swept")


def match_parts(pieces: dict[int, int], gaps: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """Pair unmatched pieces with unmatched gaps of partitions of larger sizes.

    Partition 0 has the largest sizes. Largest pieces first, each takes the
    smallest free gap; as gaps of lower partitions are smaller, that is the
    nearest partition above with gaps left, from its last gap on. Returns
    intervals (piece part, first place, gap part, last place, n): piece
    ``first + i`` goes with gap ``last - i``.
    """
    out = []
    free: list[list[int]] = []  # (part, gaps left), nearest last
    for part in sorted(set(pieces) | set(gaps)):
        todo, at = pieces.get(part, 0), 0
        while todo and free:
            n = min(todo, free[-1][1])
            out.append((part, at, free[-1][0], free[-1][1] - 1, n))
            at, todo = at + n, todo - n
            free[-1][1] -= n
            if not free[-1][1]:
                free.pop()
        if gaps.get(part):
            free.append([part, gaps[part]])
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, rows_per_sweep: int = ROWS_PER_SWEEP) -> DataFrame:
    """(id, sequence_id, offset) for pieces (id, length)."""
    spark = pieces.sparkSession
    whole = pieces.filter(F.col("length") >= capacity).select("id", F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    state = pieces.filter(F.col("length") < capacity).select(F.lit("p").alias("kind"), "id", F.col("length").cast("int").alias("size"))
    done = whole
    counts = _counts(state)
    if counts["p"] > rows_per_sweep:
        state, first = _open(spark, state, counts, capacity)
        done = done.union(first)
        counts = _counts(state)
    while counts["p"]:
        parts = -(-(counts["p"] + counts["g"]) // rows_per_sweep)
        swept = _round(state, parts, capacity)
        unplaced = F.col("sequence").isNull() | (F.col("sequence") < 0)
        p, g = swept.filter("kind = 'p'"), swept.filter("kind = 'g'")
        placed = p.filter(~unplaced).select("id", F.col("sequence").alias("sequence_id"), (F.lit(capacity) - F.col("gap")).cast("long").alias("offset"))
        left_p, left_g = p.filter(unplaced), g.filter("place >= 0")
        fresh = g.filter("place < 0").select("kind", "id", "size")
        # one row per partition and kind
        n = swept.filter("place >= 0").groupBy("kind", "part").count().collect()
        plan = match_parts(*({r["part"]: r["count"] for r in n if r["kind"] == k} for k in "pg"))
        if plan:
            plan = spark.createDataFrame(plan, "p_part int, first long, g_part int, last long, n long")
            a = left_p.join(F.broadcast(plan), (F.col("part") == F.col("p_part")) & (F.col("place") >= F.col("first")) & (F.col("place") < F.col("first") + F.col("n")))
            a = a.select(F.col("id").alias("p_id"), F.col("size").alias("p_size"), "g_part", (F.col("last") - (F.col("place") - F.col("first"))).alias("g_place"))
            across = write_table(a.join(left_g.select(F.col("id").alias("g_id"), F.col("size").alias("g_size"), F.col("part").alias("g_part"), F.col("place").alias("g_place")),
                                        ["g_part", "g_place"]), "across")
            placed = placed.union(across.select("p_id", "g_id", (F.lit(capacity) - F.col("g_size")).cast("long")))
            left_p = left_p.join(across.select(F.col("p_id").alias("id")), "id", "left_anti")
            left_g = left_g.join(across.select(F.col("g_id").alias("id")), "id", "left_anti")
            fresh = fresh.union(across.filter("g_size > p_size").select(F.lit("g"), "g_id", F.col("g_size") - F.col("p_size")))
        done = done.union(placed)
        state = left_p.select("kind", "id", "size").union(left_g.select("kind", "id", "size")).union(fresh)
        before, state = counts, write_table(state, "packing")
        counts = _counts(state)
        few = LEAST_PLACED * before["p"]
        if counts["p"] and counts["g"] and before["p"] - counts["p"] < few:
            state, filled = _fill(state, max(1, -(-(counts["p"] + counts["g"]) // rows_per_sweep)), capacity)
            done = done.union(filled)
            counts = _counts(state)
        if counts["p"] + counts["g"] > rows_per_sweep and before["p"] - counts["p"] < few:
            state, first = _open(spark, state, counts, capacity)
            done = done.union(first)
            counts = _counts(state)
        # gaps smaller than every piece left are closed
        state = state.filter((F.col("kind") == "p") | (F.col("size") >= counts["least"]))
    return done


def _counts(state: DataFrame) -> dict:
    """Pieces, gaps that hold the smallest piece, their totals, and the smallest piece."""
    least = state.filter("kind = 'p'").agg(F.min("size")).first()[0] or 0
    rows = {r["kind"]: r for r in state.filter((F.col("kind") == "p") | (F.col("size") >= least)).groupBy("kind").agg(F.count("*").alias("n"), F.sum("size").alias("total")).collect()}
    out: dict = {k: rows[k]["n"] if k in rows else 0 for k in "pg"}
    out |= {f"{k}_total": rows[k]["total"] if k in rows else 0 for k in "pg"}
    return out | {"least": least}


def _laid(rows: DataFrame, parts: int, name: str) -> DataFrame:
    """(id, size, start): ``rows`` one after the other, largest first; start is the sum of the sizes before."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            upto = total + np.cumsum(b.column("size").to_numpy(), dtype=np.int64)
            if len(upto):
                yield pa.RecordBatch.from_pydict({"id": b.column("id"), "size": b.column("size"), "part": pa.array(np.full(len(upto), part, np.int32)),
                                                  "local": upto - b.column("size").to_numpy()})
                total = int(upto[-1])

    order = (F.desc("size"), F.xxhash64("id"))
    d = rows.select("id", F.col("size").cast("int").alias("size"))
    d = (d.repartitionByRange(parts, *order) if parts > 1 else d.coalesce(1)).sortWithinPartitions(F.desc("size"), "id")
    d = write_table(d.mapInArrow(f, "id long, size int, part int, local long"), name)
    before, first = 0, []
    for r in d.groupBy("part").agg(F.sum("size").alias("n")).orderBy("part").collect():  # one row per partition
        first.append((r["part"], before))
        before += r["n"]
    first = rows.sparkSession.createDataFrame(first, "part int, first long")
    return d.join(F.broadcast(first), "part").select("id", "size", (F.col("first") + F.col("local")).alias("start"))


def _fill(state: DataFrame, parts: int, capacity: int) -> tuple[DataFrame, DataFrame]:
    """Give each gap the run of pieces that lies within it when both are laid out; (state, placed pieces)."""
    p, g = (_laid(state.filter(F.col("kind") == k), parts, f"laid-{k}") for k in "pg")
    g = g.select(F.col("id").alias("gap_id"), F.col("size").alias("gap"), F.col("start").alias("from"))
    # a gap touches two stretches of ``capacity`` at most
    cells = g.withColumn("cell", F.explode(F.sequence(F.floor(F.col("from") / capacity), F.floor((F.col("from") + F.col("gap") - 1) / capacity))))
    inside = (F.col("start") >= F.col("from")) & (F.col("start") + F.col("size") <= F.col("from") + F.col("gap"))
    runs = write_table(p.withColumn("cell", F.floor(F.col("start") / capacity)).join(cells, "cell").filter(inside).drop("cell"), "runs")
    taken = runs.groupBy("gap_id", "gap").agg(F.min("start").alias("first"), F.sum("size").alias("taken"))
    placed = runs.join(taken.select("gap_id", "first"), "gap_id").select(
        "id", F.col("gap_id").alias("sequence_id"), (F.lit(capacity) - F.col("gap") + F.col("start") - F.col("first")).cast("long").alias("offset"))
    pieces = state.filter("kind = 'p'").join(runs.select("id"), "id", "left_anti").select("kind", "id", "size")
    same = state.filter("kind = 'g'").join(taken.select(F.col("gap_id").alias("id")), "id", "left_anti").select("kind", "id", "size")
    smaller = taken.filter("gap > taken").select(F.lit("g").alias("kind"), F.col("gap_id").alias("id"), (F.col("gap") - F.col("taken")).cast("int").alias("size"))
    return write_table(pieces.union(same).union(smaller), "packing"), placed


def shortage(pieces: dict[int, int], gaps: dict[int, int]) -> int:
    """Size by which the gaps surely fall short of the pieces (both: size -> number): pieces of a size or more need gaps as large."""
    need, out = 0, 0
    for s in sorted(pieces, reverse=True):
        need += s * pieces[s]
        out = max(out, need - sum(g * n for g, n in gaps.items() if g >= s))
    return out


def _open(spark: SparkSession, state: DataFrame, counts: dict, capacity: int) -> tuple[DataFrame, DataFrame]:
    """Open sequences with the largest pieces: all above half a sequence (no
    two of them fit together, nor any gap if it is full already) at the start,
    and as many more as the free space falls short of. Later, when rounds place
    little though space is free, one in a hundred pieces at least opens one, but no
    more sequences open than the pieces left would fill."""
    histograms: dict[str, dict[int, int]] = {"p": {}, "g": {}}
    for r in state.groupBy("kind", "size").count().collect():  # at most ``capacity`` rows a kind
        histograms[r["kind"]][r["size"]] = r["count"]
    sizes, gaps = histograms["p"], histograms["g"]
    if counts["g"]:
        want = max(-(-shortage(sizes, gaps) // capacity), min(counts["p"] // 100, -(-counts["p_total"] // capacity)), 1)
    else:
        large = {s: n for s, n in sizes.items() if 2 * s > capacity}
        rest = sum(s * n for s, n in sizes.items()) - sum(s * n for s, n in large.items()) - sum((capacity - s) * n for s, n in large.items())
        want = max(sum(large.values()) + max(0, -(-rest // capacity)), 1)
    limit, above = 0, 0
    for s in sorted(sizes, reverse=True):
        if above + sizes[s] > want:
            limit = s
            break
        above += sizes[s]
    opens = (F.col("kind") == "p") & (F.col("size") > limit)
    if limit and want > above:  # of the pieces of the limit's size the first ones, or where that is many a share by hash
        last = (F.col("kind") == "p") & (F.col("size") == limit)
        if want - above <= FIRST_OPENED:
            opens = opens | (last & F.col("id").isin([r["id"] for r in state.filter(last).select("id").orderBy("id").limit(want - above).collect()]))
        else:
            opens = opens | (last & (F.pmod(F.xxhash64("id"), F.lit(2**40)) < int((want - above) / sizes[limit] * 2**40)))
    marked = write_table(state.withColumn("opens", opens), "opening")
    seeds = marked.filter("opens")
    new = seeds.select(F.lit("g").alias("kind"), "id", (F.lit(capacity) - F.col("size")).cast("int").alias("size"))
    after = marked.filter(~F.col("opens")).select("kind", "id", "size").union(new.filter("size > 0"))
    return write_table(after, "packing"), seeds.select("id", F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def pack_table(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    pieces = pieces_of(docs, tokenizer, end_id, capacity)
    placed = pack(pieces.select("id", "length"), capacity)
    return pieces.join(placed, "id").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
