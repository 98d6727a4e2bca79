"""Near-duplicate detection by Order MinHash, verified by banded alignment.

A text is its lower-case words; its k-mers are pairs of words, each
labelled with its occurrence number, so that repeats count. A sketch takes the
three k-mers smallest under its own hash that lie a fifth of the text apart,
and keeps them in text order: equal sketches need the same k-mers in the same
order, which makes them sensitive to edit distance, and the spacing keeps texts
that merely share a passage out of one another's buckets. The k-mers are short
so that texts at the threshold, with every fifth word another, still meet (the
README gives the share by edit similarity). Texts with an equal sketch are candidates; candidates are
verified by word edit distance in a band (similarity 1 - distance / longer
length, at least 0.8), and verified links form groups by connected components.

Equal texts are one node from the start (by md5), however many copies there
are. A bucket of equal sketches is cut by length and by place of the first
k-mer with overlapping cells: two texts within the threshold share at least
one cell. Each cell has a hub, its most central node. Every node is verified
against the most central of its hubs, then against the hubs of those cells whose hub
it is not connected with yet, so that a large group of copies costs about one pair
per member. What stays unconnected with a hub meets the nodes of other
components in that cell: all of them in a cell of up to ``SMALL`` nodes, in a
larger one those with a common word among the rarest of each. That filter
is exact: an edit changes at most one word, so texts within the threshold
share one of the first ones in any common order (see ``prefix_length``), and d edits
change at most 2 d bits of the parities of its words (see ``parities``). Cells are taken
together for it by the node that is in most of them, so that a text of a large group lists
its words about once, not once a cell; and it lists only words that texts of another component list there
too. Texts of one template that lie beyond the
threshold differ in their rare words or in more parities
and so do not meet, while no similar pair in a shared cell is left out.

Defined cases: null text is read as empty; empty texts are copies of each
other; a text of one word has one k-mer, that word; rows equal
in id and text count once, a null id comes after all others as the one that
stays; other columns are ignored or passed through, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlens.llm.common import few, partitions
from marketlens.llm.token_counts import Levels, token_levels
from marketlens.session import write_table

K = 2
SIMILARITY = 0.8
SKETCHES = 48
#: k-mers per sketch, and the share of the text that lies between any two of them.
SAMPLED = 3
SPACING = 1 / 5
#: Nodes in a cell up to which those not connected with its hub meet all of other components.
SMALL = 8
#: Pairs verified beside one copy of a hub's text.
BLOCK = 256
#: 64-bit numbers of a text's parities (see ``parities``).
PARITIES = 16
#: Powers of two: most slots of the table of lists that more than one component is in (bits: 16 MB), and slots that one task fills.
MOST_SLOTS, SLOTS_PER_TASK = 27, 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_MULTIPLIERS = _mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
#: Hash of a k-mer that is not to be sampled.
_NEVER = np.uint64(2**64 - 1)
_PLACES = _mix(np.arange(101, 101 + K, dtype=np.uint64) * _BASE) | np.uint64(1)


class _Powers:
    """Powers of the hash base, and of its inverse, as many as needed so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up, self.down


def word_hashes(text: str, powers: _Powers) -> np.ndarray:
    """A 64-bit hash of each word, from prefix sums of a polynomial over the bytes."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    inside = ~_SPACE[raw]
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = powers.get(len(raw) + 1)
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def labelled_kmers(words: np.ndarray, sampled: bool = True, k: int = K) -> np.ndarray:
    """Hashes of the k-mers, of ``k`` words, with their occurrence numbers, in text order.

    Of a k-mer's occurrences the 1st, 2nd, 4th, 8th ... can be ``sampled``, so that
    a run of one phrase, however long, weighs little in a sketch.
    """
    if len(words) < k:
        h = np.array([(words * _PLACES[: len(words)]).sum(dtype=np.uint64) + np.uint64(len(words))], np.uint64)
    else:
        h = np.zeros(len(words) - k + 1, np.uint64)
        for j in range(k):
            h += words[j : len(words) - k + 1 + j] * _PLACES[j]
    h = _mix(h)
    order = np.argsort(h, kind="stable")
    ordered = h[order]
    same = ordered[1:] == ordered[:-1]
    label = np.zeros(len(h), np.uint64)
    if same.any():
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        number = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
        label[order] = number
    h = _mix(h + label * _BASE)  # also where nothing repeats: a k-mer's first occurrence is the same in every text
    if sampled:
        h[(label & (label + np.uint64(1))) > 0] = _NEVER
    return h


def sketches(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place of the first k-mer) of each sketch."""
    h = labelled_kmers(words)
    n = min(SAMPLED, len(h))
    places = np.empty((SKETCHES, n), np.int64)
    gap = max(1, int(len(h) * SPACING))
    step = max(1, 2_000_000 // len(h))
    for lo in range(0, SKETCHES, step):  # a very long text takes its sketches one by one
        m = _MULTIPLIERS[lo : lo + step, None] * h
        m ^= m >> np.uint64(29)
        m[:, h == _NEVER] = _NEVER
        for j in range(n):
            at = m.argmin(axis=1)
            places[lo : lo + step, j] = at
            if j + 1 < n:
                for row, p in zip(m, at.tolist(), strict=True):
                    row[max(0, p - gap + 1) : p + gap] = _NEVER
    places.sort(axis=1)
    out = np.arange(1, SKETCHES + 1, dtype=np.uint64) * _BASE
    for j in range(places.shape[1]):
        out = _mix(out * np.uint64(3) + h[places[:, j]])
    return out.view(np.int64), places[:, 0]


# Alignment


def _bounds(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """Lower bound (words one text has and the other lacks) and upper bound
    (aligning words that occur once in both, in order) of the edit distance."""
    both = np.concatenate([x, y])
    _, code = np.unique(both, return_inverse=True)
    cx, cy = (np.bincount(c, minlength=code.max() + 1) for c in (code[: len(x)], code[len(x) :]))
    low = int(max(np.maximum(cx - cy, 0).sum(), np.maximum(cy - cx, 0).sum()))
    if len(x) == len(y):
        high = int((x != y).sum())
    else:
        high = max(len(x), len(y))
    single = (cx == 1) & (cy == 1)
    px, py = np.flatnonzero(single[code[: len(x)]]), np.flatnonzero(single[code[len(x) :]])
    if len(px):
        place = np.empty(len(cx), np.int64)
        place[code[len(x) :][py]] = py
        to = place[code[: len(x)][px]]
        good = _increasing(to)
        ax, ay = np.concatenate([[-1], px[good], [len(x)]]), np.concatenate([[-1], to[good], [len(y)]])
        gx, gy = np.diff(ax) - 1, np.diff(ay) - 1
        aligned = int(np.maximum(gx, gy).sum())
        for i in np.flatnonzero((gx == gy) & (gx > 0)):  # gaps of one length: only the words that differ
            a, b = ax[i] + 1, ay[i] + 1
            aligned -= int((x[a : a + gx[i]] == y[b : b + gx[i]]).sum())
        high = min(high, aligned)
    return low, high


def _increasing(values: np.ndarray) -> np.ndarray:
    """Indices of a longest increasing run of different values."""
    if (values[1:] > values[:-1]).all():
        return np.arange(len(values))
    tails: list[int] = []
    last: list[int] = []
    before = np.empty(len(values), np.int64)
    for i, v in enumerate(values.tolist()):
        at = bisect.bisect_left(tails, v)
        before[i] = last[at - 1] if at else -1
        if at == len(tails):
            tails.append(v)
            last.append(i)
        else:
            tails[at], last[at] = v, i
    out = [last[-1]]
    while before[out[-1]] >= 0:
        out.append(int(before[out[-1]]))
    return np.array(out[::-1])


def within(x: np.ndarray, y: np.ndarray, limit: int) -> bool:
    """Whether the edit distance of two word sequences is at most ``limit``."""
    if abs(len(x) - len(y)) > limit:
        return False
    n = min(len(x), len(y))
    differ = x[:n] != y[:n]
    head = int(differ.argmax()) if differ.any() else n
    x, y = x[head:], y[head:]
    n = min(len(x), len(y))
    differ = x[len(x) - n :][::-1] != y[len(y) - n :][::-1]
    tail = int(differ.argmax()) if n and differ.any() else n
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    if not len(x) or not len(y):
        return max(len(x), len(y)) <= limit
    low, high = _bounds(x, y)
    if low > limit or high <= limit:
        return low <= limit
    band = max(8, low, abs(len(x) - len(y)))
    while True:
        band = min(band, limit)
        if _banded(x, y, band) <= band:
            return True
        if band == limit:
            return False
        band *= 2


def _banded(x: np.ndarray, y: np.ndarray, band: int) -> int:
    """Edit distance with cells further than ``band`` off the diagonal left out."""
    far = len(x) + len(y) + 1
    width = 2 * band + 1
    offsets = np.arange(width)
    row = np.where(offsets >= band, offsets - band, far)  # cell (i, j) is at j - i + band
    padded = np.concatenate([np.zeros(band, np.uint64), y, np.zeros(2 * band + 1, np.uint64)])
    columns = np.arange(-band, band + 1)
    for i in range(1, len(x) + 1):
        j = columns + i
        near = padded[i - 1 : i - 1 + width]  # y[j - 1]
        new = row + (near != x[i - 1])
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new[(j < 0) | (j > len(y))] = far
        if i <= band:
            new[band - i] = i
        new = np.minimum.accumulate(new - offsets) + offsets
        row = new
    end = len(y) - len(x) + band
    return int(row[end])


def most_edits(longer: int) -> int:
    return int(np.floor(longer * (1 - SIMILARITY) + 1e-9))


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    longer = max(len(x), len(y))
    return within(x, y, most_edits(longer)) if longer else True


def prefix_length(words: int, k: int = K) -> int:
    """How many of a text's k-mers, first by any order common to all texts, hold one of every similar text's first ones.

    With d edits two texts share at least (longer text's k-mers - k d) k-mers.
    A text one word longer than this one can allow one edit more, which
    costs k shared k-mers and brings one: k - 1 beyond the k d + 1 for equal lengths.
    """
    return min(max(1, words - k + 1), k * most_edits(words) + k)


def parities(words: np.ndarray) -> np.ndarray:
    """A bit for each of 1024 slots: whether the words of that slot are odd in number.

    An edit that replaces a word changes at most two bits, one that adds or drops a word changes one.
    """
    slots = np.bincount((words >> np.uint64(54)).astype(np.int64), minlength=64 * PARITIES)
    return np.packbits((slots & 1).astype(np.uint8)).view(np.int64)


# Spark side


def _sketch_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, node, words, keys, places): one row per row of ``docs``."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for b in batches:
            node, words, keys, places = [], [], [], []
            for text in b.column("text").to_pylist():
                text = text or ""
                node.append(hashlib.md5(text.encode("utf-8", "replace")).digest())
                w = word_hashes(text, powers)
                k, p = sketches(w)
                words.append(len(w))
                keys.append(k)
                places.append(p)
            at = np.arange(0, SKETCHES * len(node) + 1, SKETCHES, dtype=np.int32)
            flat = [np.concatenate(c) if c else np.empty(0, np.int64) for c in (keys, places)]
            yield pa.RecordBatch.from_pydict({
                "id": b.column("id"), "node": pa.array(node, pa.binary()), "words": pa.array(words, pa.int64()),
                "keys": pa.ListArray.from_arrays(at, flat[0].astype(np.int64)), "places": pa.ListArray.from_arrays(at, flat[1].astype(np.int64)),
            })

    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(f, "id long, node binary, words long, keys array<long>, places array<long>")


def _cells(nodes: DataFrame) -> DataFrame:
    """(cell, node, n, rank): the cells, with at least two nodes, of equal
    sketches; n is the cell's size, rank orders its nodes, those that meet most
    others first: the text that a group of copies was made from, if there is one."""
    s = nodes.select("node", "words", F.explode(F.arrays_zip("keys", "places")).alias("s"))
    s = s.select("node", "words", F.col("s.keys").alias("key"), F.col("s.places").alias("place"))
    # lengths: class c holds [1.25^c, 1.25^(c+1)); a text joins its class and the next, so a ratio up to 1.25 shares one
    ratio = 1 / SIMILARITY
    s = s.withColumn("own", F.floor(F.log(F.greatest("words", F.lit(1))) / float(np.log(ratio)) + 1e-9))

    # places differ by at most the distance, (1 - similarity) of the longest length a class can hold;
    # two grids of twice that width, one shifted by half a cell
    def spot(place: Column, grid: Column, of: Column) -> Column:
        reach = F.pow(F.lit(ratio), of + 1) * (1 - SIMILARITY)
        return F.floor((place + grid * reach) / (2 * reach))

    low, high, top = F.col("low_place"), F.col("high_place"), F.col("top")
    one_spot = [spot(low, F.lit(g), top) == spot(high, F.lit(g), top) for g in (0, 1)]
    nodes_of = F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("set")
    shared = s.groupBy("key").agg(*nodes_of, F.min("own").alias("bottom"), F.max("own").alias("top"),
                                  F.min("place").alias("low_place"), F.max("place").alias("high_place")).filter("a <> b")
    # a bucket that one of its cells holds whole is that cell, its other cells hold no further pair; such buckets with the same
    # nodes (a group of copies has very many) are kept once
    shared = shared.withColumn("whole", (F.col("top") - F.col("bottom") <= 1) & (one_spot[0] | one_spot[1]))
    shared = shared.groupBy("a", "b", "n", "set", F.when(~F.col("whole"), F.col("key")).alias("cut")).agg(F.min("key").alias("key"))
    shared = shared.select("key", F.col("cut").isNull().alias("whole"))
    s = s.join(shared, "key")
    s = s.withColumn("class", F.explode(F.when(F.col("whole"), F.array(F.lit(0).cast("long"))).otherwise(F.array(F.col("own"), F.col("own") + 1))))
    s = s.withColumn("grid", F.explode(F.when(F.col("whole"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    s = s.withColumn("spot", F.when(F.col("whole"), F.lit(0).cast("long")).otherwise(spot(F.col("place"), F.col("grid"), F.col("class"))))
    cells = s.select(F.xxhash64("key", "class", "grid", "spot").alias("cell"), "node")
    # cells with the same nodes are kept once
    full = cells.groupBy("cell").agg(*nodes_of)
    once = full.filter("a <> b").groupBy("a", "b", "n", "set").agg(F.min("cell").alias("cell")).select("cell", "n")
    cells = write_table(cells.join(once, "cell"), "omh-cells")
    met = cells.groupBy("node").agg(F.sum("n").alias("met"))
    return cells.join(met, "node").select("cell", "node", "n", F.struct(-F.col("met"), F.col("node")).alias("rank"))


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (hub, block, kind): the hub's text, then the texts to compare it with."""
    powers = _Powers()
    mine = None
    for batch in batches:
        a, b, ok = [], [], []
        for hub, kind, node, text in zip(*(batch.column(c).to_pylist() for c in ("hub", "kind", "node", "text")), strict=True):
            w = word_hashes(text, powers)
            if kind == 0:
                mine = w
                continue
            a.append(min(hub, node))
            b.append(max(hub, node))
            ok.append(similar(mine, w))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])


def _verify(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """(a, b, ok), a < b, for distinct pairs (hub, node): a hub's text travels once for ``BLOCK`` of its pairs."""
    pairs = write_table(pairs, "omh-pairs")
    per_hub = pairs.groupBy("hub").agg(F.count("*").alias("pairs"))
    pairs = pairs.join(per_hub, "hub").withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("pairs") / BLOCK)))
    hubs = pairs.select("hub", "block").distinct().join(texts.withColumnRenamed("node", "hub"), "hub")
    rows = pairs.select("hub", "block", "node").join(texts, "node").select("hub", "block", F.lit(1).alias("kind"), "node", "text")
    rows = rows.unionByName(hubs.select("hub", "block", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("node"), "text"))
    rows = rows.repartition(n, "hub", "block").sortWithinPartitions("hub", "block", "kind").select("hub", "kind", "node", "text")
    return write_table(rows.mapInArrow(_compare_blocks, "a binary, b binary, ok boolean"), "omh-verified")


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root): the smallest node each linked node is connected with; ``rows``: about how many links, if known.

    Alternating stars: neighbours above a node are linked to the smallest
    neighbour, then neighbours below it, until nothing changes. A hub is a sum
    before the shuffle and a join that Spark may split. Edges never get more, so
    that their number tells how many tasks write the next ones.
    """
    edges = links.select("a", "b").distinct()
    edges = write_table(edges if rows is None else few(edges, rows), "omh-edges")
    state = F.count("*"), F.bit_xor(F.xxhash64("a", "b"))
    before = None
    while (now := edges.agg(*state).first()) != before:
        before = now
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        down = large.filter("a <> b").distinct()  # a above b
        least = down.groupBy("a").agg(F.min("b").alias("least"))
        small = down.join(least, "a").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        edges = write_table(few(small.union(least.select("a", F.col("least").alias("b"))).distinct().select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), now[0]), "omh-edges")
    roots = edges.groupBy("a").agg(F.min("b").alias("root"))
    roots = roots.withColumnRenamed("a", "node").union(roots.select("root", "root").distinct())
    return write_table(few(roots, 2 * now[0]), "omh-roots")


def _all_words(text: str | None) -> np.ndarray:
    return labelled_kmers(word_hashes(text or "", _Powers()), sampled=False, k=1)


def _rare_words(levels: Levels):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(node, words, parity, rare): a text's first words, rare ones first, that another text may hold."""
        powers = _Powers()
        for b in batches:
            words, parity, rare = [], [], []
            for text in b.column("text").to_pylist():
                w = word_hashes(text, powers)
                h = np.sort(labelled_kmers(w, sampled=False, k=1))
                level = levels.of(h)
                first = np.argsort(level, kind="stable")[: prefix_length(len(w), 1)]  # by level, then by hash
                words.append(len(w))
                parity.append(parities(w))
                rare.append(h[first][level[first] > 0].view(np.int64))
            at = np.concatenate([[0], np.cumsum([len(k) for k in rare])]).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"node": b.column("node"), "words": pa.array(words, pa.int64()),
                                              "parity": pa.array(parity, pa.list_(pa.int64())),
                                              "rare": pa.ListArray.from_arrays(at, np.concatenate([np.empty(0, np.int64), *rare]))})

    return f


def _by_near(members: DataFrame) -> DataFrame:
    """(near, node, root, is_rest): cells go by the node that is in most of them.

    Nodes of one cell share it, and a large group's cells mostly have the same one.
    """
    met = members.groupBy("node").agg(F.count("*").alias("met"))
    near = members.join(met, "node").groupBy("cell").agg(F.max_by("node", F.struct("met", "node")).alias("near"))
    return members.join(near, "cell").groupBy("near", "node").agg(F.any_value("root").alias("root"), F.max("is_rest").alias("is_rest"))


def _roots_of_slots(bits: int, blocks: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(block, slots, low, high): the slots of a batch's lists, with the smallest and the largest root of each."""
        for b in batches:
            lists = b.column("lists")
            slot = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits)
            if not len(slot):
                continue
            root = np.repeat(b.column("root").to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False))
            order = np.argsort(slot, kind="stable")
            slot, root = slot[order], root[order]
            first = np.flatnonzero(np.diff(slot, prepend=slot[0] + np.uint64(1)))
            low, high, slot = np.minimum.reduceat(root, first), np.maximum.reduceat(root, first), slot[first].astype("<u4")
            block = slot >> np.uint32(bits - blocks)
            edges = np.append(np.flatnonzero(np.diff(block.astype(np.int64), prepend=-1)), len(block)).tolist()
            spans = list(zip(edges[:-1], edges[1:], strict=True))
            yield pa.RecordBatch.from_pydict({"block": pa.array(block[edges[:-1]].astype(np.int64)),
                                              **{k: pa.array([v[i:j].tobytes() for i, j in spans], pa.binary()) for k, v in (("slots", slot), ("low", low), ("high", high))}})

    return f


def _slots_of_more_roots(bits: int, blocks: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by block: (block, bits), a bit for each of its slots, set where the roots differ."""
        held, size = None, 1 << (bits - blocks)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"block": pa.array([held], pa.int64()), "bits": pa.array([np.packbits(low < high).tobytes()], pa.binary())})

        for b in batches:
            for block, slots, lows, highs in zip(*(b.column(c).to_pylist() for c in ("block", "slots", "low", "high")), strict=True):
                if block != held:
                    if held is not None:
                        yield done()
                    held, low, high = block, np.full(size, np.iinfo(np.int64).max), np.full(size, np.iinfo(np.int64).min)
                at = np.frombuffer(slots, "<u4") & np.uint32(size - 1)  # a batch names a slot once
                low[at] = np.minimum(low[at], np.frombuffer(lows, np.int64))
                high[at] = np.maximum(high[at], np.frombuffer(highs, np.int64))
        if held is not None:
            yield done()

    return f


def _lists_of_more_roots(near: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """A bit for each of 2^bits slots, set if its lists hold nodes of more than one component; and ``bits``.

    A list, a 64-bit hash, is known by its upper ``bits`` bits: a slot of two lists may keep them without need.
    """
    entries = near.agg(F.sum(F.size("lists"))).first()[0] or 0
    bits = min(MOST_SLOTS, max(16, entries.bit_length() + 3))
    blocks = max(0, bits - SLOTS_PER_TASK)
    seen = near.select(F.xxhash64("root").alias("root"), "lists").mapInArrow(_roots_of_slots(bits, blocks), "block long, slots binary, low binary, high binary")
    seen = seen.repartition(n, "block").sortWithinPartitions("block").mapInArrow(_slots_of_more_roots(bits, blocks), "block long, bits binary")
    out, span = np.zeros(1 << (bits - 3), np.uint8), 1 << (bits - blocks - 3)
    for block, part in write_table(seen, "omh-slots").collect():  # a table of a bounded size, however many lists there are
        out[block * span : (block + 1) * span] = np.frombuffer(part, np.uint8)
    return out, bits


def _in_lists(slots: np.ndarray, bits: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The same rows with only those lists whose slot's bit is set."""
        for b in batches:
            lists = b.column("lists")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            slot = flat.view(np.uint64) >> np.uint64(64 - bits)
            keep = (slots[slot >> np.uint64(3)] >> (np.uint8(7) - (slot & np.uint64(7)).astype(np.uint8))) & np.uint8(1) == 1
            upto = np.concatenate([[0], np.cumsum(keep)])
            at = upto[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])].astype(np.int32)
            yield b.set_column(b.schema.get_field_index("lists"), "lists", pa.ListArray.from_arrays(at, pa.array(flat[keep], pa.int64())))

    return f


def _met_by_kmers(members: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """(hub, node): pairs of different components in a cell that share a rare word (a k-mer of one word).

    ``members``: (cell, node, root, is_rest), is_rest where the node is not connected with the cell's hub, as
    at least one node of every such pair is.
    """
    read = write_table(texts.join(members.select("node").distinct(), "node"), "omh-rest-texts")
    levels = token_levels(read.select("text"), _all_words, n)
    rare = write_table(read.repartition(n).mapInArrow(_rare_words(levels), "node binary, words long, parity array<long>, rare array<long>"), "omh-words")
    near = _by_near(members).join(rare, "node").select("node", "root", "words", "parity", "is_rest", F.transform("rare", lambda w: F.xxhash64("near", w)).alias("lists"))
    near = write_table(near, "omh-near")
    useful = near.mapInArrow(_in_lists(*_lists_of_more_roots(near, n)), near.schema)
    lists = write_table(useful.select("node", "root", "words", "parity", "is_rest", F.explode("lists").alias("list")), "omh-listed")
    full = lists.groupBy("list").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node", "is_rest")).alias("set"),
                                     F.min("root").alias("low"), F.max("root").alias("high"), F.max("is_rest").alias("rest")).filter("low <> high and rest")
    once = full.groupBy("a", "b", "n", "set").agg(F.min("list").alias("list")).select("list")  # lists with the same nodes: one of them
    lists = write_table(lists.join(once, "list", "left_semi"), "omh-lists")
    hubs = lists.filter("is_rest").select("list", F.col("node").alias("hub"), F.col("root").alias("hub_root"), F.col("words").alias("hub_words"),
                                           F.col("parity").alias("hub_parity"))
    close = F.least("words", "hub_words") >= SIMILARITY * F.greatest("words", "hub_words") - 1e-9
    apart = sum((F.bit_count(F.col("parity")[k].bitwiseXOR(F.col("hub_parity")[k])) for k in range(PARITIES)), F.abs(F.col("words") - F.col("hub_words")))
    close &= apart <= 2 * F.floor(F.greatest("words", "hub_words") * (1 - SIMILARITY) + 1e-9)
    wanted = (F.col("root") != F.col("hub_root")) & close & (~F.col("is_rest") | (F.col("hub") < F.col("node")))
    pairs = hubs.join(lists, "list").filter(wanted).select("hub", "node").distinct()
    # of them those that share a cell
    cells = members.groupBy("node").agg(F.collect_set("cell").alias("cells"))
    pairs = pairs.join(cells, "node").join(cells.select(F.col("node").alias("hub"), F.col("cells").alias("hub_cells")), "hub")
    return pairs.filter(F.arrays_overlap("cells", "hub_cells")).select("hub", "node")


def _undone(pairs: DataFrame, *done: DataFrame) -> DataFrame:
    """Distinct pairs (hub, node) that no table of ``done`` holds, either way round."""
    d = pairs.select("hub", "node", F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).dropDuplicates(["a", "b"])
    for t in done:
        d = d.join(t.select("a", "b"), ["a", "b"], "left_anti")
    return d.select("hub", "node")


def _with_roots(d: DataFrame, roots: DataFrame, node: str, root: str) -> DataFrame:
    return d.join(roots.select(F.col("node").alias(node), F.col("root").alias(root)), node, "left").withColumn(root, F.coalesce(root, node))


def _apart(ties: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, hub, root, hub_root): of the pairs (node, hub) those that are not connected."""
    return _with_roots(_with_roots(ties, roots, "node", "root"), roots, "hub", "hub_root").filter("root <> hub_root")


def groups(cells: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, root): the groups that verified links between nodes of one cell make."""
    n = partitions(cells.sparkSession)
    hubs = cells.groupBy("cell").agg(F.min("rank").alias("lead"))
    star = cells.join(hubs, "cell").select("cell", "node", "n", "lead", F.col("lead.node").alias("hub")).filter("node <> hub")
    star = write_table(star, "omh-star")
    ties = write_table(star.select("node", "hub").distinct(), "omh-ties")  # a large group's cells share their hub
    one = _verify(_undone(star.groupBy("node").agg(F.min("lead").alias("lead")).select(F.col("lead.node").alias("hub"), "node")), texts, n)
    roots = components(one.filter("ok"))
    two = _verify(_undone(_apart(ties, roots).select("hub", "node"), one), texts, n)
    if not two.filter("ok").isEmpty():
        roots = components(as_links(roots).union(two.filter("ok").select("a", "b")))
    left = star.join(_apart(ties, roots), ["node", "hub"])
    left = write_table(left.select("cell", "node", "n", "root"), "omh-left")
    if left.isEmpty():
        return roots
    # what is not connected with its hub meets the other components of the cell
    with_left = left.select("cell").distinct()
    members = write_table(_with_roots(cells.join(with_left, "cell", "left_semi").select("cell", "node", "n"), roots, "node", "root"), "omh-meet")
    few = left.filter(F.col("n") <= SMALL).select("cell", F.col("node").alias("hub"), F.col("root").alias("hub_root"))
    pairs = few.join(members.filter(F.col("n") <= SMALL), "cell").filter("root <> hub_root").select("hub", "node")
    large = left.filter(F.col("n") > SMALL)
    if not large.isEmpty():
        rest = large.select("cell", "node", F.lit(True).alias("is_rest"))
        meet = members.filter(F.col("n") > SMALL).join(rest, ["cell", "node"], "left").withColumn("is_rest", F.coalesce("is_rest", F.lit(False)))
        pairs = pairs.union(_met_by_kmers(meet, texts, n))
    more = _verify(_undone(pairs, one, two), texts, n).filter("ok")
    if more.isEmpty():
        return roots
    return components(as_links(roots).union(more.select("a", "b")))


def as_links(roots: DataFrame) -> DataFrame:
    return roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text and id: id, node, class_id, group_id, first.

    class_id is the smallest id with the same text, group_id the smallest id of
    the near-duplicate group, ``first`` whether this is the row of its group
    that stays.
    """
    rows = write_table(_sketch_rows(docs, id_col, text_col), "omh-sketches")
    per_id = rows.select("node", "id").distinct()
    order = F.struct(F.col("id").isNull(), F.col("id"))
    nodes = rows.groupBy("node").agg(F.min_by(F.struct("id", "words", "keys", "places"), order).alias("r")).select("node", "r.*")
    nodes = write_table(nodes, "omh-nodes")
    cells = write_table(_cells(nodes), "omh-ranked")
    needed = cells.select("node").distinct()
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    text = text.withColumn("node", F.unhex(F.md5("text")))
    owners = needed.join(nodes.select("node", "id"), "node")
    texts = text.join(owners, (text["node"] == owners["node"]) & text["id"].eqNullSafe(owners["id"])).select(owners["node"], "text")
    texts = write_table(texts.dropDuplicates(["node"]), "omh-texts")
    roots = groups(cells, texts)
    known = nodes.select("node", F.col("id").alias("class_id")).join(roots, "node", "left")
    known = known.withColumn("root", F.coalesce("root", "node"))
    order = F.struct(F.col("class_id").isNull(), F.col("class_id"), F.col("node"))
    heads = known.groupBy("root").agg(F.min_by(F.struct("class_id", "node"), order).alias("head"))
    known = known.join(heads, "root").select("node", "class_id", F.col("head.class_id").alias("group_id"),
                                             (F.col("head.node") == F.col("node")).alias("leads"))
    out = per_id.join(known, "node")
    return out.withColumn("first", F.col("leads") & F.col("id").eqNullSafe(F.col("class_id"))).drop("leads")


def membership(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, group_id, kept: one row per row of ``docs``."""
    d = near_duplicates(docs)
    rows = docs.select(F.col("doc_id"), F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("node"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("id")) & (rows["node"] == d["node"])
    return rows.join(d, same).select("doc_id", "class_id", "group_id", F.col("first").alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group: the one with the smallest id; columns as in ``docs``."""
    stay = write_table(near_duplicates(docs, id_col, text_col).filter("first").select("id", "node"), "omh-kept")
    d = docs.select(F.struct("*").alias("row")).withColumns({
        "row_id": F.col("row")[id_col].cast("long"), "row_node": F.unhex(F.md5(F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))))})
    d = d.join(stay, F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_node") == F.col("node")), "left_semi")
    # rows equal in id and text: one of them
    n = W.partitionBy("row_id", "row_node").orderBy(F.lit(1))
    return d.withColumn("n", F.row_number().over(n)).filter("n = 1").select("row.*")
