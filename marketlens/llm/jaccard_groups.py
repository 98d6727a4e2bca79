"""Similarity join on word shingles by a grouped prefix join: exact components of the Jaccard links.

A document's set holds the 64-bit hashes of its distinct shingles of ``WORDS``
words. Documents of one set are one node. All shingles share one order: those that
one set holds first, then those that repeat, then the frequent ones by powers
of two, and by hash within. Sets that link
have a shingle in common among the first n - ceil(0.85 n) + 1 of each (the
prefix), at places that leave enough of both sets behind them.

Nodes of equal prefix and size form a group, and the join runs on groups: for
every prefix shingle the list of groups that hold it. The group of a list that
meets most others is its leader; the heads of the other groups are verified
against the leader's head, the nodes of a group against its head. Groups whose
heads are connected with the leader's are done in that list, the others go on with a
new leader while most of a round's pairs link. At last group pairs
of different components that pass the filter are expanded, and their
members verified. A pair is left out only if its nodes are connected already or
if the filter shows that they cannot link, so that the components are those
of all links, and a cluster of m near copies costs about m verifications.

Statistics: all shingles are counted exactly, in blocks of the hash range whose
number grows with the texts. They reach tasks as two tables of a bounded size:
a bit for each slot one of whose shingles repeats, and a byte for how
frequent the most frequent one is. Shingles that share a slot may rank later than
they should, which costs time and changes no result: one without its bit
is in no other set, so prefixes need not list it.

Defined cases: texts that are null or without words have an empty set and their own id
as component; fewer words than a shingle has are one shingle; case is folded
for A-Z only; every row gets a row, also with a repeated or null
doc_id (a null one is never a component's id unless all of its are null); an
empty table gives no rows; a very long text is one row's numpy arrays; columns
other than the two named are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import few, partitions
from marketlens.llm.order_minhash import as_links, components
from marketlens.llm.token_counts import Levels, token_levels
from marketlens.session import write_table

#: Fixed values of the contract: words of a shingle, and the least similarity in percent.
WORDS, PERCENT = 4, 85
#: Pairs verified beside one copy of a hub's text.
BLOCK = 256
#: Another round of leaders follows while this part of the round's pairs linked.
SETTLED = 0.5
#: Texts, or pairs of them, that one task writes.
TEXTS_PER_TASK = 1_000

_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles; ASCII white space separates words, A-Z are folded."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if 0 < len(w) < WORDS:
        return _mix((w * _PLACES[: len(w)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(w)))
    n = max(0, len(w) - WORDS + 1)
    h = np.full(n, WORDS, np.uint64)
    for j in range(WORDS):
        h += w[j : n + j] * _PLACES[j]
    return np.unique(_mix(h))


def prefix_length(n: int) -> int:
    return n - (PERCENT * n + 99) // 100 + 1


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets (sorted hashes) link."""
    if min(len(x), len(y)) * 100 < PERCENT * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


# Nodes and groups


def _read_sets(levels: Levels):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(row, doc_id, n, node, group, tokens, places): the prefix shingles that some other set may hold."""
        for b in batches:
            size, node, group, tokens, places = [], [], [], [], []
            for s in map(shingles, b.column("text").to_pylist()):
                n = len(s)
                size.append(n)
                node.append(hashlib.md5(s.tobytes()).digest() if n else None)
                level = levels.of(s)
                order = np.argsort(level, kind="stable")[: prefix_length(n) if n else 0]  # by level, then by hash
                group.append(int.from_bytes(hashlib.blake2b(s[order].tobytes(), digest_size=8).digest(), "little", signed=True))
                shared = np.flatnonzero(level[order])
                tokens.append(s[order][shared].view(np.int64))
                places.append((shared + 1).astype(np.int32))
            at = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "row": b.column("row"), "doc_id": b.column("doc_id"), "n": pa.array(size, pa.int32()), "node": pa.array(node, pa.binary()),
                "group": pa.array(group, pa.int64()), "tokens": pa.ListArray.from_arrays(at, np.concatenate([np.empty(0, np.int64), *tokens])),
                "places": pa.ListArray.from_arrays(at, np.concatenate([np.empty(0, np.int32), *places]))})

    return f


_SETS = "row long, doc_id long, n int, node binary, `group` long, tokens array<long>, places array<int>"


def _may_link(n: str, i: str, m: str, j: str) -> Column:
    """Whether sets of sizes n and m with a first common shingle at places i and j can share enough."""
    least = F.floor((F.lit(PERCENT) * (F.col(n) + F.col(m)) + (99 + PERCENT)) / F.lit(100 + PERCENT))
    return F.least(F.col(n) - F.col(i), F.col(m) - F.col(j)) + 1 >= least


# Texts of some rows

#: Powers of two: the most bits that mark rows (16 MB), and bits of them made by one task.
MOST_MARKS, BLOCK_MARKS = 27, 20


def _mark_blocks(bits: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(block, marks) from rows (block, hash) sorted by block."""
        held, marks = None, np.zeros(1 << min(bits, BLOCK_MARKS), np.uint8)
        for b in batches:
            block, at = b.column("block").to_numpy(), b.column("hash").to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            edges = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if held is not None and held != block[lo]:
                    yield pa.RecordBatch.from_pydict({"block": pa.array([held], pa.int64()), "marks": pa.array([np.packbits(marks).tobytes()], pa.binary())})
                    marks[:] = 0
                held = int(block[lo])
                marks[at[lo:hi] & np.uint64(len(marks) - 1)] = 1
        if held is not None:
            yield pa.RecordBatch.from_pydict({"block": pa.array([held], pa.int64()), "marks": pa.array([np.packbits(marks).tobytes()], pa.binary())})

    return f


def marked(d: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """The rows of ``d`` whose number ``row`` may be in ``rows``: all that are, and few others.

    A bit for each slot of hashed numbers reaches the tasks, at most 2^``MOST_MARKS`` of them, so that the
    texts of other rows need not be shuffled to find those of these.
    """
    bits = min(MOST_MARKS, max(16, (16 * rows.count()).bit_length()))
    blocks = max(0, bits - BLOCK_MARKS)
    hashed = rows.select(F.shiftrightunsigned(F.shiftrightunsigned(F.xxhash64("row"), 63 - blocks), 1).alias("block"), F.xxhash64("row").alias("hash"))
    made = hashed.repartition(n, "block").sortWithinPartitions("block").mapInArrow(_mark_blocks(bits), "block long, marks binary")
    marks = np.zeros(1 << (bits - 3), np.uint8)
    size = len(marks) >> blocks
    for block, some in made.collect():  # a table of a bounded size
        marks[block * size : (block + 1) * size] = np.frombuffer(some, np.uint8)

    @F.arrow_udf("boolean")
    def is_marked(h: pa.Array) -> pa.Array:
        at = h.to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits)
        return pa.array(((marks[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & np.uint8(1)).astype(bool))

    return d.filter(is_marked(F.xxhash64("row")))


# Verification


def _verify_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (hub, block, kind): the hub's text, then the texts to compare it with."""
    mine = None
    for b in batches:
        hubs, nodes, ok = [], [], []
        for hub, kind, node, text in zip(*(b.column(c).to_pylist() for c in ("hub", "kind", "node", "text")), strict=True):
            s = shingles(text)
            if kind == 0:
                mine = s
                continue
            hubs.append(hub)
            nodes.append(node)
            ok.append(linked(mine, s))
        yield pa.RecordBatch.from_arrays([pa.array(hubs, pa.binary()), pa.array(nodes, pa.binary()), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])


def verify(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """(a, b, ok) for pairs (hub, node): a hub's text travels once for ``BLOCK`` of its pairs, not with each."""
    pairs = write_table(pairs, "jaccard-pairs")  # read three times below
    found = pairs.count()
    per_hub = pairs.groupBy("hub").agg(F.count("*").alias("pairs"))
    pairs = pairs.join(per_hub, "hub").withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("pairs") / BLOCK)))
    hubs = pairs.select("hub", "block").distinct().join(texts.withColumnRenamed("node", "hub"), "hub")
    rows = pairs.select("hub", "block", "node").join(texts, "node").select("hub", "block", F.lit(1).alias("kind"), "node", "text")
    rows = rows.unionByName(hubs.select("hub", "block", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("node"), "text"))
    rows = rows.repartition(n, "hub", "block").sortWithinPartitions("hub", "block", "kind").select("hub", "kind", "node", "text")
    return write_table(few(rows.mapInArrow(_verify_blocks, "a binary, b binary, ok boolean"), found, TEXTS_PER_TASK), "jaccard-verified")


def _new(pairs: DataFrame, done: DataFrame | None) -> DataFrame:
    """Distinct pairs (hub, node) that ``done`` does not hold, either way round."""
    pairs = pairs.select("hub", "node").distinct()
    if done is None:
        return pairs
    known = done.select(F.col("a").alias("hub"), F.col("b").alias("node"))
    return pairs.join(known.union(known.select("node", "hub")), ["hub", "node"], "left_anti")


def links(nodes: DataFrame, lists: DataFrame, texts: DataFrame, n: int, entries: int) -> DataFrame:
    """(node, root) of the components of all links.

    ``nodes``: (node, group, n); ``lists``: (token, group, n, place); ``entries``: the most entries that lists of nodes have.
    """
    heads = nodes.groupBy("group", "n").agg(F.min("node").alias("head"))
    met = lists.groupBy("token").agg(F.count("*").alias("met")).join(lists, "token").groupBy("group", "n").agg(F.sum("met").alias("met"))
    lists = write_table(few(lists.join(met, ["group", "n"]).join(heads, ["group", "n"]), entries), "jaccard-lists")
    inside = nodes.join(heads, ["group", "n"]).filter("node <> head").select(F.col("head").alias("hub"), "node")
    left, done, roots, held = lists, None, None, lists.count()
    while True:
        lead = left.groupBy("token").agg(F.min_by(F.struct("head", "n", "place"), F.struct(-F.col("met"), F.col("head"))).alias("lead"))
        star = left.join(lead, "token").withColumns({"m": F.col("lead.n"), "there": F.col("lead.place"), "hub": F.col("lead.head")})
        star = write_table(few(star.filter(F.col("head") != F.col("hub")), held), "jaccard-star")
        todo = star.filter(_may_link("n", "place", "m", "there")).select("hub", F.col("head").alias("node"))
        new = _new(todo if done is not None else todo.union(inside), done)
        new = verify(few(new, entries), texts, n)
        done = new if done is None else done.union(new)
        tried, hits = new.agg(F.count("*"), F.count_if("ok")).first()
        linked_now = new.filter("ok").select("a", "b")
        if roots is None:
            roots = components(linked_now, hits)
        elif hits:
            roots = components(linked_now.union(as_links(roots)), hits + entries)
        head_root = roots.select(F.col("node").alias("head"), "root")
        hub_root = roots.select(F.col("node").alias("hub"), F.col("root").alias("hub_root"))
        star = star.join(head_root, "head", "left").join(hub_root, "hub", "left")
        star = star.filter(F.coalesce("root", "head") != F.coalesce("hub_root", "hub"))
        left = write_table(few(star.select(*lists.columns), held), "jaccard-left")
        held = left.count()
        if hits < SETTLED * tried or tried == 0 or held == 0:
            break
    # members: what is not in a list's largest component meets the list's nodes of other components
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    places = write_table(few(lists.select("token", "group", "n", "place").join(rooted, ["group", "n"]), entries), "jaccard-members")
    by_root = places.groupBy("token", "root").agg(F.count("*").alias("of"))
    major = by_root.groupBy("token").agg(F.max_by("root", F.struct("of", "root")).alias("major"), F.count("*").alias("roots")).filter("roots > 1")
    places = places.join(major, "token")
    minor = places.filter("root <> major").select("token", F.col("node").alias("hub"), F.col("root").alias("hub_root"), F.col("n").alias("m"),
                                                  F.col("place").alias("there"))
    pairs = minor.join(places, "token").filter((F.col("root") != F.col("hub_root")) & ((F.col("root") == F.col("major")) | (F.col("hub") < F.col("node")))
                                               & _may_link("n", "place", "m", "there"))
    more = verify(_new(pairs, done), texts, n).filter("ok")
    found = more.count()
    return components(as_links(roots).union(more.select("a", "b")), found + entries) if found else roots


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, class_id: one row per row of ``docs``.

    class_id is the smallest id with the same set, component_id the smallest id that links lead to.
    """
    n = partitions(docs.sparkSession)
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                    F.col(text_col).cast("string").alias("text"))
    levels = token_levels(d.select("text"), shingles, n)
    rows = write_table(d.mapInArrow(_read_sets(levels), _SETS), "jaccard-sets")
    sets = rows.filter("n > 0").select("node", "group", "n", "row", "tokens", "places")
    sets = sets.groupBy("node").agg(F.min_by(F.struct("group", "n", "row", "tokens", "places"), "row").alias("r")).select("node", "r.*")
    sets = write_table(few(sets, rows.count()), "jaccard-nodes")
    held = sets.agg(F.count("*"), F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()
    entries = sum(held)  # of lists, if each node has its own and one more
    groups = sets.groupBy("group", "n").agg(F.any_value("tokens").alias("tokens"), F.any_value("places").alias("places"))
    lists = groups.select("group", "n", F.explode(F.arrays_zip("tokens", "places")).alias("t"))
    lists = write_table(few(lists.select(F.col("t.tokens").alias("token"), "group", "n", F.col("t.places").alias("place")), entries), "jaccard-prefixes")
    shared = lists.groupBy("token").agg(F.count("*").alias("held")).filter("held > 1").select("token")
    lists = write_table(few(lists.join(shared, "token", "left_semi"), entries), "jaccard-shared")
    several = sets.groupBy("group", "n").agg(F.count("*").alias("held")).filter("held > 1").select("group", "n")
    some = lists.select("group", "n").union(several).distinct()
    nodes = write_table(few(sets.select("node", "group", "n", "row").join(some, ["group", "n"]), held[0]), "jaccard-some")
    texts = marked(d.select("row", "text"), nodes.select("row"), n)
    texts = texts.join(nodes.select("row", "node"), "row").select("node", "text")
    texts = write_table(few(texts, nodes.count(), TEXTS_PER_TASK), "jaccard-texts")
    # groups of several nodes are in no list if none of their shingles is in another group: a list of their own
    alone = several.join(lists.select("group", "n").distinct(), ["group", "n"], "left_anti")
    lists = lists.unionByName(alone.select(F.col("group").alias("token"), "group", "n", F.lit(1).alias("place")))
    roots = links(nodes.select("node", "group", "n"), lists, texts, n, entries)
    ids = rows.groupBy("node").agg(F.min("doc_id").alias("class_id")).filter("node is not null")
    ids = ids.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = ids.groupBy("root").agg(F.min("class_id").alias("component_id"))
    ids = ids.join(least, "root").select("node", "class_id", "component_id")
    out = rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "node")
    some = out.filter("node is not null").join(ids, "node").select("doc_id", "n_shingles", "component_id", "class_id")
    none = out.filter("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"))
    return some.unionByName(none)


#: DuckDB form over ``documents``, for tables whose pairs of documents with a common shingle fit in memory.
COMPONENTS_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM both_ JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(c.b, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = w.doc_id
"""
