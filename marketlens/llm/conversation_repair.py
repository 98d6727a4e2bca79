"""Conversation structure repair: the cheapest edits that make a conversation alternate.

A conversation is a sequence of rows with roles; wanted are role initials
``(s?(ua)+)?``. The edit lattice has a node for each number of rows read and
each state of that pattern (nothing yet, after s, after u, after a). Keep,
Rerole and Delete read a row, Insert reads none. Dijkstra runs from both ends:
the forward heap from the start, the reverse heap from the accepting states at
the end. When their tops add up to more than the best crossing, every
equal-cost crossing has been met. From a node each letter leads to one node
only, so the least audit is read off the nodes that lie on cheapest paths by
taking the smallest letter at every step.

Spark sorts the rows by (conversation, turn) over range partitions, so that a
conversation of any size is spread over as many tasks as its rows need. One
that lies whole in a partition is repaired there. Of one that may cross a
partition's edge, or that is longer than ``BLOCK`` rows, each part gives the cheapest audit from every state to every
state; the parts are chained per conversation, and a last sorted pass hashes
the repaired rows as a stream. The hash of one conversation is sequential by
its definition; what is held for it is its audit, never its texts.

Defined cases: a null role or text is one space; a null conv_id is a
conversation of its own; null turns come first and are left out of gaps;
rows of one turn are ordered by role, then by the md5 of their text; an empty role
has no initial and cannot be kept; an empty table gives no rows; very long
texts pass through tasks one batch at a time; columns other than conv_id,
turn, role and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import partitions
from marketlens.session import write_table

#: Fixed values of the contract: costs of the edits, white space, ends of sentences.
RE_ROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
ENDS = ".!?"

#: States: nothing yet, after s, after u, after a. By state: the one of u / a that may follow, and where it leads.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
FOLLOWS = ("u", "u", "a", "u")
LEADS = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
ACCEPTING = (START, AFTER_A)
#: Rows of one conversation that are repaired at once; a longer one is repaired block by block, and the blocks chained.
BLOCK = 4096
LEGAL = {"su", "ua", "au"}
NAMES = {"u": "user", "a": "assistant"}

RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
          "audit string, repaired_sha256 string")
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


# The lattice. A row is (initial, must_go, truncated).


def _steps(row: tuple[str, bool, bool] | None, state: int) -> list[tuple[str, int, int, int]]:
    """(letter, rows read, next state, cost) of the edits at a node, smallest letter first."""
    out = [("I", 0, LEADS[state], INSERT)]
    if row is None:
        return out
    initial, must_go, cut = row
    out.insert(0, ("D", 1, state, DELETE))
    if not must_go:
        extra = TRUNCATED if cut else 0
        if initial == FOLLOWS[state]:
            out.append(("K", 1, LEADS[state], extra))
        elif initial == "s" and state == START:
            out.append(("K", 1, AFTER_S, extra))
        out.append(("R", 1, LEADS[state], RE_ROLE + extra))
    return out


def _back_steps(row: tuple[str, bool, bool] | None, state: int) -> list[tuple[int, int, int]]:
    """(rows read, state before, cost) of the edits that lead to a node; ``row`` is the one before it."""
    out = [(0, s, INSERT) for s in range(4) if LEADS[s] == state]
    if row is not None:
        for s in range(4):
            out += [(1, s, c) for _, read, to, c in _steps(row, s) if read and to == state]
    return out


def cheapest(rows: list[tuple[str, bool, bool]], source: int = START, targets: tuple[int, ...] = ACCEPTING) -> tuple[int, str] | None:
    """Least cost from (no row read, ``source``) to (all rows read, one of ``targets``), and the
    least audit of that cost; None if there is no way."""
    n = len(rows)
    far = [{source: 0}, {4 * n + t: 0 for t in targets}]  # node 4 * rows read + state
    heaps = [[(0, 0, source)], [(0, -n, 4 * n + t) for t in targets]]
    done: list[dict[int, int]] = [{}, {}]
    best = None
    while heaps[0] and heaps[1]:
        if best is not None and heaps[0][0][0] + heaps[1][0][0] > best:
            break
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        cost, _, node = heapq.heappop(heaps[side])
        if node in done[side]:
            continue
        done[side][node] = cost
        i, state = divmod(node, 4)
        if side == 0:
            near = [(4 * (i + read) + to, c) for _, read, to, c in _steps(rows[i] if i < n else None, state)]
        else:
            near = [(4 * (i - read) + s, c) for read, s, c in _back_steps(rows[i - 1] if i else None, state)]
        if node in far[1 - side]:
            best = _less(best, cost + far[1 - side][node])
        for to, c in near:
            if to not in far[side] or cost + c < far[side][to]:
                far[side][to] = cost + c
                place = to >> 2
                heapq.heappush(heaps[side], (cost + c, place if side == 0 else -place, to))
            if to in far[1 - side]:
                best = _less(best, cost + c + far[1 - side][to])
    if best is None:
        return None
    return best, _least_audit(rows, source, targets, best, done)


def _less(a: int | None, b: int) -> int:
    return b if a is None or b < a else a


def _least_audit(rows: list, source: int, targets: tuple[int, ...], best: int, done: list[dict[int, int]]) -> str:
    """The smallest letters along cheapest paths: forward up to a crossing, then by the reverse distances."""
    n, ahead, back = len(rows), done[0], done[1]

    def edges(node: int) -> list[tuple[str, int, int]]:
        i, state = divmod(node, 4)
        return [(x, 4 * (i + read) + to, c) for x, read, to, c in _steps(rows[i] if i < n else None, state)]

    ends = {4 * n + t for t in targets}
    # what is left from a node on a cheapest path; forward nodes in falling order, each after those it leads to
    left = {v: d for v, d in back.items()}
    for v in sorted(ahead, key=lambda v: (-ahead[v], -(v >> 2))):
        rest = best - ahead[v]
        if v in ends and rest == 0 or any(left.get(w) == rest - c for _, w, c in edges(v)):
            left[v] = rest
        elif v not in back:
            left.pop(v, None)
    out, node, rest = [], source, best
    while rest or node not in ends:
        for x, w, c in edges(node):
            if left.get(w) == rest - c:
                out.append(x)
                node, rest = w, rest - c
                break
        else:
            raise AssertionError("no cheapest edge")
    return "".join(out)


# One conversation


class Rows:
    """Counts and lattice rows of consecutive rows of one conversation."""

    def __init__(self) -> None:
        self.lattice: list[tuple[str, bool, bool]] = []
        self.turns = [None, None, 0]  # first, last, how many
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = None

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        body = text.rstrip(SPACES)
        blank, cut = not body, bool(body) and body[-1] not in ENDS
        if blank:
            self.blank += 1
        elif seen:
            self.duplicate += 1
        elif cut:
            self.truncated += 1
        if turn is not None and turn != self.turns[1]:
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn, self.turns[2] + 1]
        initial = role[:1]
        if self.last is not None and self.last + initial not in LEGAL:
            self.illegal += 1
        self.first, self.last = initial if self.first is None else self.first, initial
        self.lattice.append((initial, blank or seen, cut))

    def gaps(self) -> int:
        first, last, n = self.turns
        return 0 if first is None else min(last - first + 1 - n, 2**63 - 1)


class Repaired:
    """sha256 of the repaired rows, fed with the rows in order and their edits."""

    def __init__(self) -> None:
        self.state, self.any, self.hash = START, False, hashlib.sha256()

    def _put(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.any else "") + role + ":" + text).encode("utf-8", "replace"))
        self.any = True

    def inserts(self, edits: str, at: int) -> int:
        while at < len(edits) and edits[at] == "I":
            self._put(NAMES[FOLLOWS[self.state]], "")
            self.state = LEADS[self.state]
            at += 1
        return at

    def row(self, letter: str, role: str, text: str) -> None:
        if letter == "K":
            self._put(role, text)
            self.state = AFTER_S if role[:1] == "s" else LEADS[self.state]
        elif letter == "R":
            self._put(NAMES[FOLLOWS[self.state]], text)
            self.state = LEADS[self.state]


def repair(rows: list[tuple[int | None, str, str]]) -> tuple:
    """The result columns after conv_id, for rows (turn, role, text) in order."""
    r, seen = Rows(), set()
    for turn, role, text in rows:
        r.add(turn, role, text, (role, text) in seen)
        seen.add((role, text))
    cost, audit = cheapest(r.lattice)
    out, at = Repaired(), 0
    for _, role, text in rows:
        at = out.inserts(audit, at)
        out.row(audit[at], role, text)
        at += 1
    out.inserts(audit, at)
    return r.gaps(), r.blank, r.duplicate, r.truncated, r.illegal, cost, audit, out.hash.hexdigest()


# Spark side


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, live) after the stated damage; a dropped row stays as a mark that is not live."""
    d = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"),
                    F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                    F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    d = d.withColumn("kind", F.crc32(key) % 20)
    kind = F.col("kind")
    text = F.when(kind.isin(0, 1), F.lit("")).when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return d.select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
                    (kind != 0).alias("live"), F.explode(copies).alias("copy")).drop("copy")


def _batches(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class _Out:
    """Rows gathered into batches of a bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: tuple, size: int = 64) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size
        if self.size > 4_000_000:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield _batches(self.rows, self.schema)
            self.rows, self.size = [], 0


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


_SORTED = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("turn", pa.int64()), ("role", pa.string()),
                     ("text", pa.string()), ("live", pa.bool_()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
                     ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()),
                     ("repaired_sha256", pa.string())])
_SORTED_DDL = ("conv_id long, part int, seq long, turn long, role string, text string, live boolean, gaps long, blank long, "
               "duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
_NO_RESULT = (None,) * 8


def _repair_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of the conversations that start and end inside this partition; rows of its first, its last and its long ones as they are."""
    out, edge = _Out(_SORTED), True
    held: list[tuple] | None = None
    conv_held, seq = None, 0

    def as_rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        nonlocal seq
        for part, conv, turn, role, text, live in rows:
            yield from out.add((conv, part, seq, turn, role, text, live, *_NO_RESULT), 64 + len(text))
            seq += 1

    for conv, rows in groupby(_rows(batches), key=lambda r: r[1]):
        if held:
            result = repair([r[2:5] for r in held if r[5]])
            yield from out.add((conv_held, held[0][0], None, None, None, None, None, *result))
        conv_held, held = conv, None if edge else []
        for r in rows:
            if held is None:
                yield from as_rows([r])
                continue
            held.append(r)
            if len(held) > BLOCK:
                yield from as_rows(held)
                held = None
        edge = False  # only the first may have begun in the partition before
    if held:  # the last may go on in the next one
        yield from as_rows(held)
    yield from out.flush()


_PART = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("rows", pa.int64()), ("t_first", pa.int64()), ("t_last", pa.int64()),
                   ("t_n", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
                   ("first", pa.string()), ("last", pa.string()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])
_PART_DDL = ("conv_id long, part long, rows long, t_first long, t_last long, t_n long, blank long, duplicate long, truncated long, "
             "illegal long, first string, last string, costs array<long>, audits array<string>")


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation and partition: counts, and the cheapest audit from every state to every state."""
    out = _Out(_PART)
    for (conv, part), rows in groupby(_rows(batches), key=lambda r: (r[0], r[1])):
        r = Rows()
        for _, _, _, turn, role, text, live, seen in rows:
            if live:
                r.add(turn, role, text, seen)
        ways = [cheapest(r.lattice, a, (b,)) for a in range(4) for b in range(4)]
        costs = [-1 if w is None else w[0] for w in ways]
        audits = ["" if w is None else w[1] for w in ways]
        yield from out.add((conv, part, len(r.lattice), *r.turns, r.blank, r.duplicate, r.truncated, r.illegal, r.first, r.last, costs, audits),
                           64 + 16 * len(r.lattice))
    yield from out.flush()


_CHAIN = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("edits", pa.string()), ("gaps", pa.int64()), ("blank", pa.int64()),
                    ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])
_CHAIN_DDL = "conv_id long, part long, edits string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation: the cheapest way through its parts. One row per part with its edits; the first part's row has the result."""
    out = _Out(_CHAIN)
    for conv, rows in groupby(_rows(batches), key=lambda r: r[0]):
        parts = list(rows)
        # least (cost, audits) from each state to the end, from the last part back; audits as a chain of parts
        after: list[tuple | None] = [(0, None) if s in ACCEPTING else None for s in range(4)]
        for p in reversed(parts):
            costs, audits, now = p[12], p[13], []
            for a in range(4):
                best = None
                for b in range(4):
                    c = costs[4 * a + b]
                    if c < 0 or after[b] is None:
                        continue
                    way = (c + after[b][0], (audits[4 * a + b], after[b][1]))
                    if best is None or way[0] < best[0] or way[0] == best[0] and _joined(way[1]) < _joined(best[1]):
                        best = way
                now.append(best)
            after = now
        cost, chain = after[START]
        illegal = sum(p[9] for p in parts)
        last = first = before = None
        turns = 0
        for p in parts:
            if p[10] is not None:
                illegal += last is not None and last + p[10] not in LEGAL
                last = p[11]
            if p[3] is not None:
                first = p[3] if first is None else first
                turns += p[5] - (p[3] == before)
                before = p[4]
        gaps = 0 if first is None else min(before - first + 1 - turns, 2**63 - 1)
        result = (gaps, *(sum(p[i] for p in parts) for i in (6, 7, 8)), illegal, cost, _joined(chain))
        for p in parts:
            yield from out.add((conv, p[1], chain[0], *result), 64 + len(chain[0]))
            chain, result = chain[1], (None,) * 7
    yield from out.flush()


def _joined(chain: tuple | None) -> str:
    out = []
    while chain is not None:
        out.append(chain[0])
        chain = chain[1]
    return "".join(out)


_HASHED = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 per conversation of sorted rows; each part's rows follow a row with its edits (seq -1)."""
    out = _Out(_HASHED)
    for conv, rows in groupby(_rows(batches), key=lambda r: r[0]):
        sha, edits, at = Repaired(), "", 0
        for _, _, seq, role, text in rows:
            if seq < 0:
                sha.inserts(edits, at)
                edits, at = text, 0
                continue
            at = sha.inserts(edits, at)
            sha.row(edits[at], role, text)
            at += 1
        sha.inserts(edits, at)
        yield from out.add((conv, sha.hash.hexdigest()))
    yield from out.flush()


def _nulls_first(*names: str) -> list[Column]:
    return [F.col(n).asc_nulls_first() for n in names]


def repair_table(conversations: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per conv_id of ``conversations``: gaps, counts of faults, cost, audit and hash of the cheapest repair.

    ``parts`` is the number of range partitions (the session's shuffle partitions unless given).
    """
    n = parts or partitions(conversations.sparkSession)
    order = _nulls_first("conv_id", "turn", "role", "digest")
    d = damage(conversations).withColumns({"digest": F.md5("text"), "tie": F.monotonically_increasing_id()})
    d = d.repartitionByRange(n, *order, "tie").sortWithinPartitions(*order)
    d = d.select(F.spark_partition_id().alias("part"), "conv_id", "turn", "role", "text", "live")
    done = write_table(d.mapInArrow(_repair_partition, _SORTED_DDL), "conv-sorted")
    whole = done.filter("seq is null").select(*COLUMNS)
    block = (F.shiftleft(F.col("part").cast("long"), 32) + F.floor(F.col("seq") / BLOCK)).alias("part")
    edge = done.filter("seq is not null").select("conv_id", block, "seq", "turn", "role", "text", "live")
    # a row is a duplicate if its conversation holds an earlier one of its role and text, in whatever part
    edge = edge.withColumn("digest", F.md5(F.concat_ws("\0", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), "role", "text")))
    first = edge.filter("live").groupBy("digest").agg(F.min(F.struct("part", "seq")).alias("first"))
    edge = edge.join(first, "digest", "left").withColumn("seen", F.coalesce(F.struct("part", "seq") > F.col("first"), F.lit(False)))
    by_part = edge.select("conv_id", "part", "seq", "turn", "role", "text", "live", "seen").repartition(n, "conv_id", "part")
    by_part = by_part.sortWithinPartitions(*_nulls_first("conv_id", "part", "seq"))
    summary = by_part.mapInArrow(_summarise, _PART_DDL).repartition(n, "conv_id").sortWithinPartitions(*_nulls_first("conv_id", "part"))
    chain = write_table(summary.mapInArrow(_chain, _CHAIN_DDL), "conv-chained")
    rows = edge.filter("live").select("conv_id", "part", "seq", "role", "text")
    rows = rows.unionByName(chain.select("conv_id", "part", F.lit(-1).cast("long").alias("seq"), F.lit("").alias("role"), F.col("edits").alias("text")))
    rows = rows.repartition(n, "conv_id").sortWithinPartitions(*_nulls_first("conv_id", "part", "seq"))
    hashed = rows.mapInArrow(_hash_rows, "conv_id long, repaired_sha256 string")
    chain = chain.filter("audit is not null").withColumnRenamed("conv_id", "id")
    crossed = chain.join(hashed, F.col("id").eqNullSafe(F.col("conv_id"))).select(*COLUMNS)
    return whole.unionByName(crossed)
