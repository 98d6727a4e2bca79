"""Token ids as a binary table, compressed by a Re-Pair grammar per shard.

Documents are range-sorted by id, encoded, and cut into shards of about
``SHARD_IDS`` ids (a document is never split). In a shard, rounds of Re-Pair
replace all pairs of neighbouring ids that are frequent enough by new symbols
(rules); a round's rules are the most frequent pairs, overlaps go to the left
pair. The file format of a shard, all integers little-endian:

    header   magic 'RPG1', then u32: first nonterminal, documents, rules,
             symbols, bytes per symbol (2 or 4), 0; then u64: ids
    doc ids  documents x i64, then documents x u8 (1: the id is null)
    lengths  documents x u32, ids of each document
    rules    rules x (left, right), in symbols; a rule uses earlier ones only
    expands  rules x u32, ids that each rule stands for
    symbols  the sequence

With the expansion lengths, the ids of any range are found by a binary search
over the running lengths of the symbols, and only the symbols that touch the
range are expanded (``Shard.read``).

A shard is one row of a Parquet table (part, shard, documents, ids, payload),
written by Spark into any store; parts are in doc_id order, so a document's
start is its shard's start plus its start in the shard.

Defined cases: null text is read as empty; every document ends with the end
id; documents with the same id are in the order of their texts; a null id
comes first; an empty table gives an empty table of shards.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlens.llm.common import partitions, text_or_empty
from marketlens.llm.tokens import encoder
from marketlens.session import scratch_path

SHARD_IDS = 1 << 20
#: A pair must occur this often to become a rule; a round may add this many rules;
#: rounds end when one saves less than this share of the symbols.
LEAST_COUNT = 8
RULES_PER_ROUND = 4096
LEAST_SAVED = 0.02
MAX_ROUNDS = 24

_HEAD = "<4s6IQ"
#: Bits of the slot table, which stays in the processor's cache.
_SLOTS = 16


def compress(ids: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(first nonterminal, rules as pairs, expansion lengths, symbols) of a sequence of ids."""
    base = int(ids.max()) + 1 if len(ids) else 0
    narrow = base < 60_000  # symbols of 16 bits, pairs of 32
    room = (65_536 if narrow else 2**32) - base
    wide, bits = (np.uint32, np.uint32(16)) if narrow else (np.uint64, np.uint64(32))
    mult, shift = (np.uint32(2654435761), np.uint32(32 - _SLOTS)) if narrow else (np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - _SLOTS))
    seq = ids.astype(wide)
    rules: list[np.ndarray] = []
    lengths = [np.ones(0, np.uint32)]
    made = 0
    for _ in range(MAX_ROUNDS):
        if len(seq) < 2 or room - made <= 0:
            break
        key = (seq[:-1] << bits) | seq[1:]
        ordered = np.sort(key)
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        count = np.diff(np.append(first, len(ordered)))
        often = np.flatnonzero(count >= LEAST_COUNT)
        if not len(often):
            break
        if len(often) > RULES_PER_ROUND:
            often = often[np.argpartition(-count[often], RULES_PER_ROUND - 1)[:RULES_PER_ROUND]]
        often = often[np.argsort(-count[often], kind="stable")]
        chosen = ordered[first[often]]
        # a table of slots finds a pair's rule; of pairs that share a slot the most frequent has it this round
        slot = (chosen * mult) >> shift
        _, at = np.unique(slot, return_index=True)
        at.sort()
        chosen, slot = chosen[at][: room - made], slot[at][: room - made]
        pair_of = np.zeros(1 << _SLOTS, key.dtype)
        rule_of = np.zeros(1 << _SLOTS, np.int32)
        pair_of[0] = 1  # an empty slot holds a pair that belongs to another: 0 to slot 0, 1 elsewhere
        pair_of[slot], rule_of[slot] = chosen, np.arange(len(chosen), dtype=np.int32)
        where = ((key * mult) >> shift).astype(np.int32)
        spots = np.flatnonzero(pair_of.take(where) == key)
        # runs of overlapping hits: every other one, from the left
        run = np.flatnonzero(np.concatenate([[True], np.diff(spots) > 1])) if len(spots) else spots
        nth = np.arange(len(spots)) - np.repeat(run, np.diff(np.append(run, len(spots))))
        spots = spots[nth % 2 == 0]
        rule = rule_of[where[spots]]
        keep = np.bincount(rule, minlength=len(chosen)) >= 2  # rules that overlaps left unused are not stored
        number = np.cumsum(keep) - 1
        spots, rule = spots[keep[rule]], number[rule[keep[rule]]]
        if not len(spots):
            break
        chosen = chosen[keep]
        pairs = np.stack([chosen >> bits, chosen & ((wide(1) << bits) - wide(1))], axis=1)
        known = np.concatenate(lengths)

        def expands(s: np.ndarray, known: np.ndarray = known) -> np.ndarray:
            out = np.ones(len(s), np.uint32)
            inner = s >= base
            out[inner] = known[s[inner].astype(np.int64) - base]
            return out

        lengths.append(expands(pairs[:, 0]) + expands(pairs[:, 1]))
        rules.append(pairs)
        seq[spots] = (rule + base + made).astype(wide)
        stay = np.ones(len(seq), bool)
        stay[spots + 1] = False
        before = len(seq)
        seq = seq[stay]
        made += len(chosen)
        if before - len(seq) < LEAST_SAVED * before:
            break
    pairs = np.concatenate(rules) if rules else np.empty((0, 2), wide)
    return base, pairs, np.concatenate(lengths), seq


def to_bytes(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    base, rules, expands, seq = compress(ids)
    kind = "<u2" if base + len(rules) <= 65_536 else "<u4"
    return b"".join([
        struct.pack(_HEAD, b"RPG1", base, len(doc_ids), len(rules), len(seq), int(kind[-1]), 0, len(ids)),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(),
        np.asarray(lengths, "<u4").tobytes(), rules.astype(kind).tobytes(), expands.astype("<u4").tobytes(), seq.astype(kind).tobytes(),
    ])


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... up to size[0] of them, then those of the next."""
    out = np.repeat(begin - np.cumsum(size) + size, size)
    out += np.arange(len(out))
    return out


class Shard:
    """A shard read from its bytes."""

    def __init__(self, payload: bytes):
        magic, self.base, docs, rules, symbols, width, _, self.ids = struct.unpack_from(_HEAD, payload)
        if magic != b"RPG1":
            raise ValueError("not a shard of token ids")
        at = struct.calcsize(_HEAD)

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        kind = f"<u{width}"
        ids, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if n else int(d) for d, n in zip(ids, null, strict=True)]
        self.lengths = take("<u4", docs)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths, dtype=np.int64)])
        self.rules = take(kind, 2 * rules).reshape(-1, 2).astype(np.int64)
        self.expands = take("<u4", rules)
        self.symbols = take(kind, symbols).astype(np.int64)
        size = np.ones(symbols, np.int64)
        inner = self.symbols >= self.base
        size[inner] = self.expands[self.symbols[inner] - self.base]
        self.upto = np.cumsum(size)
        self._table: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def _flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all single symbols and rules in one array, where each begins in it, and its length."""
        if self._table is None:
            size = np.concatenate([np.ones(self.base, np.int64), self.expands.astype(np.int64)])
            begin = np.cumsum(size) - size
            flat = np.empty(int(size.sum()), "<u4")
            flat[: self.base] = np.arange(self.base)
            todo, ready = np.arange(len(self.rules)), np.zeros(self.base + len(self.rules), bool)
            ready[: self.base] = True
            while len(todo):  # the rules whose two sides are expanded already
                now = ready[self.rules[todo]].all(axis=1)
                rules = todo[now]
                left, right = self.rules[rules].T
                to = begin[self.base + rules]
                for side, at in ((left, to), (right, to + size[left])):
                    flat[_ranges(at, size[side])] = flat[_ranges(begin[side], size[side])]
                ready[self.base + rules] = True
                todo = todo[~now]
            self._table = flat, begin, size
        return self._table

    def _expanded(self, seq: np.ndarray) -> np.ndarray:
        flat, begin, size = self._flat()
        return flat[_ranges(begin[seq], size[seq])]

    def read(self, start: int, n: int) -> np.ndarray:
        """Ids ``start`` to ``start + n`` of the shard, without expanding the others."""
        if n <= 0:
            return np.empty(0, "<u4")
        first = int(np.searchsorted(self.upto, start, side="right"))
        last = int(np.searchsorted(self.upto, start + n, side="left"))
        before = int(self.upto[first - 1]) if first else 0
        return self._expanded(self.symbols[first : last + 1])[start - before : start - before + n]

    def document(self, i: int) -> np.ndarray:
        return self.read(int(self.starts[i]), int(self.lengths[i]))

    def all(self) -> np.ndarray:
        return self._expanded(self.symbols)


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
                 shard_ids: int = SHARD_IDS) -> None:
    """Encode ``docs`` and write the shard table to ``path``."""
    n = partitions(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    d = d.repartitionByRange(n, "id", F.xxhash64("text")).sortWithinPartitions("id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, part, shard = encoder(tokenizer), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def row() -> pa.RecordBatch:
            lengths = np.array([len(h) // 4 for h in held], np.int64)
            payload = to_bytes(ids, lengths, np.frombuffer(b"".join(held), "<u4"))
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "documents": [len(ids)], "ids": [size], "payload": pa.array([payload], pa.binary())})

        for b in batches:
            for i, blob in zip(b.column("id").to_pylist(), enc.encode(b.column("text").to_pylist()), strict=True):
                ids.append(i)
                held.append(blob + end)
                size += len(blob) // 4 + 1
                if size >= shard_ids:
                    yield row()
                    ids, held, size, shard = [], [], 0, shard + 1
        if ids:
            yield row()

    d.mapInArrow(encode, "part int, shard int, documents long, ids long, payload binary").write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    shards = spark.read.schema("part int, shard int, documents long, ids long, payload binary").parquet(path)
    # one row per shard: running sums in two steps, within parts and over the parts
    sizes = shards.select("part", "shard", "ids")
    inner = sizes.withColumn("inner", F.sum("ids").over(W.partitionBy("part").orderBy("shard")) - F.col("ids"))
    parts = sizes.groupBy("part").agg(F.sum("ids").alias("part_ids"))
    parts = parts.withColumn("outer", F.sum("part_ids").over(W.orderBy("part")) - F.col("part_ids"))
    starts = inner.join(parts, "part").select("part", "shard", (F.col("inner") + F.col("outer")).alias("shard_start"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, shard, payload in zip(*(b.column(c).to_pylist() for c in ("part", "shard", "payload")), strict=True):
                s = Shard(payload)
                ids = memoryview(s.all().tobytes())
                crc = [zlib.crc32(ids[4 * a : 4 * z]) for a, z in zip(s.starts[:-1].tolist(), s.starts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part] * len(crc), pa.int32()), "shard": pa.array([shard] * len(crc), pa.int32()),
                    "doc_id": pa.array(s.doc_ids, pa.int64()), "local": s.starts[:-1], "n_tokens": s.lengths.astype(np.int64), "ids_crc32": pa.array(crc, pa.int64()),
                })

    rows = shards.select("part", "shard", "payload").mapInArrow(decode, "part int, shard int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "shard"]).select("doc_id", (F.col("local") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")


def encode_table(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` to a new folder under the shared scratch folder and read it back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-shards")
    write_shards(docs, path, tokenizer, end_id)
    return read_documents(spark, path)
