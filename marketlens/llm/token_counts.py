"""How many texts hold each token: bounded tables from exact counts of all texts.

A token is a 64-bit hash; a function of the caller's gives the distinct tokens of
a text. They are counted in blocks of the hash range whose number grows with
the texts, and reach tasks as two tables of a bounded size: a bit for each slot
one of whose tokens repeats, and a byte for how frequent the most frequent
one is. A token without its bit is in no other text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.session import write_table

#: Texts that hold a token from which on it counts as frequent.
FREQUENT = 16
#: Powers of two: tokens counted by one task, and the largest tables of the statistics (bits, bytes: 16 and 8 MB).
BLOCK_BITS, MOST_REPEATS, MOST_LEVELS = 22, 27, 23

Tokens = Callable[[str | None], np.ndarray]


class Plan:
    """Sizes of the statistics, from the number of bytes of all texts.

    Tokens are known by their upper ``bits`` bits. Their range is cut into
    2^blocks blocks, each counted in one task; 2^repeats bits tell which repeat,
    2^levels bytes how frequent they are.
    """

    def __init__(self, size: int):
        likely = max(1, size // 6).bit_length()  # a word has about six bytes
        self.bits = min(64, max(40, likely + 12))
        self.blocks = max(0, likely - BLOCK_BITS)
        self.repeats = max(self.blocks + 3, min(MOST_REPEATS, max(16, likely + 1)))
        self.levels = max(self.blocks, min(MOST_LEVELS, max(13, likely - 2)))


def _squeeze(x: np.ndarray) -> bytes:
    """Numbers as all their lowest bytes, then all the next ones and so on, compressed: the upper ones are nearly all zero."""
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def _expand(raw: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _count(plan: Plan, of: Tokens):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(block, tokens, at, n): sorted distinct tokens of a batch as differences, and how often those at ``at`` occur."""
        for b in batches:
            sets = list(map(of, b.column("text").to_pylist()))
            token, n = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]) >> np.uint64(64 - plan.bits), return_counts=True)
            block = (token >> np.uint64(plan.bits - plan.blocks)).astype(np.int64) if plan.blocks else np.zeros(len(token), np.int64)
            edges = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
            out = []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                gaps = np.diff(token[lo:hi], prepend=np.uint64(0))
                wide = int(gaps[1:].max(initial=0)) >= 1 << 32
                at = np.flatnonzero(n[lo:hi] > 1)
                out.append((int(block[lo]), int(token[lo : lo + 1].view(np.int64)[0]), _squeeze(gaps[1:].astype("<u8" if wide else "<u4")), wide,
                            at.astype("<u4").tobytes(), n[lo:hi][at].astype("<u4").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _COUNTED, strict=True)], schema=_COUNTED)

    return f


_COUNTED = pa.schema([("block", pa.int64()), ("first", pa.int64()), ("gaps", pa.binary()), ("wide", pa.bool_()), ("at", pa.binary()), ("n", pa.binary())])


def _tables(plan: Plan):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by block: the block's slices of both tables."""
        held, tokens, counts = None, [], []

        def done() -> pa.RecordBatch:
            token, where = np.unique(np.concatenate(tokens), return_inverse=True)
            n = np.bincount(where, weights=np.concatenate(counts), minlength=len(token))
            token, n = token[n > 1], n[n > 1]
            bits = np.zeros(1 << (plan.repeats - plan.blocks), np.uint8)
            low = np.uint64(len(bits) - 1)
            bits[(token >> np.uint64(plan.bits - plan.repeats)) & low] = 1
            level = np.zeros(1 << (plan.levels - plan.blocks), np.uint8)
            often = n >= FREQUENT
            np.maximum.at(level, (token[often] >> np.uint64(plan.bits - plan.levels)) & np.uint64(len(level) - 1),
                          (np.log2(n[often] / FREQUENT) + 2).astype(np.uint8))
            return pa.RecordBatch.from_arrays([pa.array([held], pa.int64()), pa.array([np.packbits(bits).tobytes()], pa.binary()),
                                               pa.array([level.tobytes()], pa.binary())], names=["block", "repeats", "levels"])

        for b in batches:
            for block, first, gaps, wide, at, n in zip(*(b.column(c.name).to_pylist() for c in _COUNTED), strict=True):
                if block != held:
                    if held is not None:
                        yield done()
                    held, tokens, counts = block, [], []
                gaps = _expand(gaps, "<u8" if wide else "<u4")
                token = np.cumsum(np.concatenate([np.array([first]).view(np.uint64), gaps]), dtype=np.uint64)
                times = np.ones(len(token))
                times[np.frombuffer(at, "<u4")] = np.frombuffer(n, "<u4")
                tokens.append(token)
                counts.append(times)
        if held is not None:
            yield done()

    return f


class Levels:
    """0 for a token that one text holds, 1 for one that repeats, more by powers of two from ``FREQUENT`` texts on."""

    def __init__(self, plan: Plan, repeats: np.ndarray, levels: np.ndarray):
        self.plan, self.repeats, self.levels = plan, repeats, levels

    def of(self, s: np.ndarray) -> np.ndarray:
        at = s >> np.uint64(64 - self.plan.repeats)
        known = (self.repeats[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & np.uint8(1)
        return known * np.maximum(self.levels[s >> np.uint64(64 - self.plan.levels)], 1)


def token_levels(texts: DataFrame, of: Tokens, n: int) -> Levels:
    """``texts``: (text); ``n``: tasks that count."""
    plan = Plan(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    counted = texts.mapInArrow(_count(plan, of), "block long, first long, gaps binary, wide boolean, at binary, n binary")
    slices = counted.repartition(n, "block").sortWithinPartitions("block").mapInArrow(_tables(plan), "block long, repeats binary, levels binary")
    repeats, levels = np.zeros(1 << (plan.repeats - 3), np.uint8), np.zeros(1 << plan.levels, np.uint8)
    size, span = len(repeats) >> plan.blocks, len(levels) >> plan.blocks
    for block, bits, level in write_table(slices, "token-counts").collect():  # tables of a fixed size, however many tokens there are
        repeats[block * size : (block + 1) * size] = np.frombuffer(bits, np.uint8)
        levels[block * span : (block + 1) * span] = np.frombuffer(level, np.uint8)
    return Levels(plan, repeats, levels)
