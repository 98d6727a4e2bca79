"""Alignment of the token streams of two tokenizers over the same bytes.

Tokenizer A (byte-level BPE) reads a space and the text, tokenizer B
(sentencepiece, which adds the space itself) the text. Where tokens of both
end at one byte the streams are cut into groups; a link is a pair of tokens,
one of each, whose byte ranges overlap.

The alignment of a byte range is a fragment: an open prefix (tokens up to the
range's first cut), closed groups, and an open suffix (tokens after its last
cut); a range without a cut is all open. Fragments compose: left suffix and
right prefix close into one group. That operation is associative, so a
document longer than ``RANGE`` bytes is cut into byte ranges, wherever they
fall, its ranges are encoded by different tasks, and a tree of shuffles
composes ``FAN`` neighbours at a time until one fragment is left. Closed groups
leave the tree as soon as they close and are hashed as a sorted stream.

Both tokenizers start a new token at a single space between two characters
that are no white space (A by its pattern, B because no piece holds a space
after anything else), so a text is a sequence of units that are encoded once
each. Documents of a part (a bounded run of a task's rows) refer to a table of
its units and their id pairs; pairs are counted by part, then over the corpus,
and each part's documents meet the corpus-wide counts of its pairs.
So the shuffles carry distinct pairs of parts, not links.

Defined cases: a text that is null or empty, or that either tokenizer does not
give back byte for byte, has no tokens: zeros and an empty digest; it adds
nothing to the counts. Strings of special tokens are plain text. Every row
counts, also with a repeated or null doc_id; an empty table gives no
rows; columns other than the two named are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
import sys
import types
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import partitions
from marketlens.session import write_table

#: Bytes of a range of a long document, and fragments composed at a time.
RANGE = 1 << 16
FAN = 8
#: A part ends after so many occurrences of units, or when the worker's table of units is full; then
#: the units that were met first stay in the table, as the frequent ones are among them.
PART_UNITS = 2_000_000
KNOWN_UNITS = 300_000
KEPT_UNITS = 150_000
#: Characters of new units encoded as one text.
CHARS = 20_000

_ODD = re.compile(r"^ |\s | (?:\s|\Z)")
_BREAK = re.compile(r"(?<=\S) (?=\S)")
_LOW = 0xFFFFFFFF


def units(text: str) -> list[str]:
    """The text cut at every single space between characters that are no white space."""
    return _BREAK.split(text) if _ODD.search(text) else text.split(" ")


# Tokenizers


def _byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoders:
    """Both tokenizers: token ids of units, and the bytes that each id stands for."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        to_byte = _byte_level()
        vocab = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(map(to_byte.__getitem__, token))
        self.bytes_b = []
        for i in range(self.b.vocab_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.sizes_a, self.sizes_b = (np.array(list(map(len, t)), np.int64) for t in (self.bytes_a, self.bytes_b))
        # by unit: its number; by number: whether it has tokens, tokens of A and of B and groups, text of its groups, end of its links
        self.known: dict[str, int] = {}
        self.good, self.tokens, self.texts, self.links = bytearray(), array("i"), [], array("q")
        self.link_ends = array("q", [0])

    def forget(self, kept: int) -> None:
        """Drop all units but those met first."""
        for w in list(islice(reversed(self.known), max(0, len(self.known) - kept))):
            del self.known[w]
        del self.good[kept:], self.tokens[3 * kept :], self.texts[kept:], self.link_ends[kept + 1 :]
        del self.links[self.link_ends[-1] :]

    def _ids(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A for a space and ``text``, of B for ``text``; None if one does not give the bytes back."""
        raw = (" " + text).encode("utf-8", "replace")
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        if b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of consecutive units, a bounded number of characters at a time."""
        a, b, held, size = [], [], [], 0
        for i, w in enumerate(words):
            held.append(w)
            size += len(w) + 1
            if size >= CHARS or i + 1 == len(words):
                ids = self._ids(" ".join(held))
                if ids is None:
                    return None
                a.append(ids[0])
                b.append(ids[1])
                held, size = [], 0
        return np.concatenate(a), np.concatenate(b)

    def _learn_run(self, words: list[str]) -> None:
        ids = self._ids(" ".join(words))
        if ids is None and len(words) > 1:
            for w in words:
                self._learn_run([w])
            return
        if ids is None:
            self._keep(words[0], False, (0, 0, 0), b"", np.empty(0, np.int64))
            return
        a, b = ids
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        stops = np.cumsum([len(w.encode("utf-8", "replace")) + 1 for w in words])
        texts, cuts, links, ends = closed_groups(a, ends_a, b, ends_b)
        at_a, at_b, at_g, at_l = (np.searchsorted(e, stops, "right").tolist() for e in (ends_a, ends_b, cuts, ends))
        i = j = g = k = 0
        for w, i2, j2, g2, k2 in zip(words, at_a, at_b, at_g, at_l, strict=True):
            self._keep(w, True, (i2 - i, j2 - j, g2 - g), ";".join(texts[g:g2]).encode(), links[k:k2])
            i, j, g, k = i2, j2, g2, k2

    def _keep(self, word: str, good: bool, tokens: tuple[int, int, int], text: bytes, links: np.ndarray) -> None:
        self.known[word] = len(self.texts)
        self.good.append(good)
        self.tokens.extend(tokens)
        self.texts.append(text)
        self.links.frombytes(links.tobytes())
        self.link_ends.append(len(self.links))

    def learn(self, words: set[str]) -> None:
        """Put units not met before into the tables; those that white space begins or ends are encoded alone."""
        held, size = [], 0
        for w in words.difference(self.known):
            if not w or w[0].isspace() or w[-1].isspace():
                self._learn_run([w])
                continue
            held.append(w)
            size += len(w) + 1
            if size >= CHARS:
                self._learn_run(held)
                held, size = [], 0
        if held:
            self._learn_run(held)


def encoders(path_a: str, path_b: str) -> Encoders:
    """The worker's tokenizers, kept between tasks (functions of this package travel by value, so a module of the worker holds them)."""
    held = sys.modules.setdefault("marketlens_worker", types.ModuleType("marketlens_worker")).__dict__
    key = f"align:{path_a}:{path_b}"
    if key not in held:
        held[key] = Encoders(path_a, path_b)
    return held[key]


# Fragments


def closed_groups(a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(text of each group, its end, code of each link, where it ends) of two streams that start and end together.

    Between two neighbouring ends of tokens lies one overlap: of the tokens of both streams that cover it.
    """
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    ends = np.union1d(ends_a, ends_b)
    links = (a[np.searchsorted(ends_a, ends)] << 32) | b[np.searchsorted(ends_b, ends)]
    sa, sb = list(map(str, a.tolist())), list(map(str, b.tolist()))
    texts, i, j = [], 0, 0
    for i2, j2 in zip(np.searchsorted(ends_a, cuts, "right").tolist(), np.searchsorted(ends_b, cuts, "right").tolist(), strict=True):
        texts.append(",".join(sa[i:i2]) + "|" + ",".join(sb[j:j2]))
        i, j = i2, j2
    return texts, cuts, links, ends


class Fragment:
    """Alignment of a byte range: open prefix, closed groups (given away), open suffix.

    ``head`` and ``tail`` are the open tokens: ids and ends of A, ids and ends
    of B. Without a cut all tokens are ``head``. ``place`` is the range whose
    first cut closes the head.
    """

    def __init__(self, cut: bool, head: list[np.ndarray], tail: list[np.ndarray], place: int):
        self.cut, self.head, self.tail, self.place = cut, head, tail, place

    @staticmethod
    def of(place: int, a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray) -> tuple[Fragment, list[str], np.ndarray]:
        """The fragment of a range's tokens, with its closed groups and their links."""
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        none = [np.empty(0, np.int64)] * 4
        if not len(cuts):
            return Fragment(False, [a, ends_a, b, ends_b], none, place), [], none[0]
        i, j = (np.searchsorted(e, [cuts[0], cuts[-1]], "right") for e in (ends_a, ends_b))
        head = [a[: i[0]], ends_a[: i[0]], b[: j[0]], ends_b[: j[0]]]
        tail = [a[i[1] :], ends_a[i[1] :], b[j[1] :], ends_b[j[1] :]]
        body = [a[i[0] : i[1]], ends_a[i[0] : i[1]], b[j[0] : j[1]], ends_b[j[0] : j[1]]]
        texts, _, links, _ = closed_groups(*body)
        return Fragment(True, head, tail, place), texts, links

    def then(self, right: Fragment) -> tuple[Fragment, tuple | None]:
        """This range followed by the next: the fragment of both, and the group that closes between them."""
        if not self.cut:
            return Fragment(right.cut, _join(self.head, right.head), right.tail, right.place), None
        if not right.cut:
            return Fragment(True, self.head, _join(self.tail, right.head), self.place), None
        return Fragment(True, self.head, right.tail, self.place), closing(_join(self.tail, right.head), right.place)

    def pack(self) -> list[bytes]:
        return [x.tobytes() for x in (*self.head, *self.tail)]

    @staticmethod
    def unpack(cut: bool, place: int, parts: list[bytes]) -> Fragment:
        x = [np.frombuffer(p, np.int64) for p in parts]
        return Fragment(cut, x[:4], x[4:], place)


def _join(x: list[np.ndarray], y: list[np.ndarray]) -> list[np.ndarray]:
    return [np.concatenate(p) for p in zip(x, y, strict=True)]


def closing(tokens: list[np.ndarray], place: int) -> tuple[int, str, np.ndarray] | None:
    """(place, text, links) of the group that open tokens up to a cut make; None without tokens (a range that ended on a cut)."""
    if not len(tokens[0]):
        return None
    texts, _, links, _ = closed_groups(*tokens)
    return place, ";".join(texts), links


# Tasks

_OPEN = ["head_a", "head_a_ends", "head_b", "head_b_ends", "tail_a", "tail_a_ends", "tail_b", "tail_b_ends"]
#: Kinds of rows: a pair of a part, a part's units, a whole document, a range of a long one.
_PAIR, _UNITS, _DOC, _PIECE = range(4)
_ENCODED = pa.schema([
    ("kind", pa.int32()), ("part", pa.int64()), ("pair", pa.int64()), ("code", pa.int64()), ("n", pa.int64()),
    ("starts", pa.binary()), ("flat", pa.binary()), ("row", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64()), ("good", pa.bool_()),
    ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("digest", pa.string()), ("units", pa.binary()),
    ("text", pa.binary()), ("links", pa.binary()), ("cut", pa.bool_()), *[(c, pa.binary()) for c in _OPEN],
])
_ENCODED_DDL = ("kind int, part long, pair long, code long, n long, starts binary, flat binary, row long, doc_id long, place long, good boolean, "
                "n_a long, n_b long, n_groups long, digest string, units binary, text binary, links binary, cut boolean, "
                + ", ".join(f"{c} binary" for c in _OPEN))


def _batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema],
                                      schema=schema)


def _planes(x: np.ndarray) -> bytes:
    """Numbers below 2^24 as all their low bytes, then all middle ones, then all high ones."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T[:3].tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    low, middle, high = np.frombuffer(raw, np.uint8).reshape(3, -1).astype(np.int32)
    return low | middle << 8 | high << 16


class _Part:
    """A bounded run of a task's documents and the units they refer to."""

    def __init__(self, number: int):
        self.number, self.docs, self.size = number, [], 0

    def add(self, enc: Encoders, row: int, doc_id: int | None, words: list[str]) -> None:
        at = np.fromiter(map(enc.known.__getitem__, words), np.int32, len(words))
        texts = list(map(enc.texts.__getitem__, at.tolist()))
        good = all(map(enc.good.__getitem__, at.tolist()))
        digest = hashlib.sha256(b";".join(texts)).hexdigest() if good else ""
        self.docs.append((row, doc_id, good, digest, at if good else at[:0]))
        self.size += len(at)

    def rows(self, enc: Encoders) -> Iterator[pa.RecordBatch]:
        if not self.docs:
            return
        used, at, times = np.unique(np.concatenate([d[4] for d in self.docs]), return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")  # frequent units get small numbers, whose upper bytes compress away
        used, times, rank = used[order], times[order], np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        ends = np.array(enc.link_ends)
        lengths = ends[used + 1] - ends[used]
        starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        flat = np.array(enc.links)[np.arange(starts[-1]) + np.repeat(ends[used] - starts[:-1], lengths)]
        codes, pair = np.unique(flat, return_inverse=True)
        n = np.bincount(pair, weights=np.repeat(times, lengths), minlength=len(codes)).astype(np.int64)
        for lo in range(0, len(codes), 100_000):
            c = codes[lo : lo + 100_000]
            yield _batch({"kind": np.full(len(c), _PAIR, np.int32), "part": np.full(len(c), self.number), "pair": np.arange(lo, lo + len(c)),
                          "code": c, "n": n[lo : lo + 100_000]}, _ENCODED)
        yield _batch({"kind": [_UNITS], "part": [self.number], "starts": [starts.tobytes()], "flat": [pair.astype(np.int32).tobytes()]}, _ENCODED)
        tokens = np.array(enc.tokens, np.int64).reshape(-1, 3)[used]
        at, edge = rank[at], 0
        for lo in range(0, len(self.docs), 2000):
            docs = self.docs[lo : lo + 2000]
            own, sums = [], []
            for d in docs:
                u = at[edge : edge + len(d[4])]
                edge += len(u)
                own.append(_planes(u))
                sums.append(tokens[u].sum(axis=0).tolist())
            yield _batch({"kind": [_DOC] * len(docs), "part": [self.number] * len(docs), "row": [d[0] for d in docs], "doc_id": [d[1] for d in docs],
                          "good": [d[2] for d in docs], "digest": [d[3] for d in docs], "units": own,
                          **{c: [s[i] for s in sums] for i, c in enumerate(("n_a", "n_b", "n_groups"))}}, _ENCODED)


def _encode_whole(path_a: str, path_b: str):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoders(path_a, path_b)
        if len(enc.texts) >= KNOWN_UNITS:
            enc.forget(KEPT_UNITS)
        first = TaskContext.get().partitionId() << 32
        part = _Part(first)
        for b in batches:
            ids, docs, texts = (b.column(c).to_pylist() for c in ("row", "doc_id", "text"))
            for lo in range(0, len(texts), 100):
                words = [units(t) if t else [] for t in texts[lo : lo + 100]]
                enc.learn(set().union(*words))
                for row, doc_id, w in zip(ids[lo : lo + 100], docs[lo : lo + 100], words, strict=True):
                    part.add(enc, row, doc_id, w)
                if part.size >= PART_UNITS or len(enc.texts) >= KNOWN_UNITS:
                    yield from part.rows(enc)
                    part = _Part(part.number + 1)
                    if len(enc.texts) >= KNOWN_UNITS:
                        enc.forget(KEPT_UNITS)
        yield from part.rows(enc)

    return f


_RANGES = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64()), ("from", pa.int64()), ("text", pa.string())])
_RANGES_DDL = "row long, doc_id long, place long, from long, text string"


def _cut_ranges(size: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per byte range of a long text, with the units that reach into it and the byte where they begin."""
        for b in batches:
            for row, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                words = units(text)
                ends = np.cumsum([len(w.encode("utf-8", "replace")) + 1 for w in words])
                for place, lo in enumerate(range(0, int(ends[-1]), size)):
                    i, j = int(np.searchsorted(ends, lo, "right")), int(np.searchsorted(ends, lo + size, "left"))
                    yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(
                        (row, doc_id, place, int(ends[i - 1]) if i else 0, " ".join(words[i : j + 1])), _RANGES, strict=True)], schema=_RANGES)

    return f


def _encode_ranges(path_a: str, path_b: str, size: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoders(path_a, path_b)
        for b in batches:
            for row, doc_id, place, begin, text in zip(*(b.column(c.name).to_pylist() for c in _RANGES), strict=True):
                ids = enc.encode(units(text))
                out = {"kind": [_PIECE], "row": [row], "doc_id": [doc_id], "place": [place], "good": [ids is not None]}
                if ids is not None:
                    a, b_ids = ids
                    ends_a, ends_b = begin + np.cumsum(enc.sizes_a[a]), begin + np.cumsum(enc.sizes_b[b_ids])
                    lo, hi = place * size, (place + 1) * size
                    ia, ib = (np.searchsorted(e, [lo, hi], "right") for e in (ends_a, ends_b))
                    part = [x[i[0] : i[1]] for x, i in ((a, ia), (ends_a, ia), (b_ids, ib), (ends_b, ib))]
                    frag, texts, links = Fragment.of(place, *part)
                    out |= {"n_a": [len(part[0])], "n_b": [len(part[2])], "n_groups": [len(texts)], "text": [";".join(texts).encode()],
                            "links": [links.tobytes()], "cut": [frag.cut], **{c: [x] for c, x in zip(_OPEN, frag.pack(), strict=True)}}
                yield _batch(out, _ENCODED)

    return f


_COMPOSED = pa.schema([("row", pa.int64()), ("level_place", pa.int64()), ("place", pa.int64()), ("cut", pa.bool_()),
                       *[(c, pa.binary()) for c in _OPEN], ("text", pa.binary()), ("links", pa.binary())])
_COMPOSED_DDL = "row long, level_place long, place long, cut boolean, " + ", ".join(f"{c} binary" for c in _OPEN) + ", text binary, links binary"


def _compose(last: bool):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Fragments sorted by (row, level_place): one for each run of the same level_place div FAN, and the groups closed on
        the way (level_place null). In the last round a document's start closes its head."""
        held, held_key = None, None

        def group(row: int, closed: tuple | None) -> Iterator[pa.RecordBatch]:
            if closed is not None:
                place, text, links = closed
                yield _batch({"row": [row], "place": [place], "text": [text.encode()], "links": [links.tobytes()]}, _COMPOSED)

        def done() -> Iterator[pa.RecordBatch]:
            row, at = held_key
            if last:
                yield from group(row, closing(held.head, held.place))
            else:
                yield _batch({"row": [row], "level_place": [at], "place": [held.place], "cut": [held.cut],
                              **{c: [x] for c, x in zip(_OPEN, held.pack(), strict=True)}}, _COMPOSED)

        for b in batches:
            for row, at, place, cut, *opened in zip(*(b.column(c).to_pylist() for c in ("row", "level_place", "place", "cut", *_OPEN)), strict=True):
                frag, key = Fragment.unpack(cut, place, opened), (row, at // FAN)
                if held is None or key != held_key:
                    if held is not None:
                        yield from done()
                    held, held_key = frag, key
                    continue
                held, closed = held.then(frag)
                yield from group(row, closed)
        if held is not None:
            yield from done()

    return f


def _count_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("row", pa.int64()), ("code", pa.int64()), ("n", pa.int64())])
    for b in batches:
        for row, links in zip(b.column("row").to_pylist(), b.column("links").to_pylist(), strict=True):
            codes, n = np.unique(np.frombuffer(links or b"", np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), row), pa.int64()), pa.array(codes), pa.array(n, pa.int64())], schema=schema)


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, digest, groups) of a document's texts of groups, sorted by (row, place, order)."""
    schema = pa.schema([("row", pa.int64()), ("digest", pa.string()), ("groups", pa.int64())])
    held, sha, groups = None, None, 0

    def done() -> Iterator[pa.RecordBatch]:
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held]), pa.array([sha.hexdigest()]), pa.array([groups], pa.int64())], schema=schema)

    for b in batches:
        for row, text in zip(b.column("row").to_pylist(), b.column("text").to_pylist(), strict=True):
            if row != held:
                yield from done()
                held, sha, groups = row, hashlib.sha256(), 0
            if text:
                sha.update((b";" if groups else b"") + text)
                groups += text.count(b"|")
    yield from done()


_RESULT = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")],
                     ("groups_sha256", pa.string())])
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _score_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (part, kind, pair): a part's pairs with their counts, its units, then its documents."""
    part, totals, best, unit_total, unit_best = None, [], [], None, None
    for b in batches:
        kinds = b.column("kind").to_numpy()
        edges = np.flatnonzero(np.diff(kinds)) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(kinds)], strict=True):
            run = b.slice(lo, hi - lo)
            if not run.num_rows:
                continue
            kind = int(kinds[lo])
            if kind == _PAIR:
                if run.column("part")[0].as_py() != part:
                    part, totals, best = run.column("part")[0].as_py(), [], []
                totals.append(run.column("total").to_numpy())
                best.append(run.column("best").to_numpy(zero_copy_only=False))
            elif kind == _UNITS:
                if run.column("part")[0].as_py() != part:  # a part without pairs
                    part, totals, best = run.column("part")[0].as_py(), [], []
                flat = np.frombuffer(run.column("flat")[0].as_py(), np.int32)
                starts = np.frombuffer(run.column("starts")[0].as_py(), np.int64)
                t, h = (np.concatenate([[], *x]).astype(np.int64)[flat] for x in (totals, best))
                unit_total, unit_best = (np.diff(np.concatenate([[0], np.cumsum(x)])[starts]) for x in (t, h))
            else:
                out = []
                for doc_id, n_a, n_b, n_g, digest, own in zip(*(run.column(c).to_pylist() for c in (
                        "doc_id", "n_a", "n_b", "n_groups", "digest", "units")), strict=True):
                    u = _from_planes(own)
                    out.append((doc_id, n_a, n_b, n_g, n_a + n_b - n_g, int(unit_best[u].sum()), int(unit_total[u].sum()), digest if n_a else ""))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _RESULT, strict=True)], schema=_RESULT)


# Spark side


def _compose_tree(pieces: DataFrame, n: int) -> DataFrame:
    """(row, place, text, links) of the groups that close between the ranges of documents."""
    level = pieces.select("row", F.col("place").alias("level_place"), "place", "cut", *_OPEN)
    most = level.agg(F.max("level_place")).first()[0]
    closed = None
    while True:
        last = most < FAN
        d = level.withColumn("run", F.floor(F.col("level_place") / FAN)).repartition(n, "row", "run").sortWithinPartitions("row", "level_place")
        out = write_table(d.drop("run").mapInArrow(_compose(last), _COMPOSED_DDL), "align-composed")
        new = out.filter("level_place is null").select("row", "place", "text", "links")
        closed = new if closed is None else closed.unionByName(new)
        if last:
            return closed
        level, most = out.filter("level_place is not null").drop("text", "links"), most // FAN


def align_table(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", size: int = RANGE) -> DataFrame:
    """One row per row of ``docs`` with the counts and the digest of its alignment (the columns of ``RESULT``).

    ``size`` is the number of bytes from which a document is cut into ranges, and of a range.
    """
    n = partitions(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    d = d.withColumn("row", F.monotonically_increasing_id())
    long = F.octet_length(F.coalesce("text", F.lit(""))) > size
    whole = d.filter(~long).select("row", "doc_id", "text").mapInArrow(_encode_whole(path_a, path_b), _ENCODED_DDL)
    ranges = d.filter(long).select("row", "doc_id", "text").mapInArrow(_cut_ranges(size), _RANGES_DDL).repartition(n, "row", "place")
    enc = write_table(whole.unionByName(ranges.mapInArrow(_encode_ranges(path_a, path_b, size), _ENCODED_DDL)), "align-encoded")

    pairs = enc.filter(F.col("kind") == _PAIR).select("part", "pair", "code", "n")
    pieces = enc.filter(F.col("kind") == _PIECE)
    has_long = not pieces.isEmpty()
    counted = pairs.select("code", "n")
    if has_long:
        known = pieces.groupBy("row", "doc_id").agg(F.min("good").alias("good"), F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))
        known = write_table(known, "align-long")
        pieces = pieces.join(known.filter("good").select("row"), "row", "left_semi")
        closed = _compose_tree(pieces, n)
        inside = pieces.select("row", "place", "text", "links")
        links = inside.select("row", "links").unionByName(closed.select("row", "links")).mapInArrow(_count_links, "row long, code long, n long")
        links = write_table(links.groupBy("row", "code").agg(F.sum("n").alias("n")), "align-links")
        counted = counted.unionByName(links.select("code", "n"))
    totals = counted.groupBy("code").agg(F.sum("n").alias("total")).withColumn("b", F.col("code").bitwiseAND(F.lit(_LOW).cast("long")))
    totals = write_table(totals, "align-totals")
    most = totals.groupBy("b").agg(F.max("total").alias("most"))
    totals = totals.join(most, "b").select("code", "total", (F.col("total") == F.col("most")).cast("int").alias("best"))

    columns = ["kind", "part", "pair", "total", "best", "starts", "flat", "doc_id", "n_a", "n_b", "n_groups", "digest", "units"]
    rated = pairs.join(totals, "code").select(F.lit(_PAIR).alias("kind"), "part", "pair", "total", "best")
    rows = rated.unionByName(enc.filter(F.col("kind").isin(_UNITS, _DOC)).select(*[c for c in columns if c not in ("total", "best")]),
                             allowMissingColumns=True)
    rows = rows.select(*columns).repartition(n, "part").sortWithinPartitions("part", "kind", "pair")
    out = rows.mapInArrow(_score_parts, RESULT)
    if not has_long:
        return out

    scores = links.join(totals, "code").groupBy("row").agg(
        F.sum(F.col("n") * F.col("best")).alias("n_best"), F.sum(F.col("n") * F.col("total")).alias("count_sum"))
    texts = closed.select("row", "place", F.lit(0).alias("order"), "text").unionByName(inside.select("row", "place", F.lit(1).alias("order"), "text"))
    texts = texts.repartition(n, "row").sortWithinPartitions("row", "place", "order").select("row", "text")
    hashed = texts.mapInArrow(_hash_pieces, "row long, digest string, groups long")
    found = known.join(hashed, "row", "left").join(scores, "row", "left")
    good = F.col("good")

    def count(c) -> F.Column:
        return F.when(good, c).otherwise(F.lit(0)).cast("long")

    return out.unionByName(found.select(
        "doc_id", count(F.col("n_a")).alias("n_a"), count(F.col("n_b")).alias("n_b"), count(F.col("groups")).alias("n_groups"),
        count(F.col("n_a") + F.col("n_b") - F.col("groups")).alias("n_links"), count(F.col("n_best")).alias("n_best"),
        count(F.col("count_sum")).alias("count_sum"), F.when(good, F.col("digest")).otherwise(F.lit("")).alias("groups_sha256")))
