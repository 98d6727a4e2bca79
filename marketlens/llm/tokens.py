"""Token ids of whole texts with the tokenizers library.

The tokenizer splits at white space before anything else looks at the text,
so its ids for a text are those of its words one after the other. Each worker
keeps the ids of words it has met (at most ``WORDS`` of them) and hands the
library only new ones, many at a time, bare of full stops and commas. A tokenizer whose file does not show
that property encodes whole texts.
"""

from __future__ import annotations

import json
import os
import sys
import types
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np

#: Words kept per worker, and characters encoded at a time.
WORDS = 1_000_000
CHARS = 4_000_000


def splits_at_space(path: str) -> bool:
    """Whether white space never reaches a token: the pre-tokenizer drops it,
    and the normalizer works within words (composition, white space, case)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    norm = spec.get("normalizer") or {}
    steps = norm.get("normalizers") or [norm]
    kinds = {s.get("type") for s in steps if s}
    return (
        first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
        and r"[^\s\p{L}\p{N}]+" in (first.get("pattern") or {}).get("Regex", "") and kinds <= {"NFC", "Replace", "Lowercase"}
        and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", []))
    )


def word_ends(path: str, tokenizer) -> np.ndarray | None:
    """By id, whether the token ends a word; None if the vocabulary does not tell."""
    with open(path, encoding="utf-8") as f:
        suffix = json.load(f)["model"].get("end_of_word_suffix")
    if not suffix:
        return None
    vocab = tokenizer.get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocab.values()) + 1, bool)
    out[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
    return out


class Encoder:
    """Ids as little-endian unsigned 32-bit integers, without special tokens added."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = splits_at_space(path)
        self.known: dict[str, bytes] = {"": b""}
        self.ends = word_ends(path, self.tokenizer) if self.by_word else None

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of single words. Words of letters alone are one piece to the
        tokenizer; where the last id of a piece shows that it ends a word, they
        are encoded as one text and cut at those ids."""
        if self.ends is None or not all(map(str.isalpha, words)):
            return self._ids(words)
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cut = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(cut) != len(words) or cut[-1] != ids.nbytes:
            return self._ids(words)
        blob = ids.tobytes()
        return [blob[i:j] for i, j in zip([0, *cut[:-1].tolist()], cut.tolist(), strict=True)]

    def _learn(self, words: list[str]) -> None:
        """Put the ids of new words into ``known``. Full stops and commas after a
        letter or digit are pieces of their own, and the case of ASCII letters
        makes no difference, so the bare word is what is encoded."""
        known = self.known
        bare = [w.rstrip(".,") for w in words]
        for i, (w, core) in enumerate(zip(words, bare, strict=True)):
            if len(core) < len(w) and not core[-1:].lower().isalnum():
                bare[i] = w
        plain = [core.lower() if core.isascii() else core for core in bare]
        tails = {w[len(core) :] for w, core in zip(words, bare, strict=True)}
        new = (set(plain) | tails).difference(known)
        letters = list(filter(str.isalpha, new))
        for group in (letters, list(new.difference(letters))):
            for lo in range(0, len(group), 20_000):
                part = group[lo : lo + 20_000]
                known.update(zip(part, self._word_ids(part), strict=True))
        for w, core, p in zip(words, bare, plain, strict=True):
            if w not in known:
                known[w] = known[p] + known[w[len(core) :]] if len(core) < len(w) else known[p]

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, in order; about ``CHARS`` characters are worked on at a time."""
        held, size = [], 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size >= CHARS:
                yield from self._encode(held)
                held, size = [], 0
        yield from self._encode(held)

    def _encode(self, texts: list[str]) -> list[bytes]:
        if not texts or not self.by_word:
            return self._ids(texts)
        known = self.known
        split = [t.replace("\n", " ").split(" ") for t in texts]
        before = len(known)
        self._learn(list(set().union(*split).difference(known)))
        get = known.__getitem__
        out = [b"".join(map(get, words)) for words in split]
        if len(known) > WORDS:  # the words met first are mostly the frequent ones: those stay
            for w in list(islice(reversed(known), len(known) - before)):
                del known[w]
        return out


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file, kept between tasks (functions of this
    package travel by value, so a module of the worker holds it)."""
    held = sys.modules.setdefault("marketlens_worker", types.ModuleType("marketlens_worker"))
    if path not in held.__dict__:
        held.__dict__[path] = Encoder(path)
    return held.__dict__[path]
