"""Token alignment against a plain walk over the bytes, whole and in ranges."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from functools import cache

import numpy as np
import public_tokenizers
import pytest

from marketlens.llm import token_alignment as ta

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, row string, part int"
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@cache
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B)


@cache
def streams(text):
    """Whole-text tokens of both tokenizers as (id, bytes), or None."""
    t, sp = tokenizers()
    back = ta._byte_level()
    a = [(i, bytes(back[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in sp.encode(text):
        p = sp.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()))
    raw = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == raw and b"".join(x for _, x in b) == raw else None


def expected(texts):
    docs, counts = [], Counter()
    for text in texts:
        found = streams(text) if text else None
        links, groups = [], []
        if found:
            a, b = found
            i = j = ea = eb = 0
            group = ([], [])
            sa = sb = 0
            while i < len(a) or j < len(b):  # the stream that is behind takes its next token
                if ea <= eb and i < len(a):
                    sa, ea = ea, ea + len(a[i][1])
                    group[0].append(a[i][0])
                    i += 1
                else:
                    sb, eb = eb, eb + len(b[j][1])
                    group[1].append(b[j][0])
                    j += 1
                if min(ea, eb) > max(sa, sb):
                    links.append((a[i - 1][0], b[j - 1][0]))
                if ea == eb:
                    groups.append(",".join(map(str, group[0])) + "|" + ",".join(map(str, group[1])))
                    group = ([], [])
        counts.update(links)
        docs.append((found, links, groups))
    highest = Counter()
    for (x, y), n in counts.items():
        highest[y] = max(highest[y], n)
    out = []
    for found, links, groups in docs:
        na, nb = (len(found[0]), len(found[1])) if found else (0, 0)
        out.append((na, nb, len(groups), len(links), sum(counts[k] == highest[k[1]] for k in links), sum(counts[k] for k in links),
                    hashlib.sha256(";".join(groups).encode()).hexdigest() if found else ""))
    return out


def made(seed, n):
    rng = random.Random(seed)
    bits = ["word", " ", "  ", "\n", "\t", "é", "👩‍🚀", "don't", "1234", " a", "b ", " ", "\x1c", "<|endoftext|>", "<s>", "　", "ＡＢ", "x.y,z"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_units_encode_like_the_whole_text():
    enc = ta.Encoders(A, B)
    for text in made(1, 300):
        found = streams(text)
        ids = enc.encode(ta.units(text)) if text else None
        if text and found:
            assert [x.tolist() for x in ids] == [[i for i, _ in s] for s in found]
        elif text:
            assert ids is None


def test_fragments_compose_associatively():
    rng = np.random.default_rng(0)
    for _ in range(300):
        end = int(rng.integers(1, 60))
        ends = [np.unique(np.append(rng.integers(1, end + 1, rng.integers(1, 30)), end)) for _ in range(2)]
        a, b = (rng.integers(0, 9, len(e)) for e in ends)
        want = ta.closed_groups(a, ends[0], b, ends[1])
        stops = [0, *np.unique(rng.integers(1, end + 1, 4)).tolist(), end]
        frags = []
        pieces = {}
        for place, (lo, hi) in enumerate(zip(stops, stops[1:])):
            i, j = (np.searchsorted(e, [lo, hi], "right") for e in ends)
            f, texts, links = ta.Fragment.of(place, a[i[0]:i[1]], ends[0][i[0]:i[1]], b[j[0]:j[1]], ends[1][j[0]:j[1]])
            frags.append(f)
            pieces[place, 1] = (texts, links)
        while len(frags) > 1:  # any order of composing neighbours
            k = int(rng.integers(0, len(frags) - 1))
            f, closed = frags[k].then(frags[k + 1])
            frags[k : k + 2] = [f]
            if closed:
                pieces[closed[0], 0] = ([closed[1]], closed[2])
        place, text, links = ta.closing(frags[0].head, frags[0].place)
        pieces[place, 0] = ([text], links)
        ordered = [pieces[k] for k in sorted(pieces)]
        assert [t for p in ordered for t in p[0]] == want[0]
        assert np.concatenate([p[1] for p in ordered]).tolist() == want[2].tolist()


@pytest.mark.parametrize("size", [7, 60, 1 << 16])
def test_whole_and_in_ranges(spark, size):
    texts = [None, "", "same text here", "same text here", *made(2, 40), "▁ odd", "no " * 300, "x" * 700, "The long one. " * 60]
    df = spark.createDataFrame([(i if i % 5 else None, t, "en", "r", 1) for i, t in enumerate(texts)], SCHEMA)
    got = sorted(tuple(r[c] for c in COLUMNS) for r in ta.align_table(df, A, B, size=size).collect())
    assert got == sorted(expected(texts))


def test_empty_and_given_tables(spark):
    assert ta.align_table(spark.createDataFrame([], SCHEMA), A, B).count() == 0
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = df.select("doc_id", "text").collect()
    want = dict(zip([r["doc_id"] for r in rows], expected([r["text"] for r in rows]), strict=True))
    for size in (1000, ta.RANGE):
        got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in ta.align_table(df, A, B, size=size).collect()}
        assert got == want


def test_forgotten_units_and_small_parts(spark, monkeypatch):
    monkeypatch.setattr(ta, "KNOWN_UNITS", 30)
    monkeypatch.setattr(ta, "KEPT_UNITS", 10)
    monkeypatch.setattr(ta, "PART_UNITS", 50)
    texts = [*made(4, 60), "some plain words again and again " * 9, "other words, other words"]
    df = spark.createDataFrame([(i, t, "en", "r", 1) for i, t in enumerate(texts * 20)], SCHEMA)
    got = sorted(tuple(r[c] for c in COLUMNS) for r in ta.align_table(df, A, B).collect())
    assert got == sorted(expected(texts * 20))
