"""Order MinHash: the filter of rare k-mers loses nothing, and texts of one template are not verified in pairs."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.llm import order_minhash as om


def _edit(words, edits, rng):
    w = list(words)
    for _ in range(edits):
        what, at = rng.random(), rng.randrange(len(w) + 1)
        if what < 0.4 and at < len(w):
            w[at] = rng.randrange(30)
        elif what < 0.7:
            w.insert(at, rng.randrange(30))
        elif at < len(w) > 1:
            del w[at]
    return w


@pytest.mark.parametrize("seed", range(4))
def test_similar_texts_share_a_prefix_kmer(seed):
    rng = random.Random(seed)
    for _ in range(800):
        x = [rng.randrange(30) for _ in range(rng.randint(1, 40))]
        y = _edit(x, om.most_edits(len(x) + 3), rng)
        x, y = (np.array(v, np.uint64) for v in (x, y))
        if om.similar(x, y):
            first = [set(np.sort(om.labelled_kmers(v, sampled=False))[: om.prefix_length(len(v))].tolist()) for v in (x, y)]
            assert first[0] & first[1]


def _template(n, replaced, seed, slots=None):
    """``n`` texts of 100 words; of the template's words ``replaced`` are others in each, at the ``slots`` or at random places."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(100)]
    out = []
    for i in range(n):
        w = list(base)
        for at in rng.sample(slots or range(len(w)), replaced):
            w[at] = f"w{rng.randrange(5000)}"
        out.append((i, " ".join(w)))
    return out


def _verified(spark, monkeypatch, rows):
    seen = []
    verify = om._verify

    def counted(pairs, texts, n):
        out = verify(pairs, texts, n)
        seen.append(out.count())
        return out

    monkeypatch.setattr(om, "_verify", counted)
    got = {r["doc_id"]: r["group_id"] for r in om.membership(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    monkeypatch.setattr(om, "_verify", verify)
    return got, sum(seen)


def test_template_texts_below_the_threshold(spark, monkeypatch):
    pairs = {}
    for n in (100, 300):
        got, pairs[n] = _verified(spark, monkeypatch, _template(n, 30, n, range(0, 90, 3)))  # any two are alike in 70 words of 100
        assert len(set(got.values())) == n
    assert pairs[300] < 300 * 299 / 2 / 3 and pairs[300] < 5 * pairs[100], pairs


def test_links_that_no_hub_settles(spark, monkeypatch):
    """Pairs of near copies among many texts of one template: each finds its partner."""
    rng = random.Random(5)
    rows = _template(120, 18, 7)
    for i, text in rows[:60]:
        w = text.split()
        for at in rng.sample(range(len(w)), 6):
            w[at] = f"n{rng.randrange(5000)}"
        rows.append((1000 + i, " ".join(w)))
    got, _ = _verified(spark, monkeypatch, rows)
    for i in range(60):
        assert got[1000 + i] == got[i] == i


def test_a_large_group_costs_about_a_pair_a_member(spark, monkeypatch):
    got, pairs = _verified(spark, monkeypatch, _template(400, 4, 9))
    assert set(got.values()) == {0}
    assert pairs < 400 * 3, pairs


def test_parities_never_differ_by_more_than_twice_the_edits():
    rng = random.Random(8)
    for _ in range(300):
        a = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 80))]
        b, edits = list(a), rng.randrange(0, 12)
        for _ in range(edits):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = [f"v{rng.randrange(60)}"] * rng.randrange(2)
        x, y = (om.word_hashes(" ".join(t), om._Powers()) for t in (a, b))
        apart = sum(int(v).bit_count() for v in (om.parities(x) ^ om.parities(y)).view(np.uint64))
        assert apart + abs(len(x) - len(y)) <= 2 * edits


def test_texts_of_a_template_beyond_the_threshold_do_not_meet(spark):
    # half the words of 60 texts are one of three: any two share rare pairs of words, yet a third of the words differ
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(60):
        t = list(base)
        for at in range(0, 120, 2):
            t[at] = f"x{at}-{rng.randrange(3)}"
        texts.append(t)
    texts.append([*texts[7][:50], "other", *texts[7][51:]])
    rows = [(hashlib.md5(" ".join(t).encode()).digest(), " ".join(t)) for t in texts]
    d = spark.createDataFrame(rows, "node binary, text string")
    members = d.select(F.lit(1).cast("long").alias("cell"), "node", F.col("node").alias("root"), F.lit(True).alias("is_rest"))
    met = {frozenset((bytes(r["hub"]), bytes(r["node"]))) for r in om._met_by_kmers(members, d, 4).collect()}
    words = {n: om.word_hashes(t, om._Powers()) for n, t in rows}
    near = {frozenset((a, b)) for a in words for b in words if a < b and om.similar(words[a], words[b])}
    assert frozenset((rows[7][0], rows[60][0])) in near and near <= met
    assert len(met) <= 20  # of 1,830 pairs


def test_similar_texts_share_a_prefix_word():
    rng = random.Random(11)
    for _ in range(1500):
        x = [rng.randrange(30) for _ in range(rng.randint(1, 40))]
        y = _edit(x, om.most_edits(len(x) + 3), rng)
        x, y = (np.array(v, np.uint64) for v in (x, y))
        if om.similar(x, y):
            first = [set(np.sort(om.labelled_kmers(v, sampled=False, k=1))[: om.prefix_length(len(v), 1)].tolist()) for v in (x, y)]
            assert first[0] & first[1]


def test_a_large_group_meets_its_roots_once_a_hub(spark, monkeypatch):
    # every member is in many cells, most of which have the same hub
    rows = []
    with_roots = om._with_roots

    def counted(d, roots, node, root):
        rows.append((d.count(), d.select("node").distinct().count()))
        return with_roots(d, roots, node, root)

    monkeypatch.setattr(om, "_with_roots", counted)
    om.membership(spark.createDataFrame(_template(300, 4, 21), "doc_id long, text string")).collect()
    assert rows and all(n < 12 * nodes for n, nodes in rows), rows


def test_words_of_a_large_group_are_listed_once_not_once_a_cell(spark):
    # 120 texts of one template in 30 cells that each lack some of them, one pair of near copies, and a far cell with the same words
    rng = random.Random(12)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for i in range(120):
        t = list(base)
        for at in rng.sample(range(100), 30):
            t[at] = f"x{rng.randrange(400)}"
        texts.append(t)
    texts.append([*texts[3][:50], "other", *texts[3][51:]])
    texts.append([*texts[3][:40], "far", *texts[3][41:]])
    rows = [(hashlib.md5(" ".join(t).encode()).digest(), " ".join(t)) for t in texts]
    d = spark.createDataFrame(rows, "node binary, text string")
    cells = [(c, rows[i][0], rows[i][0], i != 0) for c in range(30) for i in range(121) if i in (0, 3, 120) or rng.random() < 0.9]
    cells += [(99, rows[i][0], rows[i][0], True) for i in (121, 1, 2)]
    members = spark.createDataFrame(cells, "cell long, node binary, root binary, is_rest boolean")
    near = om._by_near(members)
    assert near.count() < 2 * 122 and members.count() > 25 * 120
    met = {frozenset((bytes(r["hub"]), bytes(r["node"]))) for r in om._met_by_kmers(members, d, 4).collect()}
    words = {n: om.word_hashes(t, om._Powers()) for n, t in rows}
    of = {}
    for c, node, _, _ in cells:
        of.setdefault(node, set()).add(c)
    shared = {frozenset((a, b)) for a in words for b in words if a < b and of[a] & of[b]}
    close = {p for p in shared if om.similar(*(words[n] for n in p))}
    assert frozenset((rows[3][0], rows[120][0])) in close and close <= met <= shared


def _brute_cells(nodes):
    """Pairs of nodes that share a cell by its definition, however cells are kept."""
    at = {}
    for node, words, keys, places in nodes:
        own = int(np.floor(np.log(max(words, 1)) / np.log(1.25) + 1e-9))
        for key, place in zip(keys, places):
            for c in (own, own + 1):
                reach = 1.25 ** (c + 1) * (1 - om.SIMILARITY)
                for grid in (0, 1):
                    at.setdefault((key, c, grid, int((place + grid * reach) // (2 * reach))), set()).add(node)
    return {frozenset((a, b)) for s in at.values() for a in s for b in s if a < b}


def test_a_bucket_that_one_cell_holds_is_one_cell(spark):
    schema = "node binary, words long, keys array<long>, places array<long>"
    # in one grid places 40, 41 and 46, 47 lie on either side of a border, in the other all are in one cell; two keys with the same nodes
    nodes = [(bytes([i]), 100, [7, 8], [p, p]) for i, p in enumerate((40, 41, 46, 47))]
    got = om._cells(spark.createDataFrame(nodes, schema)).collect()
    assert len(got) == 4 and len({r["cell"] for r in got}) == 1 and {r["n"] for r in got} == {4}


@pytest.mark.parametrize("seed", range(2))
def test_cells_join_the_pairs_they_are_defined_to(spark, seed):
    rng = random.Random(seed)
    nodes = []
    for i in range(120):
        words = rng.choice([1, 5, 40, 95, 100, 104, 118, 125, 160, 300])
        keys = rng.sample(range(25), 6)
        nodes.append((bytes([i]), words, keys, [min(words - 1, rng.choice([0, 3, 20, 40, 44, 60, 150])) for _ in keys]))
    cells = {}
    for r in om._cells(spark.createDataFrame(nodes, "node binary, words long, keys array<long>, places array<long>")).collect():
        cells.setdefault(r["cell"], set()).add(bytes(r["node"]))
    assert {frozenset((a, b)) for s in cells.values() for a in s for b in s if a < b} == _brute_cells(nodes)


def test_words_that_only_one_component_lists_are_not_listed(spark, monkeypatch):
    # 60 texts of one component share rare words that no other text has; three pairs of near copies are components of their own
    rng = random.Random(4)
    base = [f"w{i}" for i in range(100)]

    def other(prefix, words):
        t = list(base)
        for at in rng.sample(range(100), 30):
            t[at] = f"{prefix}{rng.randrange(words)}"
        return t

    texts = [other("x", 300) for _ in range(60)]
    for i in range(3):
        t = other(f"y{i}-", 1000)
        texts += [t, [*t[:50], "other", *t[51:]]]
    rows = [(hashlib.md5(" ".join(t).encode()).digest(), " ".join(t)) for t in texts]
    d = spark.createDataFrame(rows, "node binary, text string")
    members = [(1, rows[i][0], rows[0][0] if i < 60 else rows[i][0], i >= 60) for i in range(66)]
    listed = []
    write = om.write_table

    def counted(df, name):
        out = write(df, name)
        if "list" in out.columns:
            listed.append(out.count())
        return out

    monkeypatch.setattr(om, "write_table", counted)
    members = spark.createDataFrame(members, "cell long, node binary, root binary, is_rest boolean")
    met = {frozenset((bytes(r["hub"]), bytes(r["node"]))) for r in om._met_by_kmers(members, d, 4).collect()}
    assert met >= {frozenset((rows[i][0], rows[i + 1][0])) for i in (60, 62, 64)}
    assert len(listed) == 2 and listed[0] < 66 * 10, listed  # about 20 words of each text are among its first


@pytest.mark.parametrize("blocks", [0, 3])
def test_lists_of_more_than_one_component_stay(spark, monkeypatch, blocks):
    monkeypatch.setattr(om, "SLOTS_PER_TASK", 16 - blocks)
    rng = random.Random(blocks)
    lists = [rng.getrandbits(64) - 2**63 for _ in range(40)]
    rows = [(bytes([rng.randrange(4)]), sorted(rng.sample(lists, rng.randrange(3)))) for _ in range(60)]
    near = spark.createDataFrame(rows, "root binary, lists array<long>").repartition(5)
    slots, bits = om._lists_of_more_roots(near, 4)
    assert bits - blocks == om.SLOTS_PER_TASK
    got = sorted((bytes(r["root"]), sorted(r["lists"])) for r in near.mapInArrow(om._in_lists(slots, bits), near.schema).collect())
    roots = {}
    for root, own in rows:
        for v in own:
            roots.setdefault(v, set()).add(root)
    assert len({(v + 2**63) >> 48 for v in lists}) == len(lists)  # a slot each
    assert got == sorted((root, [v for v in own if len(roots[v]) > 1]) for root, own in rows)
