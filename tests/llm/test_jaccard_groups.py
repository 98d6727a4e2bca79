"""The grouped prefix join against all pairs, and its cost on clusters."""

from __future__ import annotations

import random
import re

import pytest

from marketlens.llm import jaccard_groups as jg
from marketlens.llm import order_minhash as om
from marketlens.llm import token_counts
from marketlens.llm.common import LEAST_TASKS

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n int, node string, row string, token long"


def shingle_set(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def expected(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * k >= 85 * (len(sets[i]) + len(sets[j]) - k):
                root[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids) if ids and sets[i] else doc_id))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r)[:3] for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", 5) for r in rows], SCHEMA)


def made(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    passage = rng.choices(vocab, k=30)
    rows = []
    for _ in range(25):
        base = rng.choices(vocab, k=rng.randint(1, 70))
        if rng.random() < 0.4:
            base[len(base) // 2 : len(base) // 2] = passage
        for _ in range(rng.randint(1, 6)):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append(" ".join(words))
    rows += [None, "", " \n\t", "One Two", "one two", "one two three", "É x y z", "é x y z", "long " * 4000, "Long " * 3000, rows[0], rows[0]]
    return [(i if i % 9 else None, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("blocks", [22, 8])
def test_all_pairs(spark, blocks, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK_BITS", blocks)
    monkeypatch.setattr(token_counts, "FREQUENT", 3)
    rows = made(blocks)
    assert got(jg.jaccard_components(frame(spark, rows))) == expected(rows)


def test_counts_reach_the_tables(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK_BITS", 9)
    texts = [f"common words of all texts and then {i} own {i} words {i // 2}" for i in range(200)]
    levels = token_counts.token_levels(frame(spark, list(enumerate(texts))).select("text").repartition(5), jg.shingles, 7)
    of = {i: levels.of(jg.shingles(t)) for i, t in enumerate(texts)}
    common = set(jg.shingles(texts[0]).tolist()) & set(jg.shingles(texts[9]).tolist())
    for i, t in enumerate(texts):
        for s, level in zip(jg.shingles(t).tolist(), of[i].tolist(), strict=True):
            assert level >= 5 if s in common else level <= 1 or level < 5
    assert sum((x == 0).sum() for x in of.values()) > 0.9 * sum(len(x) for x in of.values()) - 201 * len(common)


def test_given_and_empty_tables(spark):
    assert jg.jaccard_components(frame(spark, []).limit(0)).count() == 0
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert got(jg.jaccard_components(df)) == expected([(r["doc_id"], r["text"]) for r in df.collect()])


@pytest.mark.parametrize("share", [0.004, 0.03])
def test_cost_of_clusters(spark, share, monkeypatch):
    """n near copies take verified pairs in proportion to n; texts of a template below the threshold a small part of all pairs."""
    verified = []
    whole = jg.verify

    def counted(pairs, texts, n):
        out = whole(pairs, texts, n)
        verified.append(out.count())
        return out

    monkeypatch.setattr(jg, "verify", counted)
    used = []
    for n in (100, 300):
        rng = random.Random(4)
        base = [f"b{i}" for i in range(250)]
        rows = []
        for i in range(n):
            rows.append((i, " ".join(w if rng.random() > share else f"x{i}-{j}" for j, w in enumerate(base))))
            rows.append((n + i, " ".join(f"t{j}" if rng.random() > 0.1 else f"y{i}-{j}" for j in range(250))))
        verified.clear()
        out = got(jg.jaccard_components(frame(spark, rows)))
        assert out == expected(rows)
        used.append(sum(verified))
    if share < 0.01:
        assert used[1] <= 4 * used[0] + 100, used
    else:
        assert used[1] <= 0.05 * 300 * 299 / 2, used


def test_only_wanted_texts_are_read_for_the_join(spark):
    d = spark.range(60_000).selectExpr("id * 8589934593 + id AS row", "cast(id AS string) AS text")
    wanted = d.filter("text % 20 = 0").select("row")
    kept = {r["text"] for r in jg.marked(d, wanted, 8).collect()}
    assert {str(i) for i in range(0, 60_000, 20)} <= kept
    assert len(kept) < 1.25 * 3_000 + 57_000 / 8


def test_texts_of_single_documents_are_not_shuffled(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))) for i in range(500)]
    rows += [(5_000 + i, rows[i][1] + " end") for i in range(20)]
    seen = []
    write = jg.write_table

    def counted(df, name):
        if name == "jaccard-texts":
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            seen.append("is_marked" in plan)
        return write(df, name)

    monkeypatch.setattr(jg, "write_table", counted)
    assert got(jg.jaccard_components(frame(spark, rows))) == expected(rows)
    assert seen == [True]


def test_small_tables_are_few_files(spark, monkeypatch):
    """Where AQE leaves many shuffle partitions as they are, a small table isn't as many files: each takes its executor processes."""
    rng = random.Random(11)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))) for i in range(400)]
    rows += [(1_000 * k + i, rows[i][1] + " end" * k) for i in range(300) for k in (1, 2)]
    files = {}
    for module in (jg, om):

        def counted(df, name, write=module.write_table):
            out = write(df, name)
            files.setdefault(name, []).append(len(out.inputFiles()))
            return out

        monkeypatch.setattr(module, "write_table", counted)
    wanted = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        assert got(jg.jaccard_components(frame(spark, rows).coalesce(3))) == expected(rows)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert {"jaccard-nodes", "jaccard-lists", "jaccard-star", "jaccard-verified", "omh-edges", "omh-roots"} <= set(files)
    assert all(n <= LEAST_TASKS for counts in files.values() for n in counts), files
