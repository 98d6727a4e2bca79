"""Small checks of every training-data operator against brute force, with the defined edge cases."""

from __future__ import annotations

import bisect
import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from marketlens.llm import html_extract, line_dedup, mixing, nn_descent, order_minhash, packing, repair, suffix_dedup, tokens, topk, toxicity
from marketlens.llm.queries import TOKENIZER
from marketlens.llm.suffix_groups import suffix_array

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, features string, size int, kind string"
ROWS = [
    (3, "The cat sat.\nOn the mat.\nAll day long.", "en", "b", 40, "x", 1, "k"),
    (1, "The cat sat.\nOn the mat.\nAll day long.", "en", None, 40, None, 1, "k"),
    (1, "The cat sat.\nOn the mat.\nAll day long.", "en", None, 40, None, 1, "k"),
    (None, None, None, None, None, None, None, None),
    (7, "", "", "", 0, "", 0, ""),
    (7, "word " * 5000, "de", "a", 25000, "f", 2, "k"),
    (9, "é ß 123, <|endoftext|> x.", None, "a", 20, "f", 2, "k"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def encode(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER).encode(text or "", add_special_tokens=False).ids


def test_word_cache_gives_the_ids_of_whole_texts():
    rng, enc = random.Random(5), tokens.Encoder(TOKENIZER)
    chars = [*"aB éÉ'st re\u0085　\x1c\t\r\n.,!<|>1٣½ΣςİıǅßK힣", "<|endoftext|>", "'ll", " "]
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode(texts)] == [encode(t) for t in texts]


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(0)
    for n, v in ((0, 1), (1, 5), (900, 1), (3000, 40), (3000, 70000)):
        ids = np.tile(rng.integers(0, v, n).astype("<u4"), 2)
        cut = np.sort(rng.integers(0, len(ids) + 1, 3))
        lengths = np.diff(np.concatenate([[0], cut, [len(ids)]]))
        s = repair.Shard(repair.to_bytes([1, None, 3, 4], lengths, ids))
        assert (s.all() == ids).all() and s.doc_ids == [1, None, 3, 4]
        assert (np.concatenate([s.document(i) for i in range(4)]) == ids).all()
        for a in rng.integers(0, len(ids) + 1, 20):
            assert (s.read(int(a), 7) == ids[a : a + 7]).all()


def test_token_table(docs, empty):
    got = sorted((tuple(r) for r in repair.encode_table(docs, TOKENIZER).collect()), key=lambda r: r[1])
    rows = sorted(((r[0], r[1] or "") for r in ROWS), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    start, want = 0, []
    for i, t in rows:
        ids = np.array([*encode(t), 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert repair.encode_table(empty, TOKENIZER).count() == 0


@pytest.mark.parametrize("rows_per_sweep", [200_000, 60])
def test_packing_is_valid_and_near_best_fit(spark, rows_per_sweep):
    rng = random.Random(1)
    sizes = [rng.choice([1, 5, 40, 300, 900, 1024, 1100, 2047, 2048, rng.randint(1, 2048)]) for _ in range(500)]
    pieces = spark.createDataFrame(list(enumerate(sizes)), "id long, length long")
    got = packing.pack(pieces, rows_per_sweep=rows_per_sweep).collect()
    assert sorted(r["id"] for r in got) == list(range(500))
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], sizes[r["id"]]))
    for parts in by.values():
        end = 0
        for offset, size in sorted(parts):
            assert offset == end
            end += size
        assert end <= 2048
    free: list[int] = []
    best = 0
    for s in sorted(sizes, reverse=True):
        at = bisect.bisect_left(free, s)
        gap = free.pop(at) if at < len(free) else 2048
        best += at >= len(free) + (gap != 2048) and gap == 2048
        bisect.insort(free, gap - s)
    assert len(by) <= best * 1.05 + 2
    if rows_per_sweep > 500:
        assert len(by) == best


def _best_fit(sizes):
    free, n = [], 0
    for s in sorted(sizes, reverse=True):
        at = bisect.bisect_left(free, s)
        if at < len(free):
            gap = free.pop(at)
        else:
            gap, n = 2048, n + 1
        bisect.insort(free, gap - s)
    return n


@pytest.mark.parametrize("most", [9, 200])
def test_packing_of_short_pieces_over_many_partitions(spark, most):
    rng = random.Random(most)
    sizes = [rng.randint(1, most) for _ in range(6000)]
    got = packing.pack(spark.createDataFrame(list(enumerate(sizes)), "id long, length long"), rows_per_sweep=600).collect()
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], sizes[r["id"]]))
    assert sorted(r["id"] for r in got) == list(range(6000))
    for parts in by.values():
        end = 0
        for offset, size in sorted(parts):
            assert offset == end
            end += size
        assert end <= 2048
    assert len(by) <= _best_fit(sizes) * 1.01 + 2


def test_packing_opens_no_more_sequences_than_small_pieces_fill(spark):
    rows = [("p", i, 1 + i % 3) for i in range(1764)] + [("g", 9999, 1)]
    state = spark.createDataFrame(rows, "kind string, id long, size int")
    after, first = packing._open(spark, state, packing._counts(state), 2048)
    assert first.count() == 2  # 3,528 tokens
    assert sorted(r["id"] for r in first.union(after.filter("kind = 'p'").selectExpr("id", "id", "0L")).collect()) == list(range(1764))


def test_packing_edges(docs, empty):
    got = packing.pack_table(docs, TOKENIZER).collect()
    assert sum(r["length"] for r in got) == sum(len(encode(r[1])) + 1 for r in ROWS)
    assert packing.pack_table(empty, TOKENIZER).count() == 0


@pytest.mark.parametrize("digits", [line_dedup.DIGITS, 1])  # with one digit many different lines have one hash
def test_line_dedup_matches_sql(spark, digits):
    t = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(tuple(r) for r in line_dedup.dedup_lines(t, counts=True, digits=digits).select("doc_id", "line_dedup.*", "text").collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    assert got == sorted(con.execute(line_dedup.dedup_sql(digits)).fetchall())


def test_line_dedup_finds_short_passages(spark):
    rng = random.Random(4)
    lines = lambda n: [" ".join(f"w{rng.randrange(10**6)}" for _ in range(20)) for _ in range(n)]
    rows, planted = [], {}
    for k in range(400):
        passage = lines(rng.randint(2, 6))
        for copy in range(2):
            i = 2 * k + copy
            rows.append((i, "\n".join([*lines(rng.randint(1, 5)), *passage, *lines(rng.randint(1, 5))])))
        planted[2 * k + 1] = set(passage)
    whole = lost = 0
    before = dict(rows)
    for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        left, had = r["text"].split("\n"), before[r["doc_id"]].split("\n")
        assert [x for x in had if x not in planted.get(r["doc_id"], ())] == [x for x in left if x not in planted.get(r["doc_id"], ())]
        if r["doc_id"] in planted:
            whole += not planted[r["doc_id"]] & set(left)
            lost += 1
        else:
            assert left == had
    assert whole >= 0.9 * lost


def test_line_dedup_blank_lines_and_order(spark):
    rows = [(2, "\n \none\n\ntwo\nthree\n"), (1, "one\ntwo\n\nthree"), (None, "\n\n"), (4, "one\ntwo\nthree\nfour five")]
    got = dict((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {2: "", 1: rows[1][1], None: "\n\n", 4: "four five"}


def test_line_dedup_edges(docs, empty):
    got = {(r["doc_id"], r["source"]): r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert got[(1, None)] == ROWS[1][1] and got[(3, "b")] == "" and got[(None, None)] is None and got[(7, "")] == ""
    assert line_dedup.dedup_lines(docs).columns == docs.columns and line_dedup.dedup_lines(empty).count() == 0


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_alignment():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.randrange(rng.choice([2, 30])) for _ in range(rng.randint(0, 30))]
        b = [x for x in a if rng.random() > 0.15]
        b.insert(rng.randint(0, len(b)), 99)
        d = _distance(a, b)
        for limit in (0, d - 1, d, d + 1, 20):
            if limit >= 0:
                assert order_minhash.within(np.array(a, np.uint64), np.array(b, np.uint64), limit) == (d <= limit)


@pytest.mark.parametrize("length", [50, 200])
@pytest.mark.parametrize("similarity, least", [(0.9, 0.99), (0.87, 0.99), (0.85, 0.98), (0.82, 0.96), (0.8, 0.94)])
def test_sketches_meet_at_the_stated_similarity(length, similarity, least):
    rng = np.random.default_rng(4)
    for kind in ("substitute", "delete"):
        met = 0
        for _ in range(200):
            a = rng.integers(0, 2**62, length).astype(np.uint64)
            at = rng.permutation(length)[: round(length * (1 - similarity))]
            b = np.delete(a, at)
            if kind == "substitute":
                b = a.copy()
                b[at] = rng.integers(0, 2**62, len(at)).astype(np.uint64)
            assert order_minhash.similar(a, b)
            met += (order_minhash.sketches(a)[0] == order_minhash.sketches(b)[0]).any()
        assert met / 200 >= least, (kind, met)


def test_near_duplicates_match_brute_force(spark, docs, empty):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(words) for _ in range(120)]
        for copy in range(rng.choice([1, 2, 5, 14])):
            w = list(base)
            for _ in range(copy % 4):
                w[rng.randrange(len(w))] = "edit"
            rows.append((n, " ".join(w)))
            n += 1
    got = {r["doc_id"]: r["group_id"] for r in order_minhash.membership(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    root = {i: i for i, _ in rows}
    for i, a in rows:
        for j, b in rows[:i]:
            x, y = a.split(), b.split()
            if sum(p != q for p, q in zip(x, y, strict=True)) <= 24 and root[j] != root[i]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert got == root
    kept = order_minhash.drop_near_duplicates(docs).collect()
    assert sorted((r["doc_id"] for r in kept), key=str) == [1, 7, 7, 9] and kept[0].asDict().keys() == set(docs.columns)
    assert order_minhash.membership(empty).count() == 0


VECTORS = [(i, [float(x) for x in np.random.default_rng(i % 90).normal(size=8)]) for i in range(200)] + [
    (300, None), (301, []), (302, [None] * 8), (303, [float("nan")] * 8), (304, [0.0] * 8), (None, [1.0] * 8), (350, [1.0, 2.0]), (0, [1.0] * 8)]


def _top(score, zero_ok):
    use = [(i, np.array(v)) for i, v in VECTORS if i is not None and v and None not in v and np.isfinite(v).all() and (zero_ok or any(v))]
    out = {}
    for q in sorted({i for i, _ in use if i % 50 == 0}):
        best = defaultdict(lambda: -1e300)
        for i, x in use:
            for j, y in use:
                if i == q and j != q and len(x) == len(y):
                    best[j] = max(best[j], score(x, y))
        out[q] = sorted(best.items(), key=lambda c: (-round(c[1], 9), c[0]))[:5]
    return {q: v for q, v in out.items() if v}


def test_exact_top_k(spark):
    t = spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in topk.search_table(t).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert dict(got) == _top(lambda x, y: int(np.floor(256 * x) @ np.floor(256 * y)), True)
    assert topk.search_table(t.limit(0)).count() == 0


def test_nn_descent_recall(spark):
    t = spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in nn_descent.search_table(t).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    want = _top(lambda x, y: float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), False)
    hits = sum(len({j for j, _ in v} & set(got[q])) for q, v in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
    big = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = big.toPandas().sort_values("vec_id")
    x = np.stack(rows.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = defaultdict(set)
    for r in nn_descent.search_table(big).collect():
        found[r["query_id"]].add(r["vec_id"])
    ids = rows.vec_id.to_numpy()
    recall = []
    for q in ids[ids % 50 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -2
        recall.append(len(found[q] & set(ids[np.argsort(-s)[:5]].tolist())) / 5)
    assert np.mean(recall) >= 0.9


def test_mixing(spark, docs, empty):
    t = spark.read.parquet(f"{SF}/documents.parquet")
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    got = sorted(tuple(r) for r in mixing.plan(t).select(*cols).collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    assert got == sorted(con.execute(mixing.PLAN_SQL).fetchall())
    p = mixing.plan(docs).toPandas()
    assert (p.taken <= 3 * p["size"]).all() and len(p) == len(ROWS)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len(re.findall(mixing.WORD, r["text"] or "")) for r in mixed.collect()) == p.taken.sum()
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(500):
        s = [rng.randint(1, rng.choice([1, 2, 26])) for _ in range(rng.randint(0, 30))]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("many", [20_000, 2])
def test_suffix_dedup(spark, monkeypatch, many, empty):
    monkeypatch.setattr(suffix_dedup, "MANY_RUNS", many)
    rng = random.Random(2)
    pool = ["".join(rng.choice("ab é\n") for _ in range(rng.choice([30, 49, 50, 51, 80, 200]))) for _ in range(9)]
    rows = [(rng.randrange(30), "".join(rng.choice(pool)[rng.randint(0, 9):] for _ in range(rng.randint(0, 5)))) for _ in range(40)]
    rows += [rows[0], (4, "x" * 200), (5, "x" * 90), (6, None)]
    first: dict[bytes, int] = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(i, first.get(b[p : p + 50], i))
    want = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\x01" * 50
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).drop("spans").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_toxicity(spark, docs, empty):
    clean = [(i, f"a calm note about item {i} and its colour", 0) for i in range(150)]
    toxic = [(200 + i, f"you are a scum idiot number {i} and a loser", 1) for i in range(60)]
    rows = clean + toxic
    t = spark.createDataFrame([(i, x) for i, x, _ in rows] + [(None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_table(t, labels).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] for i, _ in held) and not got[None]["held_out"]
    assert np.mean([got[i]["predicted"] == y for i, y in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = toxicity.score_table(docs, labels.limit(0)).collect()
    assert len(none) == len(ROWS) and {r["score"] for r in none} == {0.0}
    assert toxicity.remove_toxic(docs, labels).columns == docs.columns


PAGE = """<html><head><title>no</title></head><body><header><h1>no</h1></header><nav><a href=x>no</a></nav><div class="wrap-7">
<article><header><h1>T &amp; &eacute;</h1></header><p>One
 two<p>Three <a href=x>link</a><ul><li>a<li>b</ul><aside>no</aside><div class="ad-box">no</div><form>no</form>
<script>if(a<b){"</p>no"}</script></article><div class="comments"><p>no</p></div></div><footer>no</footer>"""


def test_main_text_of_the_pages_against_another_parser(spark):
    """These pages hold one article of headings and paragraphs: read it by the standard library's parser."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.found = False, [""]

        def handle_starttag(self, tag, attrs):
            if tag == "article":
                self.inside = True
            elif tag == "br":
                self.found[-1] += " "
            elif tag in ("p", "h1"):
                self.found.append("")

        def handle_endtag(self, tag):
            if tag == "article":
                self.inside = False
            elif tag in ("p", "h1"):
                self.found.append("")

        def handle_data(self, data):
            if self.inside:
                self.found[-1] += data

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(pages).collect()}
    for r in pages.collect():
        parser = Article()
        parser.feed(r["html"] or "")
        parser.close()
        want = [" ".join(t.split()) for t in parser.found]
        assert got[r["page_id"]] == "\n\n".join(t for t in want if t), r["page_id"]


def _kept(body):
    return "\n\n".join(t for _, t, *_ in html_extract.blocks(f"<html><body>{body}</body></html>"))


def test_article_keeps_sections_named_like_boilerplate():
    parts = ['<h2 id="related-work">Related work</h2>', '<h2 id="social-history">Social history</h2>', '<p class="notice">Take note.</p>',
             '<section id="skip-connections"><h3>Skip</h3><p>They add.</p></section>', '<p id="comment-on-method">A remark.</p>']
    want = "Related work\n\nSocial history\n\nTake note.\n\nSkip\n\nThey add.\n\nA remark."
    article = f"<article><p>Start of it.</p>{''.join(parts)}</article>"
    drop = ('<div class="ad">Buy</div><div id="sidebar">Side</div><form><p>Your mail</p></form><div class="cookie-message">We use cookies</div>'
            '<div class="comments"><article class="comment"><p>First!</p></article></div>')
    for page in (article, drop + article + drop, f'<form action="/">{article}<input name="q"></form>', f'<div class="has-sidebar"><main>{article}</main></div>',
                 article.replace("</article>", '<div class="ad">Buy</div><div class="related-posts"><a href="/">One</a> <a href="/">Two</a></div></article>')):
        assert _kept(page) == "Start of it.\n\n" + want, page
    # without an article element, a form that holds the page
    assert _kept("<form>" + "<p>Long text of the page.</p>" * 9 + "</form><p>And more.</p>") == "\n\n".join(["Long text of the page."] * 9 + ["And more."])


@pytest.mark.parametrize("page", [
    "<a " * 350_000, "<a \"" * 250_000 + ">", "<div>x" * 170_000, "<p>x" * 250_000, "</div" * 200_000, "<div></p>" * 110_000,
    "<!--" * 250_000, "<script>" * 130_000, "<ul><li>x" * 110_000, "<" * 1_000_000, "&" * 1_000_000, "<a '\">" * 200_000])
def test_reading_is_linear_in_the_page(page):
    import time

    start = time.process_time()
    found = html_extract.blocks(page)
    html_extract.extract(found, None)
    assert time.process_time() - start < 5


def test_main_text_edges(spark):
    schema = "page_id long, url string, html string, host string, path string, text string"
    empty_pages = spark.createDataFrame([], schema)
    assert html_extract.main_text(empty_pages).count() == 0
    same = "<div class='{}'><p>Text of equal weight.</p></div>"
    rows = [(1, "http://h/a", same.format("b") + same.format("a"), "x", "y", "z"), (1, "http://h/a", same.format("b") + same.format("a"), "x", "y", "z"),
            (None, None, None, None, None, None), (3, "no host", "", "", "", "")]
    got = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html_extract.main_text(spark.createDataFrame(rows, schema)).collect())
    assert got[0] == (0, "", 0) and got[3] == (3, "", 0) and got[1] == got[2] and "Text of equal weight." in got[1][1]


def test_main_text(spark):
    rows = [(1, "http://h.example/a", PAGE), (2, "http://h.example/b", None), (3, None, ""), (4, "http://other/", "plain <b>text"), (1, "http://h.example/a", PAGE)]
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    text = "T & é\n\nOne two\n\nThree link\n\na\n\nb"
    assert got == [(1, text, len(text))] * 2 + [(2, "", 0), (3, "", 0), (4, "plain text", 10)]


NESTED = {
    "section": "<section><p>{0}</p></section><section><p>{0}</p></section>", "list": "<ul><li>{0}</li><li>{0}</li></ul>",
    "table": "<table><tr><td>{0}</td></tr><tr><td>{0}</td></tr></table>", "quote": "<blockquote><p>{0}</p><p>{0}</p></blockquote>",
}


@pytest.mark.parametrize("around", ["article", "div class=text"])
def test_main_text_keeps_what_stands_beside_nested_parts(spark, around):
    long, rows, want = "a long sentence of the story " * 20, [], {}
    for i, (kind, part) in enumerate(NESTED.items()):
        body = f"<{around}><h1>Title</h1><p>lead</p>{part.format(long)}<ul><li>beside</ul></{around.split()[0]}>"
        rows.append((i, f"http://{kind}/x", f"<body><div class=top><a href=x>menu</a> login</div><div class=page>{body}</div><footer>no</footer></body>"))
        want[i] = "\n\n".join(["Title", "lead", long.strip(), long.strip(), "beside"])
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
