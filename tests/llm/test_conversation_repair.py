"""Conversation repair against a plain search over all edits, whole and in parts."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from marketlens.llm import conversation_repair as cr

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, part int, seq string"


def state(out):
    """What a string of output initials can still become: itself, short; None if nothing legal."""
    if out in ("", "s"):
        return out
    body = out[1:] if out[0] == "s" else out
    return {"u": "u", "a": "ua"}[body[-1]] if re.fullmatch(r"(ua)*u?", body) else None


def search(rows):
    """Least (cost, audit, repaired rows) by trying every edit, one row after the other."""

    def put(layer, out, c, a, kept):
        key = state(out)
        if key is not None and (key not in layer or (c, a) < layer[key][:2]):
            layer[key] = (c, a, kept)

    def with_inserts(layer):
        for _ in range(3):
            for out, (c, a, kept) in list(layer.items()):
                for name in ("user", "assistant"):
                    put(layer, out + name[0], c + 3, a + "I", [*kept, (name, "")])
        return layer

    layer = with_inserts({"": (0, "", [])})
    for initial, role, text, must, cut in rows:
        new, extra = {}, 3 if cut else 0
        for out, (c, a, kept) in layer.items():
            put(new, out, c + 4, a + "D", kept)
            if not must:
                if initial:
                    put(new, out + initial, c + extra, a + "K", [*kept, (role, text)])
                for name in ("user", "assistant"):
                    put(new, out + name[0], c + 3 + extra, a + "R", [*kept, (name, text)])
        layer = with_inserts(new)
    cost, audit, kept = min((v for out, v in layer.items() if out in ("", "ua")), key=lambda v: v[:2])
    assert re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] for r, _ in kept))
    return cost, audit, kept


def expected(table):
    """Contract columns by conv_id for rows (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    for conv, turn, role, text in table:
        convs[conv]
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        convs[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, lattice, counts = set(), [], [0, 0, 0]
        for _, role, text in rows:
            body = re.findall(r"[^\x20\x09-\x0D]", text)
            blank, dup, cut = not body, (role, text) in seen, bool(body) and body[-1] not in ".!?"
            seen.add((role, text))
            for i, x in enumerate((blank, dup, cut)):
                if x:
                    counts[i] += 1
                    break
            lattice.append((role[:1], role, text, blank or dup, cut))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(lattice, lattice[1:]))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, kept = search(lattice)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[conv] = (gaps, *counts, illegal, cost, audit, sha)
    return out


def got(df):
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[c] for c in cr.COLUMNS[1:]) for r in rows}


def made(seed, convs, most):
    rng, rows = random.Random(seed), []
    texts = ["Hi.", "Yes!", "no end", "", " \n", "Why?", "So. ", "long " * 30, "x.y"]
    for c in [*range(convs), None]:
        for _ in range(rng.randint(1, most)):
            rows.append((c, rng.choice([*range(12), None]), rng.choice(["user", "assistant", "system", "tool", "ua", "", None]), rng.choice([*texts, None])))
    return rows


def test_lattice_against_search_and_chained_parts():
    rng = random.Random(3)
    for _ in range(400):
        rows = [(rng.choice("suaasux") if rng.random() < 0.95 else "", rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 9))]
        want = search([(i, i, "t", m, c) for i, m, c in rows])[:2]
        assert cr.cheapest(rows) == want
        cut = rng.randint(0, len(rows))
        ways = [cr.cheapest(rows[:cut], 0, (m,)) for m in range(4)]
        rest = [cr.cheapest(rows[cut:], m) for m in range(4)]
        assert min((a[0] + b[0], a[1] + b[1]) for a, b in zip(ways, rest, strict=True) if a and b) == want


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_made_rows(spark, parts):
    rows = made(parts, 60, 9)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert got(cr.repair_table(df, parts)) == expected(rows)


def test_long_conversation_in_blocks(spark):
    rng = random.Random(9)
    rows = [(5, t, rng.choice(["user", "assistant", "assistant", "system"]), f"Line {rng.randint(0, 400)}" + rng.choice([".", ""])) for t in range(9000)]
    rows += [(6, 0, "user", "Hi."), (4, 0, "user", "Hi.")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    want = expected(rows)
    assert got(cr.repair_table(df, 1)) == want
    assert got(cr.repair_table(df, 7)) == want


def test_equal_rows_may_cross_an_edge(spark):
    rows = [(1, None, "user", "Same.")] * 300 + [(1, None, "assistant", "Same.")] * 300
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert got(cr.repair_table(df, 8)) == expected(rows)


def test_empty_and_given_tables(spark):
    assert cr.repair_table(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert got(cr.repair_table(df)) == expected(rows)
