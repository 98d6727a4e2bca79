"""The time-series build against plain loops over the stated rules
on hand-built markets (filter edges, flat volatility, sparse bins)."""

import math

import numpy as np
from pyspark.sql import Row

from marketlens.plans import timeseries as TS


def _market_trades():
    rows = []

    def add(m, times, prices, usd=200.0):
        for i, (t, p) in enumerate(zip(times, prices)):
            rows.append((m, int(t), i, float(p) if p is not None else None, usd))

    rng = np.random.default_rng(7)
    # normal market: 80 trades over ~40 bins with a random walk
    t = np.sort(rng.integers(0, 40 * 1800, 80)) + 1_704_067_200
    add("walk", t, np.clip(0.5 + np.cumsum(rng.normal(0, 0.03, 80)), 0.05, 0.95))
    # alternating price: constant rolling stdev -> z fallback 0
    add("flat", 1_704_067_200 + np.arange(60) * 1500, [0.4 if i % 2 else 0.6 for i in range(60)])
    # 49 vs 50 trades
    add("n49", 1_704_067_200 + np.arange(49) * 1800, np.linspace(0.3, 0.7, 49))
    add("n50", 1_704_067_200 + np.arange(50) * 1800, np.linspace(0.3, 0.7, 50))
    # trades only at both ends of a long span -> dead middle
    ends = list(1_704_067_200 + np.arange(30) * 60) + list(1_704_067_200 + 200 * 1800 + np.arange(30) * 60)
    add("ends", ends, np.linspace(0.2, 0.8, 60))
    # 23 vs 24 bins
    add("b23", 1_704_067_200 + np.linspace(0, 22 * 1800, 60).astype(int), np.linspace(0.2, 0.6, 60))
    add("b24", 1_704_067_200 + np.linspace(0, 23 * 1800, 60).astype(int), np.linspace(0.2, 0.6, 60))
    # small money
    add("poor", 1_704_067_200 + np.arange(60) * 1800, np.linspace(0.2, 0.6, 60), usd=50.0)
    # a NULL price in the middle
    p = list(np.linspace(0.3, 0.8, 70))
    p[33] = None
    add("nullp", 1_704_067_200 + np.arange(70) * 900, p)
    return rows


def _spread(values):
    """Sample standard deviation; None below two values."""
    if len(values) < 2:
        return None
    middle = math.fsum(values) / len(values)
    return math.sqrt(math.fsum((v - middle) ** 2 for v in values) / (len(values) - 1))


def _zscores(prices):
    """Per trade: the deviation of its last ten log returns, in units of the market's own spread of that."""
    returns = [None]
    for old, new in zip(prices, prices[1:]):
        known = old is not None and new is not None and new > 0
        returns.append(math.log(new / max(old, 0.0001)) if known else None)
    rolling = []
    for i in range(len(returns)):
        last = returns[max(0, i - 9) : i + 1]
        rolling.append(_spread(last) if len(last) == 10 and None not in last else None)
    there = [v for v in rolling if v is not None]
    unit = _spread(there)
    if unit is None or unit < 0.00001:
        return [0.0] * len(prices)
    centre = math.fsum(there) / len(there)
    return [None if v is None else max(-20.0, min(20.0, (v - centre) / unit)) for v in rolling]


def _passes(trades, per_bin, first, last):
    """The quality rules, one after the other, on a market's trades and its trades per bin."""
    prices = [p for _, p, _ in trades if p is not None]
    length = last - first + 1
    inner = range(first + math.floor(length * 0.2), first + math.floor(length * 0.8))
    rules = (
        len(trades) >= 50,
        sum(usd for _, _, usd in trades) >= 5000,
        not prices or max(prices) - min(prices) >= 0.10,
        length >= 24,
        sum(per_bin.get(x, 0) for x in inner) / len(trades) >= 0.05,
    )
    return all(rules)


def _brute(rows):
    """Rows (market, bin, price, z, yes, no, yes count, no count, count) of the markets that pass, trade by trade."""
    markets = {}
    for market, when, seq, price, usd in rows:
        markets.setdefault(market, []).append((when, seq, price, usd))
    out = []
    for market, found in sorted(markets.items()):
        trades = [(when // 1800, price, usd) for when, _, price, usd in sorted(found, key=lambda r: r[:2])]
        scores = _zscores([p for _, p, _ in trades])
        cells, before = {}, None
        for (at, price, usd), z in zip(trades, scores):
            cell = cells.setdefault(at, {"price": None, "z": None, "money": [0.0, 0.0], "trades": [0, 0]})
            side = 1 if price is not None and before is not None and price < before else 0
            cell["money"][side] += usd
            cell["trades"][side] += 1
            cell["price"] = cell["price"] if price is None else price
            cell["z"] = cell["z"] if z is None else z
            before = price
        first, last = min(cells), max(cells)
        if not _passes(trades, {k: sum(c["trades"]) for k, c in cells.items()}, first, last):
            continue
        price, z = None, 0.0
        for at in range(first, last + 1):
            cell = cells.get(at, {"price": None, "z": None, "money": (0.0, 0.0), "trades": (0, 0)})
            price = price if cell["price"] is None else cell["price"]
            z = z if cell["z"] is None else cell["z"]
            out.append((market, at, price, z, *cell["money"], *cell["trades"], sum(cell["trades"])))
    return out


def _close(a, b):
    if a is None or (isinstance(a, float) and math.isnan(a)):
        return b is None or (isinstance(b, float) and math.isnan(b))
    return b is not None and abs(a - b) <= 1e-9 * max(1.0, abs(a))


def test_dense_series_equals_loops(spark):
    rows = _market_trades()
    quant = spark.createDataFrame([Row(market_id=m, timestamp=t, seq=s, price=p, usd_amount=u)
                                   for m, t, s, p, u in rows],
                                  "market_id string, timestamp long, seq long, price double, usd_amount double")
    ids = sorted({r[0] for r in rows})
    markets = spark.createDataFrame(
        [(i, "q", "Stochastic", 1704067200, 1704067200 + 5 * 86400, '[{"slug":"crypto","label":"Crypto"}]')
         for i in ids],
        "id string, question string, predicted_label string, created_s long, end_s long, event_tags_json string")
    b = TS.build(quant, markets)
    got = {(r["market_id"], r["bin"]): r for r in b.dense.collect()}
    want = {(m, bn): (p, z, y, n, yc, nc, tc) for m, bn, p, z, y, n, yc, nc, tc in _brute(rows)}
    assert {k[0] for k in want} == {k[0] for k in got}
    assert {"walk", "flat", "n50", "b24", "nullp"} <= {k[0] for k in want}
    assert not ({"n49", "ends", "b23", "poor"} & {k[0] for k in got})
    assert got.keys() == want.keys()
    for k, (p, z, y, n, yc, nc, tc) in want.items():
        r = got[k]
        assert _close(p, r["price"]) and _close(z, r["zscore"]), (k, p, r["price"], z, r["zscore"])
        assert _close(y, r["yes_volume"]) and _close(n, r["no_volume"]), k
        assert (yc, nc, tc) == (r["yes_count"], r["no_count"], r["trade_count"]), k
    flat = [r["zscore"] for k, r in got.items() if k[0] == "flat"]
    assert set(flat) == {0.0}


from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@st.composite
def _random_market_rows(draw):
    rows = []
    for m in ("m1", "m2", "m3"):
        n = draw(st.integers(min_value=45, max_value=90))
        span = draw(st.integers(min_value=20, max_value=60)) * 1800
        times = sorted(draw(st.lists(st.integers(min_value=0, max_value=span), min_size=n, max_size=n)))
        prices = draw(st.lists(st.sampled_from([0.1, 0.25, 0.4, 0.5, 0.55, 0.7, 0.9, None]), min_size=n, max_size=n))
        for i, (t, p) in enumerate(zip(times, prices)):
            rows.append((m, 1_704_067_200 + t, i, p, 150.0))
    return rows


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture,
                                                                 HealthCheck.too_slow])
@given(_random_market_rows())
def test_random_markets_equal_loops_split_and_unsplit(spark, rows):
    quant = spark.createDataFrame(rows, "market_id string, timestamp long, seq long, price double, usd_amount double")
    markets = spark.createDataFrame(
        [(i, "q", "Stochastic", 1704067200, 1704067200 + 5 * 86400, '[{"slug":"crypto","label":"Crypto"}]')
         for i in ("m1", "m2", "m3")],
        "id string, question string, predicted_label string, created_s long, end_s long, event_tags_json string")
    want = {(m, bn): v for m, bn, *v in _brute(rows)}
    for budget in (1000, 10):
        got = {(r["market_id"], r["bin"]): r for r in TS.build(quant, markets, rows_per_task=budget).dense.collect()}
        assert got.keys() == want.keys()
        for k, (p, z, y, n, yc, nc, tc) in want.items():
            r = got[k]
            assert _close(p, r["price"]) and _close(z, r["zscore"]), (budget, k, p, r["price"], z, r["zscore"])
            assert _close(y, r["yes_volume"]) and _close(n, r["no_volume"]), k
            assert (yc, nc, tc) == (r["yes_count"], r["no_count"], r["trade_count"]), k
