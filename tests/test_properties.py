"""Property tests: certainty against a brute-force computation, bounds, and
invariance under input repartitioning."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from marketlens.operators import certainty as C

SCHEMA = ("market_id string, timestamp long, block_number long, log_index long, asset_id string, "
          "price double, usd_amount double")

trade = st.tuples(
    st.sampled_from(["1", "2", "3"]),
    st.integers(min_value=0, max_value=50),          # few distinct times -> ties
    st.integers(min_value=0, max_value=5),
    st.integers(min_value=0, max_value=1000),
    st.sampled_from(["Y", "N", "Z"]),
    st.floats(min_value=0.0, max_value=1.0, allow_nan=False).map(lambda x: round(x, 3)),
    st.floats(min_value=0.0, max_value=100.0, allow_nan=False).map(lambda x: round(x, 2)),
)


def brute(trades):
    out = {}
    by = {}
    for m, t, b, li, a, p, u in trades:
        if a not in ("Y", "N"):
            continue
        by.setdefault(int(m), []).append(((t, b, li), p if a == "Y" else 1 - p, u, t))
    for m, rows in by.items():
        rows.sort(key=lambda r: r[0])
        vol = sum(r[2] for r in rows)
        last = rows[-1][1]
        vwap = None if vol == 0 else sum(r[1] * r[2] for r in rows) / vol
        ts = [r[3] for r in rows]
        if len(rows) == 1:
            twap = rows[0][1]
        elif max(ts) == min(ts):
            twap = sum(r[1] for r in rows) / len(rows)
        else:
            twap = sum(rows[i][1] * (rows[i + 1][3] - rows[i][3]) for i in range(len(rows) - 1)) / (max(ts) - min(ts))
        out[m] = (vol, last, vwap, twap)
    return out


def _close(a, b):
    return (a is None and b is None) or (a is not None and b is not None and abs(a - b) < 1e-9)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(trade, min_size=1, max_size=40, unique_by=lambda r: (r[0], r[1], r[2], r[3])))
def test_certainty_matches_brute_force(spark, trades):
    df = spark.createDataFrame(trades, SCHEMA)
    markets = spark.createDataFrame([(i, f"q{i}", "Y", "N", "[]", "Stochastic", "[]") for i in ("1", "2", "3")],
                                    "id string, question string, token1 string, token2 string, "
                                    "outcome_prices string, predicted_label string, event_tags_json string")
    want = brute(trades)
    for budget in (1000, 2):
        got = {r["market_id"]: r for r in C.certainty(df, markets, rows_per_task=budget).collect()}
        assert set(got) == set(want)
        for m, (vol, last, vwap, twap) in want.items():
            r = got[m]
            assert _close(r["volume"], vol) and _close(r["last_price"], last)
            assert _close(r["vwap"], vwap) and _close(r["twap"], twap), (m, r, want[m])
            ps = [p if a == "Y" else 1 - p for mm, _, _, _, a, p, _ in trades if int(mm) == m and a in ("Y", "N")]
            assert min(ps) - 1e-12 <= r["twap"] <= max(ps) + 1e-12
            if r["vwap"] is not None:
                assert min(ps) - 1e-12 <= r["vwap"] <= max(ps) + 1e-12
            for c in ("uncertainty_last", "uncertainty_twap"):
                assert -1e-12 <= r[c] <= 1 + 1e-12


def test_invariant_under_repartition(spark):
    from marketlens.sources import fixtures as fx
    from conftest import SF01
    t = fx.fx_trades(spark, SF01)
    m = fx.fx_markets(spark, SF01)
    a = sorted(C.certainty(t, m).collect())
    b = sorted(C.certainty(t.repartition(13, "asset_id").sortWithinPartitions("price"), m).collect())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for k in ("volume", "twap", "vwap", "last_price"):
            assert abs(x[k] - y[k]) < 1e-9
