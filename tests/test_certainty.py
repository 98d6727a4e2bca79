from pyspark.sql import Row

from marketlens.operators import certainty as C
from marketlens.sources import fixtures as fx

from conftest import SF01

BUDGET = 5


def _trades(spark, rows):
    return spark.createDataFrame(
        [Row(market_id=m, timestamp=t, block_number=b, log_index=l, asset_id=a, price=p, usd_amount=u)
         for (m, t, b, l, a, p, u) in rows],
        "market_id string, timestamp long, block_number long, log_index long, asset_id string, price double, usd_amount double")


def _markets(spark, ids):
    return spark.createDataFrame(
        [Row(id=i, question=f"q{i}", token1="Y", token2="N", outcome_prices="[]", predicted_label="Stochastic",
             event_tags_json="[]") for i in ids])


def _by_id(df):
    return {r["market_id"]: r for r in df.collect()}


def test_twap_cases(spark):
    trades = _trades(spark, [
        # single trade -> its price
        ("1", 100, 1, 0, "Y", 0.8, 10.0),
        # all at one instant -> mean price (N side flips to 1-p)
        ("2", 100, 1, 0, "Y", 0.2, 1.0), ("2", 100, 1, 1, "N", 0.2, 1.0),
        # time weighted; last trade carries no weight; tie on timestamp broken by block/log
        ("3", 0, 1, 0, "Y", 0.5, 1.0), ("3", 10, 2, 0, "Y", 0.7, 1.0), ("3", 10, 2, 1, "Y", 0.9, 1.0),
        ("3", 40, 3, 0, "Y", 0.1, 1.0),
        # zero volume -> NULL vwap; unknown token dropped
        ("4", 0, 1, 0, "Y", 0.3, 0.0), ("4", 5, 1, 1, "Y", 0.6, 0.0), ("4", 6, 1, 2, "Z", 0.6, 5.0),
    ])
    out = _by_id(C.certainty(trades, _markets(spark, ["1", "2", "3", "4"])))
    assert out[1]["twap"] == 0.8 and out[1]["last_price"] == 0.8
    assert abs(out[2]["twap"] - 0.5) < 1e-12 and abs(out[2]["last_price"] - 0.8) < 1e-12
    # (0.5*10 + 0.7*0 + 0.9*30) / 40
    assert abs(out[3]["twap"] - (0.5 * 10 + 0.9 * 30) / 40) < 1e-12
    assert out[3]["last_price"] == 0.1
    assert out[4]["vwap"] is None and out[4]["volume"] == 0.0
    assert abs(out[4]["uncertainty_twap"] - abs(out[4]["twap"] - 0.5) * 2) < 1e-12


def test_hot_key_chunks_match_unsplit(spark):
    trades = fx.fx_trades(spark, SF01)
    markets = fx.fx_markets(spark, SF01)
    base = _by_id(C.certainty(trades, markets))
    split = _by_id(C.certainty(trades, markets, rows_per_task=BUDGET))
    assert base.keys() == split.keys() and len(base) == 150
    for k, r in base.items():
        s = split[k]
        for c in ("volume", "last_price", "twap", "vwap"):
            assert abs(r[c] - s[c]) < 1e-9, (k, c, r[c], s[c])


def test_null_prices_at_one_instant_give_null_twap(spark):
    trades = _trades(spark, [("5", 100, 1, 0, "Y", None, 1.0), ("5", 100, 1, 1, "Y", None, 2.0)])
    out = _by_id(C.certainty(trades, _markets(spark, ["5"])))
    assert out[5]["twap"] is None and out[5]["last_price"] is None and out[5]["volume"] == 3.0


def test_chunks_that_end_without_a_price_keep_their_time(spark):
    rows = [("5", 100 + 10 * i, 1, i, "Y", None if i % 3 == 2 else 0.1 + 0.02 * i, 1.0) for i in range(24)]
    trades, markets = _trades(spark, rows), _markets(spark, ["5"])
    whole = C.certainty(trades, markets).first()
    for budget in (1, 3, 4):
        assert abs(C.certainty(trades, markets, rows_per_task=budget).first()["twap"] - whole["twap"]) < 1e-9
