from pyspark.sql import functions as F

from marketlens.operators import tape as TP
from marketlens.plans import timeseries as TS
from marketlens.sources import fixtures as fx

from conftest import SF01

BUDGET = 7
COLS = ["price_diff", "yes_vol", "no_vol", "ret", "roll_std", "zscore", "future_z"]


def _rows(df):
    return {(r["market_id"], r["timestamp"], r["seq"]): r for r in df.select("market_id", "timestamp", "seq", *COLS).collect()}


def _close(a, b):
    if a is None or b is None:
        return a is None and b is None
    return abs(a - b) <= 1e-9 * max(1.0, abs(a))


def test_chunked_features_equal_whole_market_features(spark):
    q = fx.fx_quant(spark, SF01)
    base = _rows(TP.trade_features(q))
    split = _rows(TP.trade_features(q, rows_per_task=BUDGET))
    assert base.keys() == split.keys()
    for k, r in base.items():
        s = split[k]
        for c in COLS:
            assert _close(r[c], s[c]), (k, c, r[c], s[c])


def test_build_funnel_matches_fixture_notes(spark):
    b = TS.build(fx.fx_quant(spark, SF01), fx.fx_markets(spark, SF01))
    assert b.catalog.count() == 505
    assert b.quality.count() == 50
    assert b.quality.where("keep").count() == 28
    assert b.timeseries.count() == 39267
    # dense bins per market = max - min + 1, and bin counts sum to the trades
    per = b.dense.groupBy("market_id").agg(F.count(F.lit(1)).alias("n"), F.sum("trade_count").alias("t"))
    q = b.quality.where("keep").select("market_id", "n_bins", "n_trades")
    bad = per.join(q, "market_id").where("n <> n_bins OR t <> n_trades").count()
    assert bad == 0


def test_mixed_hot_and_normal_markets(spark):
    q = fx.fx_quant(spark, SF01)
    hot = q.withColumn("market_id", F.when(F.col("seq") % 3 == 0, F.lit("7")).otherwise(F.col("market_id")))
    base = _rows(TP.trade_features(hot))
    split = _rows(TP.trade_features(hot, rows_per_task=500))
    assert base.keys() == split.keys()
    for k, r in base.items():
        for c in COLS:
            assert _close(r[c], split[k][c]), (k, c, r[c], split[k][c])


def test_repeated_trades_on_both_sides_of_a_chunk_edge(spark):
    rows = [("7", 10 * (i // 3), i // 3, 0.2 + (i // 3) * 7 % 10 / 20, 1.0) for i in range(120)]  # every trade three times
    q = spark.createDataFrame(rows, "market_id string, timestamp long, seq long, price double, usd_amount double")

    def found(df):
        got = [(r["seq"], *[None if r[c] is None else round(r[c], 9) + 0.0 for c in COLS]) for r in df.collect()]
        return sorted(got, key=lambda t: [(v is not None, v or 0) for v in t])

    assert found(TP.trade_features(q, rows_per_task=BUDGET)) == found(TP.trade_features(q))
