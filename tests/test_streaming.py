import os
import tempfile

from marketlens.operators import rollups as R
from marketlens.sources import fixtures as fx
from marketlens.streaming import bars as SB

from conftest import SF001


def _rows(df):
    return sorted((r["market_id"], r["time_window"], r["transaction_count"], round(r["total_volume"], 6),
                   round(r["avg_price"], 9)) for r in df.collect())


def test_stream_bars_equal_batch_bars(spark):
    base = tempfile.mkdtemp(prefix="ml-stream-")
    src, out, ckpt = (os.path.join(base, d) for d in ("src", "out", "ckpt"))
    trades = fx.fx_quant(spark, SF001)
    trades.write.parquet(src)
    schema = "market_id string, timestamp long, seq long, price double, usd_amount double"
    q = SB.start_bars(spark, src, schema, out, ckpt, interval="1 hour", watermark="3650 days")
    q.awaitTermination(120)
    got = _rows(SB.latest_bars(spark, out))
    want = _rows(R.bars(trades, "1 hour"))
    assert got == want and len(got) > 0


def test_stream_bars_7_day_origin_matches_batch(spark):
    trades = fx.fx_quant(spark, SF001)
    assert _rows(SB.stream_bars(trades, "7 days")) == _rows(R.bars(trades, "7 days"))
