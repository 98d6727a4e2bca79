import pytest

from marketlens.operators import certainty as C
from marketlens.plans import endpoints as EP
from marketlens.plans import timeseries as TS
from marketlens.sources import fixtures as fx

from conftest import SF01


def test_endpoints_over_fixture_tables(spark):
    b = TS.build(fx.fx_quant(spark, SF01), fx.fx_markets(spark, SF01))
    cat = EP.dashboard_catalog(b.final_catalog).collect()
    assert len(cat) == 28
    series = EP.dashboard_timeseries(b.timeseries, cat[0]["id"]).collect()
    assert series and series[0]["data_points"] == len(series)
    with pytest.raises(ValueError):
        EP.dashboard_timeseries(b.timeseries, "no-such-market")
    scores = C.certainty(fx.fx_trades(spark, SF01), fx.fx_markets(spark, SF01))
    some = scores.select("market_id").first()[0]
    assert EP.market_uncertainty(scores, str(some)).count() == 1
    assert EP.trades_timeseries(fx.fx_quant(spark, SF01), "7", "1 day").count() > 0
    assert EP.users_whales(fx.fx_users(spark, SF01), "7").count() == 10
    assert EP.users_role_distribution(fx.fx_users(spark, SF01), "7").count() == 2
    assert EP.markets_search(fx.fx_markets(spark, SF01), "ame").count() == 50
    r = EP.certainty_volume_ridgeline(fx.fx_certainty(spark, SF01))
    assert r["cells"].count() == 21 and r["density"].count() == 900
