"""Registered queries against their DuckDB oracles on the smallest tables,
plus the driver's smoke entry."""

import pytest

import __spark_entry__ as E
from compare import compare, duck

from conftest import SF001
from marketlens.plans.registry import ORACLES, QUERIES

FAST = ["certainty_scores", "market_summary", "whales", "role_distribution", "bars_7d", "bars_1mo",
        "primary_category", "facets", "ridgeline_density", "ridgeline_cells", "classification_report",
        "stratified_split", "attach_tags", "upsert_latest", "first_n_keys", "spread_sample",
        "anomaly_regions", "series_extent", "liquidity_flags", "timeline_downsampled", "trade_features_split",
        "twap_split", "dashboard_timeseries_raw", "model_metrics", "document_labels", "category_of_mixed_tags", "vwap", "dashboard_timeseries"]


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[:3] == ["market_id", "question", "volume"]


def test_every_query_has_an_oracle_but_model_and_estimate():
    # a trained model and a HyperLogLog estimate have no exact SQL form
    assert set(QUERIES) - set(ORACLES) == {"text_scoring", "role_distribution_approx"}


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(spark, name, SF001, con)
    assert ok, msg
