"""The read-side queries of the original dashboard service, one function per
endpoint, over the tables the batch jobs write. Each returns a DataFrame;
parameters are bound as literals (never pasted into SQL text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from marketlens.functions import json_safe
from marketlens.operators import certainty as C
from marketlens.operators import density as DN
from marketlens.operators import rollups as R
from marketlens.plans import timeseries as TS


def dashboard_catalog(catalog: DataFrame) -> DataFrame:
    """Id, question, predicted_label, category."""
    return catalog.select("id", "question", "predicted_label", "category")


def dashboard_timeseries(timeseries: DataFrame, market_id: str) -> DataFrame:
    """P2 + P9 + P10: one market's series in time order, JSON-safe, with its
    point count; an unknown market is an error."""
    s = json_safe(TS.timeseries_of_market(timeseries, market_id))
    return TS.require_rows(s, f"No time-series data found for market ID {market_id}")


def market_uncertainty(scores: DataFrame, market_id: str) -> DataFrame:
    """P3 + P9 + P10: one market's certainty scores (text id cast safely)."""
    s = json_safe(C.certainty_of(scores, market_id))
    return TS.require_rows(s, f"No uncertainty data found for market ID {market_id}")


def certainty_volume_ridgeline(scores: DataFrame) -> dict[str, DataFrame]:
    """The cells (with n and whether a density exists) and the
    densities on the grid."""
    return {"cells": DN.ridgeline_cells(scores), "density": DN.ridgeline_density(scores)}


def markets_summary(markets: DataFrame) -> DataFrame:
    return R.market_summary(markets)


def markets_top_volume(markets: DataFrame, limit: int = 10) -> DataFrame:
    return R.top_markets(markets, limit)


def markets_search(markets: DataFrame, keyword: str) -> DataFrame:
    return R.search(markets, keyword)


def trades_timeseries(quant: DataFrame, market_id: str, interval: str = "1 hour") -> DataFrame:
    """D4 for one market, buckets in time order."""
    return R.bars(quant, interval, market_id=market_id).drop("market_id").orderBy("time_window")


def users_whales(users: DataFrame, market_id: str, limit: int = 10) -> DataFrame:
    return (R.whales(users, market_id, limit)
            .select("address", "role", "total_usd_volume", "total_tokens", "avg_entry_price")
            .orderBy("total_usd_volume", ascending=False))


def users_role_distribution(users: DataFrame, market_id: str) -> DataFrame:
    return R.role_distribution(users, market_id).drop("market_id")
