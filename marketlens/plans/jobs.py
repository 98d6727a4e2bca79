"""End-to-end batch jobs: read inputs, compute, write range-partitioned
Parquet outputs, report audits. These are what a scheduled run executes;
each step is the same operator the registered queries use.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from marketlens.operators import certainty as C
from marketlens.operators import enrich as EN
from marketlens.plans import timeseries as TS
from marketlens.sources import cached, read_parquet, save, upsert_into


def certainty_job(spark: SparkSession, trades_path: str, markets_path: str, out_path: str) -> dict:
    """market_uncertainty: one job over all markets (no hash batches), output
    range-partitioned by market_id; returns the audit (rows, NULL labels)."""
    trades = read_parquet(spark, trades_path, ["market_id", "timestamp", "block_number", "log_index",
                                              "asset_id", "price", "usd_amount"])
    markets = read_parquet(spark, markets_path)
    save(C.certainty(trades, markets), out_path, key="market_id")
    audit = C.audit(spark.read.parquet(out_path)).first()
    return {"rows": audit["rows"], "null_labels": audit["null_labels"]}


#: Markets expected in one row group of the written series, for the size of its Bloom filter.
MARKETS_PER_ROW_GROUP = 10_000


def save_timeseries(timeseries: DataFrame, path: str) -> None:
    """The series of all markets as a table made for reading one market."""
    save(timeseries, path, key="market_id", order=["timestamp"], bloom={"market_id": MARKETS_PER_ROW_GROUP})


def timeseries_job(spark: SparkSession, quant: DataFrame, markets: DataFrame, out_dir: str,
                   **kw) -> dict:
    """dashboard_timeseries (range-partitioned and sorted by market and time,
    with a Bloom filter on the market, so a one-market lookup skips row groups) and dashboard_catalog.
    Fails when no market passes the filters; ``kw`` goes to ``timeseries.build``."""
    b = TS.build(quant, markets, **kw)
    kept = b.final_catalog.count()
    if kept == 0:
        raise ValueError("no market is left after the quality filters")
    ts_path = os.path.join(out_dir, "dashboard_timeseries")
    cat_path = os.path.join(out_dir, "dashboard_catalog")
    save_timeseries(b.timeseries, ts_path)
    save(b.final_catalog, cat_path)
    coef = b.impact.first()
    return {"markets": kept, "yes_impact": coef["yes_impact"], "no_impact": coef["no_impact"],
            "rows": spark.read.parquet(ts_path).count()}


def enrichment_job(spark: SparkSession, markets: DataFrame, fetched: DataFrame, cache_path: str, out_path: str, width: int = 100_000) -> dict:
    """Tags of the markets' events: merge what was fetched into the stored
    cache (only its key ranges are rewritten), attach the cache to the markets
    and report the keys that are still missing."""
    ranges = upsert_into(spark, cache_path, fetched, "event_id", "fetched_at", width)
    tags = cached(spark, cache_path)
    save(EN.attach_tags(markets.drop("event_tags_json"), tags), out_path, key="id")
    counts = EN.key_counts(markets, tags).first().asDict()
    return {"ranges_rewritten": ranges, "bad_ids": EN.bad_id_count(markets).first()[0], **counts}


def market_series(spark: SparkSession, timeseries_path: str, market_id: str) -> DataFrame:
    """P2 against the written table: the equality on market_id is pushed to
    the Parquet scan, where the range-sorted files let it skip row groups."""
    return TS.timeseries_of_market(spark.read.parquet(timeseries_path), market_id)


def pushed_filters(df: DataFrame) -> str:
    """The scan's pushed filters, as shown in the physical plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "\n".join(line for line in plan.splitlines() if "PushedFilters" in line)


__all__ = ["certainty_job", "enrichment_job", "save_timeseries", "timeseries_job", "market_series", "pushed_filters"]
