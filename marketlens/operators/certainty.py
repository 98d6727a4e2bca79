"""Certainty of a market's resolved price (J2, W1, D5a-e, J3).

For each market: traded volume, last price, VWAP and TWAP of the YES-side
price, and the certainty |x - 0.5| * 2 of each. One shuffle of the trade tape
by market (by (market, chunk) for hot markets); the market attributes are attached *after* aggregation so
wide text columns never travel with trades.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions import certainty_score, safe_bigint
from marketlens.operators import skew
from marketlens.operators.joins import fits_broadcast, join_small

ORDER = ("timestamp", "block_number", "log_index")


def eligible_markets(markets: DataFrame) -> DataFrame:
    """Market attributes keyed by the numeric market id."""
    return markets.select(
        safe_bigint("id").alias("market_id"), "question", "token1", "token2",
        "outcome_prices", "predicted_label", "event_tags_json",
    )


def normalize_trades(trades: DataFrame, markets: DataFrame, markets_fit: bool | None = None) -> DataFrame:
    """Keep trades on one of the market's two tokens; price as the YES
    side (token1 -> p, token2 -> 1 - p). Only (id, token1, token2) of the
    market table is joined, sized-checked for broadcast."""
    slim = markets.select(safe_bigint("id").alias("market_id"), "token1", "token2")
    t = trades.select(safe_bigint("market_id").alias("market_id"), *ORDER, "asset_id", "price", "usd_amount")
    j = join_small(t, slim, "market_id", "inner", fits=markets_fit)
    j = j.where((F.col("asset_id") == F.col("token1")) | (F.col("asset_id") == F.col("token2")))
    p = (F.when(F.col("asset_id") == F.col("token1"), F.col("price"))
         .when(F.col("asset_id") == F.col("token2"), F.lit(1.0) - F.col("price")))
    return j.select("market_id", *ORDER, p.alias("p"), "usd_amount")


_DETECT = object()


def market_price_stats(norm: DataFrame, *, rows_per_task: int = skew.ROWS_PER_TASK, hot=_DETECT) -> DataFrame:
    """D5a-d per market from normalised trades (market_id, ORDER..., p, usd_amount).

    Hot markets are split into time-ordered chunks; the lead() of the last
    trade of a chunk is the first trade of the next chunk, restored from a
    one-row-per-chunk summary, so the TWAP numerator is exact.
    """
    if hot is _DETECT:
        hot = skew.hot_keys(norm, "market_id", rows_per_task)
    t = norm.withColumn(skew.CHUNK, F.lit(0).cast("long"))
    if hot is not None:
        normal, chunked = skew.split(norm, "market_id", ORDER, hot)
        t = normal.withColumn(skew.CHUNK, F.lit(0).cast("long")).unionByName(chunked)
    w = skew.chunk_window("market_id", *ORDER)
    t = t.withColumn("_next_ts", F.lead("timestamp").over(w))
    order_struct = F.struct(*ORDER)
    held = F.when(F.col("_next_ts").isNotNull(),
                  F.col("p") * (F.col("_next_ts") - F.col("timestamp"))).otherwise(F.lit(0.0))
    per_chunk = t.groupBy("market_id", skew.CHUNK).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("usd_amount").alias("vol"),
        F.sum(F.col("p") * F.col("usd_amount")).alias("pv"),
        F.sum("p").alias("sum_p"),
        F.count("p").alias("cnt_p"),
        F.min("timestamp").alias("t_first"),
        F.max("timestamp").alias("t_last"),
        # arg-max ignoring NULL prices (rows with a NULL ordering are skipped)
        F.max_by("p", F.when(F.col("p").isNotNull(), order_struct)).alias("last_p"),
        F.max(F.when(F.col("p").isNotNull(), order_struct)).alias("last_ord"),
        # price of the chunk's final trade, NULL or not (it holds until the next chunk)
        F.max_by("p", order_struct).alias("edge_p"),
        F.sum(held).alias("held"),
        F.first("p").alias("any_p"),
    )
    per_chunk = skew.next_chunk_first(per_chunk, "market_id", ["t_first"])
    edge = F.when(F.col("next_t_first").isNotNull(),
                  F.col("edge_p") * (F.col("next_t_first") - F.col("t_last"))).otherwise(F.lit(0.0))
    agg = per_chunk.groupBy("market_id").agg(
        F.sum("n").alias("n"),
        F.sum("vol").alias("volume"),
        F.sum("pv").alias("pv"),
        F.sum("sum_p").alias("sum_p"),
        F.sum("cnt_p").alias("cnt_p"),
        F.min("t_first").alias("t_min"),
        F.max("t_last").alias("t_max"),
        F.max_by("last_p", "last_ord").alias("last_price"),
        # unknown parts count nothing, as in a sum over all trades; the others of their chunk stay
        F.sum(F.coalesce("held", F.lit(0.0)) + F.coalesce(edge, F.lit(0.0))).alias("held"),
        F.first("any_p").alias("any_p"),
    )
    vwap = F.when(F.col("volume") == 0, F.lit(None)).otherwise(F.col("pv") / F.col("volume"))
    span = (F.col("t_max") - F.col("t_min")).cast("double")
    twap = (F.when(F.col("n") == 1, F.col("any_p"))
            .when(F.col("t_max") == F.col("t_min"), F.try_divide(F.col("sum_p"), F.col("cnt_p")))
            .otherwise(F.col("held") / span))
    return agg.select("market_id", "volume", "last_price", vwap.alias("vwap"), twap.alias("twap"))


def certainty(trades: DataFrame, markets: DataFrame, *, rows_per_task: int = skew.ROWS_PER_TASK) -> DataFrame:
    """market_uncertainty rows (market_id BIGINT, question, volume,
    last_price, uncertainty_last, twap, uncertainty_twap, vwap,
    uncertainty_vwap, outcome_prices, predicted_label, event_tags_json)."""
    # One size check of the market table serves both joins against it; it and
    # the hot-market detection (on all trades: a superset only plans more
    # pieces) are independent jobs and run concurrently.
    keys = trades.select(safe_bigint("market_id").alias("market_id"))
    with ThreadPoolExecutor(max_workers=2) as pool:
        fit_f = pool.submit(fits_broadcast, markets)
        hot_f = pool.submit(skew.hot_keys, keys, "market_id", rows_per_task)
        fit, hot = fit_f.result(), hot_f.result()
    stats = market_price_stats(normalize_trades(trades, markets, fit), hot=hot)
    attrs = eligible_markets(markets).drop("token1", "token2")
    out = join_small(stats, attrs, "market_id", "inner", fits=fit)
    return out.select(
        "market_id", "question", "volume", "last_price",
        certainty_score("last_price").alias("uncertainty_last"),
        "twap", certainty_score("twap").alias("uncertainty_twap"),
        "vwap", certainty_score("vwap").alias("uncertainty_vwap"),
        "outcome_prices", "predicted_label", "event_tags_json",
    )


def certainty_of(scores: DataFrame, market_id: str) -> DataFrame:
    """One market's scores, the text id cast safely; first row only."""
    wanted = safe_bigint(F.lit(market_id))
    return scores.where(F.col("market_id") == wanted).select(
        "market_id", "twap", "uncertainty_twap", "vwap", "uncertainty_vwap",
        "last_price", "uncertainty_last").limit(1)


def audit(df: DataFrame, label_col: str = "predicted_label") -> DataFrame:
    """Rows written and rows without a label, as one row."""
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.count_if(F.col(label_col).isNull()).alias("null_labels"))
