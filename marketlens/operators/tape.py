"""Trade-tape features per market (W2-W7): tick-test volume split, log
returns, 10-trade rolling volatility and its per-market z-score.

Windows are partitioned by market; the rows of hot markets are cut into
time-ordered chunks (``skew.split``) and their windows by (market, chunk). What
crosses a chunk edge is restored exactly from one-row-per-chunk summaries
joined on (market, chunk):
* the last ``ROLLING_WINDOW`` prices before a chunk (for lag and the first
  nine rolling frames of the chunk),
* the market's mean / stdev of the rolling volatility,
* the first z-score of the next chunk (the regression target of a chunk's
  last trade).
Rows of ordinary markets are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketlens.functions import constants as K
from marketlens.operators import skew
from marketlens.session import write_table

KEY = "market_id"
ORDER = ("timestamp", "seq")
W = K.ROLLING_WINDOW


def _log_return(price: Column, prev: Column) -> Column:
    """ln(p / max(prev, floor)); NULL for the first trade, non-positive
    ratios and NULL prices (log of 0 is treated as missing)."""
    return F.when(prev.isNotNull(), F.ln(price / F.greatest(prev, F.lit(K.MIN_PRICE_FLOOR))))


def last_n(arr: Column, n: int) -> Column:
    """The last n elements of an array (all of it when shorter)."""
    return F.slice(arr, F.greatest(F.size(arr) - F.lit(n - 1), F.lit(1)), F.lit(n))


def _std_of_last(arr: Column, n: int) -> Column:
    """Sample stdev of the ``ret`` field of the last n structs of ``arr``;
    NULL unless there are n entries and none is NULL."""
    last = last_n(arr, n)
    ok = (F.size(arr) >= n) & (F.size(F.filter(last, lambda s: s["ret"].isNull())) == 0)
    mean = F.aggregate(last, F.lit(0.0), lambda acc, s: acc + s["ret"]) / F.lit(float(n))
    ss = F.aggregate(last, F.lit(0.0), lambda acc, s: acc + (s["ret"] - mean) * (s["ret"] - mean))
    return F.when(F.size(arr) >= n, F.when(ok, F.sqrt(ss / F.lit(float(n - 1)))))


_DETECT = object()


def trade_features(quant: DataFrame, *, order: tuple[str, ...] = ORDER, rows_per_task: int = skew.ROWS_PER_TASK,
                   hot=_DETECT) -> DataFrame:
    """Per trade: price_diff, yes_vol, no_vol, is_yes, ret, roll_std, zscore,
    future_z (next trade's z) plus the input columns.

    Markets with at most ``rows_per_task`` trades use one window partition
    each; the rows of the others take the chunked plan. ``hot`` passes the
    result of ``skew.hot_keys`` when the caller already has it.
    """
    if hot is _DETECT:
        hot = skew.hot_keys(quant, KEY, rows_per_task)
    if hot is None:
        return _features_whole_markets(quant, order)
    normal, chunked = skew.split(quant, KEY, order, hot)
    return _features_whole_markets(normal, order).unionByName(_features_chunked(chunked, order).drop(skew.CHUNK))


def _features_chunked(q: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Features of hot-market rows, written with their chunks, by windows per
    (market, chunk). The per-chunk summaries join on (market, chunk), the
    partitioning that the windows need anyway. The rows are written once more
    where the market's statistics are needed, so that nothing before is
    computed twice or lost with an executor."""
    w = skew.chunk_window(KEY, *order)
    whole = Window.partitionBy(KEY, skew.CHUNK)
    q = q.withColumns({"_rn": F.row_number().over(w), "_n": F.count(F.lit(1)).over(whole),
                       "_lag_p": F.lag("price").over(w)})
    w = Window.partitionBy(KEY, skew.CHUNK).orderBy("_rn")  # from here on also trades of one instant keep their order

    # Last W prices of each chunk, then the W prices preceding each chunk
    # (taken from up to W earlier chunks: each has at least one row).
    tails = (q.where(F.col("_rn") > F.col("_n") - W)
              .groupBy(KEY, skew.CHUNK)
              .agg(F.array_sort(F.collect_list(F.struct(skew.CHUNK, "_rn", "price"))).alias("_tail")))
    wc = Window.partitionBy(KEY).orderBy(skew.CHUNK).rowsBetween(-W, -1)
    prior = tails.select(
        KEY, skew.CHUNK,
        F.array_sort(F.flatten(F.collect_list("_tail").over(wc))).alias("_prior"))
    prior = prior.select(KEY, skew.CHUNK, last_n(F.col("_prior"), W).alias("_prior"))
    q = q.join(prior, [KEY, skew.CHUNK], "left")

    prior_prices = F.transform(F.coalesce(F.col("_prior"), F.array()), lambda s: s["price"])
    prev = F.when(F.col("_rn") == 1, F.try_element_at(prior_prices, F.lit(-1))).otherwise(F.col("_lag_p"))
    q = q.withColumns({"_prev": prev})
    diff = F.coalesce(F.col("price") - F.col("_prev"), F.lit(0.0))
    q = q.withColumns({"price_diff": diff, "ret": _log_return(F.col("price"), F.col("_prev"))})
    is_yes = F.col("price_diff") >= 0

    # Rolling stdev over the last W returns. Frames fully inside the chunk use
    # the window aggregate; the first W-1 rows of a chunk prepend the returns
    # of the preceding prices.
    frame = w.rowsBetween(-(W - 1), 0)
    native = F.when(F.count("ret").over(frame) == W, F.stddev_samp("ret").over(frame))
    pp = prior_prices
    prior_rets = F.when(
        F.size(pp) >= 2,
        F.transform(F.sequence(F.lit(2), F.size(pp)),
                    lambda k: F.struct(_log_return(F.element_at(pp, k), F.element_at(pp, k - 1)).alias("ret"))),
    ).otherwise(F.array().cast("array<struct<ret:double>>"))
    # The chunk's own returns up to this row, oldest first, from W-1 lags
    # (cheap offset windows); only rows with rn < W use them.
    lags = [F.struct(F.lag("ret", k).over(w).alias("ret")) for k in range(W - 1, 0, -1)]
    own_all = F.array(*lags, F.struct(F.col("ret").alias("ret")))
    own = F.slice(own_all, F.lit(W + 1) - F.col("_rn"), F.col("_rn"))
    edge = _std_of_last(F.concat(prior_rets, own), W)
    q = q.withColumns({
        "is_yes": is_yes,
        "yes_vol": F.when(is_yes, F.col("usd_amount")).otherwise(F.lit(0.0)),
        "no_vol": F.when(~is_yes, F.col("usd_amount")).otherwise(F.lit(0.0)),
        "roll_std": F.when(F.col("_rn") >= W, native).otherwise(edge),
    }).drop("_prior", "_lag_p", "_prev")
    q = write_table(q, "hot-returns")

    # Per-market mean / stdev of the rolling volatility (partial aggregation,
    # so a hot market is summed by many tasks) attached per chunk.
    mstats = q.groupBy(KEY).agg(F.avg("roll_std").alias("_rm"), F.stddev_samp("roll_std").alias("_rs"))
    cstats = q.select(KEY, skew.CHUNK).distinct().join(mstats, KEY, "inner")
    q = q.join(cstats, [KEY, skew.CHUNK], "left")
    flat = F.col("_rs").isNull() | (F.col("_rs") < F.lit(K.MIN_GLOBAL_STD))
    z = F.try_divide(F.col("roll_std") - F.col("_rm"), F.col("_rs"))
    clipped = F.when(F.col("roll_std").isNotNull(), F.least(F.greatest(z, F.lit(-K.Z_CLIP)), F.lit(K.Z_CLIP)))
    q = q.withColumns({"zscore": F.when(flat, F.lit(0.0)).otherwise(clipped)})

    # Next trade's z: inside the chunk by lead(); at the chunk end from the
    # next chunk's first row.
    firsts = q.groupBy(KEY, skew.CHUNK).agg(F.max(F.when(F.col("_rn") == 1, F.col("zscore"))).alias("_fz"))
    firsts = skew.next_chunk_first(firsts, KEY, ["_fz"]).select(KEY, skew.CHUNK, "next__fz")
    q = q.join(firsts, [KEY, skew.CHUNK], "left")
    q = q.withColumns({"future_z": F.when(F.col("_rn") == F.col("_n"), F.col("next__fz"))
                       .otherwise(F.lead("zscore").over(w))})
    return q.drop("_rn", "_n", "_rm", "_rs", "next__fz")


def _features_whole_markets(q: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """The same features when no market is hot: one window partition per
    market, and the market statistics as window aggregates (no joins)."""
    w = Window.partitionBy(KEY).orderBy(*order)
    whole = Window.partitionBy(KEY)
    frame = w.rowsBetween(-(W - 1), 0)
    q = q.withColumns({"_prev": F.lag("price").over(w)})
    diff = F.coalesce(F.col("price") - F.col("_prev"), F.lit(0.0))
    q = q.withColumns({"price_diff": diff, "ret": _log_return(F.col("price"), F.col("_prev"))})
    is_yes = F.col("price_diff") >= 0
    q = q.withColumns({
        "is_yes": is_yes,
        "yes_vol": F.when(is_yes, F.col("usd_amount")).otherwise(F.lit(0.0)),
        "no_vol": F.when(~is_yes, F.col("usd_amount")).otherwise(F.lit(0.0)),
        "roll_std": F.when(F.count("ret").over(frame) == W, F.stddev_samp("ret").over(frame)),
    })
    q = q.withColumns({"_rm": F.avg("roll_std").over(whole), "_rs": F.stddev_samp("roll_std").over(whole)})
    flat = F.col("_rs").isNull() | (F.col("_rs") < F.lit(K.MIN_GLOBAL_STD))
    z = F.try_divide(F.col("roll_std") - F.col("_rm"), F.col("_rs"))
    clipped = F.when(F.col("roll_std").isNotNull(), F.least(F.greatest(z, F.lit(-K.Z_CLIP)), F.lit(K.Z_CLIP)))
    q = q.withColumns({"zscore": F.when(flat, F.lit(0.0)).otherwise(clipped)})
    q = q.withColumns({"future_z": F.lead("zscore").over(w)})
    return q.drop("_prev", "_rm", "_rs")
