"""30-minute market bins (D6, D7) and the impact-regression partial sums.

``bin_table`` makes the single pass over the trade features: one row per
(market, bin) with the bin's last price and z, volume and trade counts, the
quality-filter inputs and the regression's moments. Everything after it
works on that table, whose size is bounded by market lifetimes, not by trade
counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketlens.functions import constants as K

KEY = "market_id"


def bin_table(features: DataFrame, order: tuple[str, ...] = ("timestamp", "seq"),
              bin_seconds: int = K.BIN_SECONDS) -> DataFrame:
    """Per (market, bin): last non-NULL price and z (T10), yes/no volume,
    trade counts, usd total, price extremes and the regression's means and
    centred moments."""
    ord_struct = F.struct(*order)
    f = features.withColumn("bin", F.floor(F.col("timestamp") / F.lit(bin_seconds)).cast("long"))
    mask = F.col("ret").isNotNull() & F.col("zscore").isNotNull() & F.col("future_z").isNotNull()

    n_obs = F.count_if(mask)

    def mean(c):
        return F.avg(F.when(mask, c))

    def moment(a, b):  # the sum of products about the bin's means; Spark merges it without large squares
        return F.covar_pop(F.when(mask, a), F.when(mask, b)) * n_obs

    y, n, z = F.col("yes_vol"), F.col("no_vol"), F.col("future_z")
    return f.groupBy(KEY, "bin").agg(
        F.max_by("price", F.when(F.col("price").isNotNull(), ord_struct)).alias("price"),
        F.max_by("zscore", F.when(F.col("zscore").isNotNull(), ord_struct)).alias("zscore"),
        F.sum("yes_vol").alias("yes_volume"),
        F.sum("no_vol").alias("no_volume"),
        F.count_if(F.col("is_yes")).alias("yes_count"),
        F.count_if(~F.col("is_yes")).alias("no_count"),
        F.count(F.lit(1)).alias("trade_count"),
        F.sum("usd_amount").alias("usd"),
        F.max("price").alias("p_max"),
        F.min("price").alias("p_min"),
        n_obs.alias("ols_n"),
        mean(y).alias("ols_y"), mean(n).alias("ols_n1"), mean(z).alias("ols_z"),
        moment(y, y).alias("ols_yy"), moment(n, n).alias("ols_nn"), moment(y, n).alias("ols_yn"),
        moment(y, z).alias("ols_yz"), moment(n, z).alias("ols_nz"),
    )


def market_quality(bins: DataFrame) -> DataFrame:
    """D7 inputs and verdict per market, from the bin table.

    n >= 50 trades, usd >= 5000, price range >= 0.10 (D7a); >= 24 dense bins
    (D7b); not dead in the middle (D7c); > 10 bins and >= 50 trades (D7d).
    """
    span = bins.groupBy(KEY).agg(
        F.sum("trade_count").alias("n_trades"), F.sum("usd").alias("usd"),
        F.max("p_max").alias("p_max"), F.min("p_min").alias("p_min"),
        F.min("bin").alias("min_bin"), F.max("bin").alias("max_bin"))
    span = span.withColumn("n_bins", F.col("max_bin") - F.col("min_bin") + 1)
    lo_share, hi_share = K.DEAD_MIDDLE_SPAN
    pos = F.col("bin") - F.col("min_bin")
    mid_lo = F.floor(F.col("n_bins") * F.lit(lo_share))
    mid_hi = F.floor(F.col("n_bins") * F.lit(hi_share))
    mid = (bins.select(KEY, "bin", "trade_count")
           .join(span.select(KEY, "min_bin", "n_bins"), KEY)
           .where((pos >= mid_lo) & (pos < mid_hi))
           .groupBy(KEY).agg(F.sum("trade_count").alias("mid_trades")))
    q = span.join(mid, KEY, "left").withColumn("mid_trades", F.coalesce("mid_trades", F.lit(0)))
    # a market is dropped only when its known price range is too narrow
    narrow = F.coalesce(F.col("p_max") - F.col("p_min") < F.lit(K.MIN_PRICE_RANGE), F.lit(False))
    dead = ((F.col("n_bins") > K.DEAD_MIDDLE_MIN_BINS) & (F.col("n_trades") > 0)
            & (F.try_divide(F.col("mid_trades"), F.col("n_trades")) < F.lit(K.DEAD_MIDDLE_SHARE)))
    keep = ((F.col("n_trades") >= K.MIN_TRADES) & (F.coalesce(F.col("usd"), F.lit(0.0)) >= F.lit(K.MIN_USD))
            & ~narrow & (F.col("n_bins") >= K.MIN_BINS) & ~dead
            & (F.col("n_bins") > K.FINAL_MIN_BINS) & (F.col("n_trades") >= K.FINAL_MIN_TRADES))
    return q.withColumn("dead_middle", dead).withColumn("keep", keep)


def dense_bars(bins: DataFrame, kept: DataFrame) -> DataFrame:
    """The gap-filled 30-minute series of kept markets: empty bins get
    zero volumes and counts, price and z carried forward, leading z = 0.

    The grid is generated only for kept markets (filters run before the
    explode), and its size per market is its lifetime in bins.
    """
    grid = kept.select(KEY, F.explode(F.sequence("min_bin", "max_bin")).alias("bin"))
    cols = ["price", "zscore", "yes_volume", "no_volume", "yes_count", "no_count", "trade_count"]
    j = grid.join(bins.select(KEY, "bin", *cols), [KEY, "bin"], "left")
    w = Window.partitionBy(KEY).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return j.select(
        KEY, "bin",
        F.last("price", ignorenulls=True).over(w).alias("price"),
        F.coalesce(F.last("zscore", ignorenulls=True).over(w), F.lit(0.0)).alias("zscore"),
        F.coalesce("yes_volume", F.lit(0.0)).alias("yes_volume"),
        F.coalesce("no_volume", F.lit(0.0)).alias("no_volume"),
        F.coalesce("yes_count", F.lit(0)).cast("long").alias("yes_count"),
        F.coalesce("no_count", F.lit(0)).cast("long").alias("no_count"),
        F.coalesce("trade_count", F.lit(0)).cast("long").alias("trade_count"),
    )


def dense_series(bins: DataFrame) -> DataFrame:
    """D6 + D7 in one pass over the sparse bins of each market.

    One window over a market's non-empty bins gives the carried-forward price
    and z, the next non-empty bin, the previous bin's values and the quality
    inputs; each non-empty bin then expands to itself plus the empty bins up
    to the next one (zero volumes and counts, carried price and z). The
    previous dense bin's values (the ARIMAX inputs) follow from the same row:
    no grid join and no second window. Only kept markets are expanded.
    """
    w = Window.partitionBy(KEY).orderBy("bin")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(KEY)
    b = bins.withColumns({
        "_cp": F.last("price", ignorenulls=True).over(upto),
        "_cz": F.coalesce(F.last("zscore", ignorenulls=True).over(upto), F.lit(0.0)),
        "_next": F.lead("bin").over(w),
        "_prev_bin": F.lag("bin").over(w),
        "_prev_yes": F.lag("yes_volume").over(w),
        "_prev_no": F.lag("no_volume").over(w),
        "_prev_tc": F.lag("trade_count").over(w),
        "_min_bin": F.min("bin").over(whole),
        "_max_bin": F.max("bin").over(whole),
        "_n_trades": F.sum("trade_count").over(whole),
        "_usd": F.sum("usd").over(whole),
        "_range": F.max("p_max").over(whole) - F.min("p_min").over(whole),
    })
    n_bins = F.col("_max_bin") - F.col("_min_bin") + 1
    lo_share, hi_share = K.DEAD_MIDDLE_SPAN
    pos = F.col("bin") - F.col("_min_bin")
    in_mid = (pos >= F.floor(n_bins * F.lit(lo_share))) & (pos < F.floor(n_bins * F.lit(hi_share)))
    b = b.withColumns({
        "_n_bins": n_bins,
        "_prev_cz": F.lag("_cz").over(w),
        "_mid": F.sum(F.when(in_mid, F.col("trade_count")).otherwise(F.lit(0))).over(whole),
    })
    dead = ((F.col("_n_bins") > K.DEAD_MIDDLE_MIN_BINS) & (F.col("_n_trades") > 0)
            & (F.try_divide(F.col("_mid"), F.col("_n_trades")) < F.lit(K.DEAD_MIDDLE_SHARE)))
    keep = ((F.col("_n_trades") >= K.MIN_TRADES) & (F.coalesce(F.col("_usd"), F.lit(0.0)) >= F.lit(K.MIN_USD))
            & ~F.coalesce(F.col("_range") < F.lit(K.MIN_PRICE_RANGE), F.lit(False))
            & (F.col("_n_bins") >= K.MIN_BINS) & ~dead
            & (F.col("_n_bins") > K.FINAL_MIN_BINS) & (F.col("_n_trades") >= K.FINAL_MIN_TRADES))
    b = b.where(keep)
    gap = F.coalesce(F.col("_next") - F.col("bin") - 1, F.lit(0))
    e = b.select("*", F.posexplode(F.sequence(F.lit(0), gap.cast("int"))).alias("_off", "_x"))
    own = F.col("_off") == 0
    zero_d, zero_l = F.lit(0.0), F.lit(0).cast("long")
    adjacent = F.col("_prev_bin") == F.col("bin") - 1
    prev_z = (F.when(own, F.col("_prev_cz"))  # NULL on the first bin
              .otherwise(F.col("_cz")))
    prev_yes = (F.when(own, F.when(adjacent, F.col("_prev_yes")).when(F.col("_prev_bin").isNotNull(), zero_d))
                .when(F.col("_off") == 1, F.col("yes_volume")).otherwise(zero_d))
    prev_no = (F.when(own, F.when(adjacent, F.col("_prev_no")).when(F.col("_prev_bin").isNotNull(), zero_d))
               .when(F.col("_off") == 1, F.col("no_volume")).otherwise(zero_d))
    prev_tc = (F.when(own, F.when(adjacent, F.col("_prev_tc")).when(F.col("_prev_bin").isNotNull(), zero_l))
               .when(F.col("_off") == 1, F.col("trade_count")).otherwise(zero_l))
    return e.select(
        KEY, (F.col("bin") + F.col("_off")).alias("bin"),
        F.col("_cp").alias("price"), F.col("_cz").alias("zscore"),
        F.when(own, F.coalesce("yes_volume", zero_d)).otherwise(zero_d).alias("yes_volume"),
        F.when(own, F.coalesce("no_volume", zero_d)).otherwise(zero_d).alias("no_volume"),
        F.when(own, F.col("yes_count")).otherwise(zero_l).cast("long").alias("yes_count"),
        F.when(own, F.col("no_count")).otherwise(zero_l).cast("long").alias("no_count"),
        F.when(own, F.col("trade_count")).otherwise(zero_l).cast("long").alias("trade_count"),
        prev_z.alias("prev_z"), prev_yes.alias("prev_yes"), prev_no.alias("prev_no"),
        prev_tc.cast("long").alias("prev_tc"),
    )
