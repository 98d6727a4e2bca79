"""One-step ARIMAX forecast on the dense series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketlens.functions import ar_damping, baseline_exog, duck_round
from marketlens.functions import constants as K
from marketlens.operators.joins import join_small

KEY = "market_id"


def arimax(series: DataFrame, catalog: DataFrame, impact: DataFrame,
           bin_seconds: int = K.BIN_SECONDS, catalog_fits: bool | None = None) -> DataFrame:
    """dashboard_timeseries rows from the dense series (``bars.dense_series``,
    which carries the previous bin's z, volumes and trade count; a plain dense
    series without them gets them from lag()).

    arimax = baseline(label) + z[-1] * AR * damping(trades[-1])
             + yes[-1] * b_yes + no[-1] * b_no, NULL on the first bin, round 4;
    price round 4, z / volumes round 2, timestamp in epoch ms.
    """
    w = Window.partitionBy(KEY).orderBy("bin")
    base = catalog.select(F.col("id").alias(KEY), baseline_exog("predicted_label").alias("_base"))
    s = join_small(series, base, KEY, "left", fits=catalog_fits)
    # the coefficients are one row: read the two numbers back as literals
    coef = impact.select("yes_impact", "no_impact").first()
    s = s.withColumn("yes_impact", F.lit(coef["yes_impact"])).withColumn("no_impact", F.lit(coef["no_impact"]))
    if "prev_z" in series.columns:
        prev_z, prev_y, prev_n, prev_t = (F.col(c) for c in ("prev_z", "prev_yes", "prev_no", "prev_tc"))
    else:
        prev_z, prev_y = F.lag("zscore").over(w), F.lag("yes_volume").over(w)
        prev_n, prev_t = F.lag("no_volume").over(w), F.lag("trade_count").over(w)
    raw = (F.coalesce(F.col("_base"), F.lit(K.DEFAULT_BASELINE_EXOG))
           + prev_z * F.lit(K.AR_L1) * ar_damping(prev_t)
           + prev_y * F.col("yes_impact") + prev_n * F.col("no_impact"))
    return s.select(
        F.col(KEY),
        (F.col("bin") * F.lit(bin_seconds * 1000)).cast("long").alias("timestamp"),
        duck_round("price", 4).alias("price"),
        duck_round("zscore", 2).alias("zscore"),
        duck_round("yes_volume", 2).alias("yes_volume"),
        duck_round("no_volume", 2).alias("no_volume"),
        "yes_count", "no_count", "trade_count",
        F.when(prev_z.isNotNull(), duck_round(raw, 4)).alias("arimax"),
    )
