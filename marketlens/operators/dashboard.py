"""Dashboard aggregates over the series and the catalog, for every market at
once (D11, D12, D21, W10-W14, liquidity and side flags).

Series windows are partitioned by market over 30-minute bins, so a window
partition holds one market's lifetime in bins (bounded by time, not by how
many trades the market had).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketlens.functions import capitalize_first, dominant_side, duck_round, epoch_label
from marketlens.functions import constants as K

KEY = "market_id"


def _z(c: str = "zscore"):
    return F.coalesce(F.col(c), F.lit(0.0))


def market_kpis(series: DataFrame) -> DataFrame:
    """Total trades, peak z (NULL as 0), share of points with z above
    the anomaly threshold (1 dp), latest z and latest ARIMAX (NULL as 0)."""
    return series.groupBy(KEY).agg(
        F.sum(F.coalesce(F.col("trade_count"), F.lit(0))).alias("total_trades"),
        F.max(_z()).alias("max_z"),
        duck_round(F.avg(F.when(_z() > F.lit(K.ANOMALY_Z), 1.0).otherwise(0.0)) * F.lit(100.0), 1).alias("anomaly_pct"),
        F.coalesce(F.max_by("zscore", "timestamp"), F.lit(0.0)).alias("current_z"),
        F.coalesce(F.max_by("arimax", "timestamp"), F.lit(0.0)).alias("current_arimax"),
    )


def _flow_names(catalog: DataFrame) -> DataFrame:
    cat, lab = F.col("category"), F.col("predicted_label")
    source = F.when(cat.isNull() | (cat == ""), F.lit("Unknown")).otherwise(capitalize_first(cat))
    target = F.when(lab.isNull() | (lab == ""), F.lit("Unclassified")).otherwise(capitalize_first(lab))
    return catalog.select(source.alias("source"), target.alias("target"))


def _share(n, total):
    raw = n * F.lit(100.0) / total
    return F.when(raw < 0.1, duck_round(raw, 3)).otherwise(duck_round(raw, 1))


def flow_links(catalog: DataFrame) -> DataFrame:
    """D12a/b: markets per (category, label) path, share of all markets
    (3 dp under 0.1 %, else 1 dp) and sqrt weight."""
    names = _flow_names(catalog)
    links = names.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over the grouped rows: one per pair of category and label
    return links.select("source", "target", "n", _share(F.col("n"), total).alias("share_pct"),
                        F.sqrt("n").alias("weight"))


def flow_nodes(catalog: DataFrame) -> DataFrame:
    """Node totals over both sides (a name on both sides adds up)."""
    names = _flow_names(catalog)
    ends = names.select(F.col("source").alias("name")).unionAll(names.select(F.col("target").alias("name")))
    nodes = ends.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy()) / 2  # every row has two ends
    return nodes.select("name", "n", _share(F.col("n"), total).alias("share_pct"))


def downsample(series: DataFrame, max_points: int = K.MAX_CHART_POINTS) -> DataFrame:
    """Keep positions divisible by ceil(n / max_points) when the
    series is longer than max_points. Adds ``idx`` (0-based position in the
    kept series, = pos / step) and ``n_points`` (kept points), both by
    arithmetic, so one window pass does it."""
    w = Window.partitionBy(KEY).orderBy("timestamp")
    s = series.withColumns({"_pos": (F.row_number().over(w) - 1).cast("long"),
                            "_n": F.count(F.lit(1)).over(Window.partitionBy(KEY))})
    step = F.when(F.col("_n") <= max_points, F.lit(1)).otherwise(F.ceil(F.col("_n") / F.lit(float(max_points))))
    s = s.withColumn("_step", step.cast("long"))
    s = s.where(F.pmod(F.col("_pos"), F.col("_step")) == 0)
    return s.withColumns({"idx": F.col("_pos") / F.col("_step"),
                          "n_points": F.ceil(F.col("_n") / F.col("_step"))}) \
        .withColumns({"idx": F.col("idx").cast("long"), "n_points": F.col("n_points").cast("long")}) \
        .drop("_pos", "_n", "_step")


def timeline(series: DataFrame) -> DataFrame:
    """Per point its label (M/d HH:mm, UTC), running and total trades,
    the chart's cleaned values (NULL volumes/counts as 0, ARIMAX 0 -> NULL)."""
    w = Window.partitionBy(KEY).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    tc = F.coalesce(F.col("trade_count"), F.lit(0))
    return series.select(
        KEY, "idx", "timestamp",
        epoch_label(F.floor(F.col("timestamp") / 1000)).alias("time_label"),
        "price", "zscore",
        F.when(F.col("arimax") != 0, F.col("arimax")).alias("arimax"),
        F.coalesce(F.col("yes_volume"), F.lit(0.0)).alias("yes_volume"),
        F.coalesce(F.col("no_volume"), F.lit(0.0)).alias("no_volume"),
        tc.alias("trade_count"),
        F.sum(tc).over(w).alias("cumulative_count"),
        F.sum(tc).over(Window.partitionBy(KEY)).alias("total_trades"),
    )


def anomaly_regions(series: DataFrame, threshold: float = K.ANOMALY_Z) -> DataFrame:
    """Maximal runs of points with z > threshold, as [start, end] point
    indices; end is the first point back at or below the threshold, or the
    last index when the run is still open. Gaps-and-islands on ``idx``."""
    w = Window.partitionBy(KEY).orderBy("idx")
    hot = F.coalesce(F.col("zscore") > F.lit(threshold), F.lit(False))
    last = (F.col("n_points") - 1) if "n_points" in series.columns else F.max("idx").over(Window.partitionBy(KEY))
    s = series.select(KEY, "idx", hot.alias("_hot"), last.alias("_last"))
    s = s.withColumn("_chg", F.when(F.col("_hot") != F.lag("_hot", 1, False).over(w), 1).otherwise(0))
    s = s.withColumn("_run", F.sum("_chg").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = s.where("_hot").groupBy(KEY, "_run").agg(
        F.min("idx").alias("start"), F.max("idx").alias("_end"), F.first("_last").alias("_last"))
    return runs.select(KEY, "start", F.least(F.col("_end") + 1, F.col("_last")).alias("end"))


def series_extent(series: DataFrame) -> DataFrame:
    """Chart extents: max total volume (1 when zero), min of (z,
    ARIMAX, -1), max of (z, ARIMAX, 4), NULL ARIMAX as 0."""
    vol = F.coalesce(F.col("yes_volume"), F.lit(0.0)) + F.coalesce(F.col("no_volume"), F.lit(0.0))
    ar = F.coalesce(F.col("arimax"), F.lit(0.0))
    agg = series.groupBy(KEY).agg(
        F.max(vol).alias("_mv"),
        F.min(F.least(_z(), ar, F.lit(-1.0))).alias("min_z"),
        F.max(F.greatest(_z(), ar, F.lit(4.0))).alias("max_z"))
    return agg.select(KEY, F.when((F.col("_mv") == 0) | F.col("_mv").isNull(), F.lit(1.0))
                      .otherwise(F.col("_mv")).alias("max_volume"), "min_z", "max_z")


def point_flags(series: DataFrame) -> DataFrame:
    """Per point: low liquidity (volume under 5 % of the series' peak volume,
    or fewer than 3 trades) and the dominant side by volume."""
    vol = F.coalesce(F.col("yes_volume"), F.lit(0.0)) + F.coalesce(F.col("no_volume"), F.lit(0.0))
    mv = F.max(vol).over(Window.partitionBy(KEY))
    mv = F.when((mv == 0) | mv.isNull(), F.lit(1.0)).otherwise(mv)
    low = (vol < mv * F.lit(K.LOW_LIQUIDITY_SHARE)) | (F.coalesce(F.col("trade_count"), F.lit(0)) < K.LOW_LIQUIDITY_TRADES)
    return series.select(KEY, "idx", "timestamp", low.alias("low_liquidity"),
                         dominant_side("yes_volume", "no_volume").alias("dominant_side"))
