"""Certainty density ridgeline by volume band and market type (J8-J10,
D13-D15): a Gaussian KDE (Scott's bandwidth) per (type, band) cell on a
fixed grid over [0, 1].

Work is bounded by design: at most ``cap`` rows per cell enter the KDE (a
deterministic hash order picks them), so the kernel sums are at most
cells x cap x grid evaluations whatever the table size. The cap's top-n is
exact and salted by cell size, so a cell holding a third of the table is
ranked by many tasks, and the kernel sums are partial aggregates.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions import band_order, duck_round, volume_band
from marketlens.functions import constants as K
from marketlens.operators.rollups import top_n_per_group
from marketlens.session import write_table


def cell_grid(spark: SparkSession) -> DataFrame:
    """All (type, band) cells, bands bottom -> top (21 rows, fixed)."""
    rows = [(t, ti, b[2], bi) for ti, t in enumerate(K.MARKET_TYPES) for bi, b in enumerate(K.VOLUME_BANDS)]
    return spark.createDataFrame(rows, "type string, type_order int, band string, band_order int")


def banded(scores: DataFrame, value: str = "uncertainty_twap", volume: str = "volume",
           label: str = "predicted_label") -> DataFrame:
    """Rows with a certainty, a volume and a known type, with their band."""
    b = scores.where(F.col(value).isNotNull() & F.col(volume).isNotNull()
                     & F.col(label).isin(*K.MARKET_TYPES))
    return (b.select("market_id", F.col(value).alias("c"), F.col(label).alias("type"),
                     volume_band(volume).alias("band"), band_order(volume).alias("band_order"))
            .where(F.col("band").isNotNull()))


def ridgeline_cells(scores: DataFrame, min_n: int = K.RIDGELINE_MIN_N) -> DataFrame:
    """Every cell with its row count n (0 for empty cells, J9) and whether a
    density is drawn (n >= min_n and a non-zero range)."""
    b = banded(scores)
    stats = b.groupBy("type", "band").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("_lo"),
                                          F.max("c").alias("_hi"))
    grid = F.broadcast(cell_grid(scores.sparkSession))
    cells = grid.join(stats, ["type", "band"], "left")
    n = F.coalesce(F.col("n"), F.lit(0)).cast("long")
    has = (n >= min_n) & (F.col("_hi") > F.col("_lo"))
    return cells.select("type", "type_order", "band", "band_order", n.alias("n"),
                        F.coalesce(has, F.lit(False)).alias("has_density"))


def kde_sample(scores: DataFrame, cap: int = K.RIDGELINE_KDE_SAMPLE, seed: int = 0) -> DataFrame:
    """At most ``cap`` rows per cell, chosen by md5(market_id:seed) order
    (replaces a seeded random draw; reproducible in any engine)."""
    b = banded(scores).withColumn("cell", F.concat_ws("|", "type", "band"))
    b = b.withColumn("_h", F.md5(F.concat(F.col("market_id").cast("string"), F.lit(f":{seed}"))))
    s = top_n_per_group(b, "cell", [F.col("_h"), F.col("market_id")], cap, salt_col="market_id")
    return s.drop("_h", "rank")


def ridgeline_density(scores: DataFrame, grid: int = K.RIDGELINE_GRID, min_n: int = K.RIDGELINE_MIN_N,
                      cap: int | None = None, seed: int = 0) -> DataFrame:
    """Per drawable cell and grid point k: x = k/(grid-1), density
    (5 dp) and its height relative to the global peak density. All rows of a
    cell count; ``cap`` asks for a sample of at most that many instead."""
    cells = ridgeline_cells(scores, min_n).where("has_density").select("type", "band")
    rows = banded(scores) if cap is None else kde_sample(scores, cap, seed)
    sample = rows.join(F.broadcast(cells), ["type", "band"], "left_semi")
    bw = sample.groupBy("type", "band").agg(
        F.count(F.lit(1)).alias("m"),
        (F.stddev_samp("c") * F.pow(F.count(F.lit(1)).cast("double"), F.lit(-0.2))).alias("h"))
    # Equal values contribute equal kernels: weight each distinct value by its
    # count (exact) before fanning out over the grid.
    distinct_c = sample.groupBy("type", "band", "c").agg(F.count(F.lit(1)).alias("w"))
    pts = distinct_c.join(F.broadcast(bw), ["type", "band"]).select(
        "type", "band", "c", "w", "m", "h", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("k"))
    # h > 0 for drawable cells unless the capped sample is constant: then NULL
    u = F.try_divide(F.col("k") / F.lit(float(grid - 1)) - F.col("c"), F.col("h"))
    dens = pts.groupBy("type", "band", "k").agg(
        (F.sum(F.col("w") * F.exp(F.lit(-0.5) * u * u))
         / (F.first("m") * F.first("h") * F.lit(math.sqrt(2 * math.pi)))).alias("_d"))
    # at most cells x grid rows: written once, then read for the peak and the output
    dens = write_table(dens, "ridgeline")
    peak = dens.agg(F.max("_d")).first()[0]
    return dens.select(
        "type", "band", F.col("k").cast("int").alias("k"),
        duck_round(F.col("k") / F.lit(float(grid - 1)), 4).alias("x"),
        duck_round("_d", 5).alias("density"),
        duck_round(F.col("_d") / F.lit(peak), 6).alias("rel_height"),
    )


def band_share(cells: DataFrame) -> DataFrame:
    """Each cell's share of its type's rows (0 when the type is empty)."""
    tot = cells.groupBy("type").agg(F.sum("n").alias("_t"))
    j = cells.join(F.broadcast(tot), "type")
    pct = F.when(F.col("_t") > 0, F.col("n") * F.lit(100.0) / F.col("_t")).otherwise(F.lit(0.0))
    return j.select("type", "band", "n", duck_round(pct, 6).alias("pct"))
