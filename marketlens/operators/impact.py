"""Market-impact regression (D8): future_z ~ 1 + yes_volume + no_volume.

Each bin carries its means and its moments about them. They are merged about
the overall means, which a one-row subquery gives: a bin adds its own moments and those
of its means. No raw sum of squares is formed, so large volumes
lose no digits, and the fit never leaves Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions import constants as K


def fit_impact(bins: DataFrame) -> DataFrame:
    """One row: n, yes_impact, no_impact (defaults when singular)."""
    n = F.col("ols_n")

    def overall(c):
        return F.try_divide(F.sum(n * F.col(c)), F.sum(F.when(F.col(c).isNotNull(), n)))

    means = ("ols_y", "ols_n1", "ols_z")
    centre = bins.agg(F.struct(*[overall(c).alias(c) for c in means]).alias("centre")).scalar()
    off = bins.withColumn("centre", centre).select("*", *[(F.col(c) - F.col("centre")[c]).alias(f"d_{c}") for c in means])

    def merged(moment, a, b):
        return F.coalesce(F.sum(F.col(moment) + n * F.col(f"d_{a}") * F.col(f"d_{b}")), F.lit(0.0)).alias(moment)

    s = off.agg(F.coalesce(F.sum(n), F.lit(0)).alias("ols_n"), merged("ols_yy", "ols_y", "ols_y"), merged("ols_nn", "ols_n1", "ols_n1"),
                merged("ols_yn", "ols_y", "ols_n1"), merged("ols_yz", "ols_y", "ols_z"), merged("ols_nz", "ols_n1", "ols_z"))
    cyy, cnn, cyn, cyz, cnz = (F.col(c) for c in ("ols_yy", "ols_nn", "ols_yn", "ols_yz", "ols_nz"))
    det = cyy * cnn - cyn * cyn
    ok = (F.col("ols_n") > 0) & (det != 0)
    b_yes = F.when(ok, F.try_divide(cnn * cyz - cyn * cnz, det)).otherwise(F.lit(K.DEFAULT_YES_IMPACT))
    b_no = F.when(ok, F.try_divide(cyy * cnz - cyn * cyz, det)).otherwise(F.lit(K.DEFAULT_NO_IMPACT))
    return s.select(F.col("ols_n").alias("n"), b_yes.alias("yes_impact"), b_no.alias("no_impact"))
