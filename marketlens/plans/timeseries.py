"""Offline time-series build: trades -> features -> bins -> impact fit ->
quality filter -> dense 30-minute series -> ARIMAX; plus the final catalog.

One shuffle of the trade tape (by market and chunk); everything after the
bin table works on per-(market, bin) rows. The bin table is written to the
shared checkpoint folder, so it is computed once, read by the four later
steps, and survives the loss of executors.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.operators import bars as B
from marketlens.operators import enrich as EN
from marketlens.operators import forecast as FC
from marketlens.operators import impact as IM
from marketlens.operators import skew
from marketlens.operators import tape as TP
from marketlens.operators.joins import fits_broadcast, join_small
from marketlens.session import write_table


def restrict_to(quant: DataFrame, ids: DataFrame, key: str = "market_id", fits: bool | None = None) -> DataFrame:
    """Trades of the given market ids (text key), as a left semi join."""
    q = quant.withColumn(key, F.col(key).cast("string"))
    return join_small(q, ids.select(F.col("id").cast("string").alias(key)).distinct(), key, "left_semi", fits=fits)


class TimeSeriesBuild:
    """The build's tables, each computed on first use: a query that needs only
    the regression never plans the dense series."""

    def __init__(self, quant: DataFrame, markets: DataFrame, order=TP.ORDER, rows_per_task: int = skew.ROWS_PER_TASK,
                 checkpoint: bool = True, created: str = "created_s", end: str = "end_s"):
        self._quant, self._markets, self._order = quant, markets, order
        self._rows_per_task, self._checkpoint = rows_per_task, checkpoint
        self._created, self._end = created, end

    @cached_property
    def catalog(self) -> DataFrame:
        """Viable markets (id, question, predicted_label, category)."""
        return EN.viable_markets(self._markets, self._created, self._end)

    @cached_property
    def catalog_fits_broadcast(self) -> bool:
        """One size check of the catalog, used by both joins against it."""
        return fits_broadcast(self.catalog)

    @cached_property
    def features(self) -> DataFrame:
        """Per trade features of the viable markets. The catalog size check and
        the hot-market detection (on the unrestricted tape: a superset only plans
        more pieces) are independent jobs and run concurrently."""
        quant = self._quant.withColumn("market_id", F.col("market_id").cast("string"))
        with ThreadPoolExecutor(max_workers=2) as pool:
            fits = pool.submit(lambda: self.catalog_fits_broadcast)
            found = pool.submit(skew.hot_keys, quant, "market_id", self._rows_per_task)
            fits.result()
            hot = found.result()
        q = restrict_to(quant, self.catalog, fits=self.catalog_fits_broadcast)
        return TP.trade_features(q, order=self._order, hot=hot)

    @cached_property
    def bins(self) -> DataFrame:
        """Per (market, bin), sparse; written once to the checkpoint folder."""
        b = B.bin_table(self.features, order=self._order)
        return write_table(b, "bins") if self._checkpoint else b

    @cached_property
    def impact(self) -> DataFrame:
        return IM.fit_impact(self.bins)

    @cached_property
    def quality(self) -> DataFrame:
        return B.market_quality(self.bins)

    @cached_property
    def dense(self) -> DataFrame:
        """Gap-filled series of kept markets with the previous bin's values."""
        return B.dense_series(self.bins)

    @cached_property
    def timeseries(self) -> DataFrame:
        """dashboard_timeseries."""
        return FC.arimax(self.dense, self.catalog, self.impact, catalog_fits=self.catalog_fits_broadcast)

    @cached_property
    def final_catalog(self) -> DataFrame:
        """dashboard_catalog."""
        return EN.final_catalog(self.catalog, self.quality.where("keep"))


def build(quant: DataFrame, markets: DataFrame, *, order=TP.ORDER, rows_per_task: int = skew.ROWS_PER_TASK,
          checkpoint: bool = True, created: str = "created_s", end: str = "end_s") -> TimeSeriesBuild:
    """The build over trades (market_id, timestamp, price, usd_amount and the
    ``order`` columns) and markets whose start and end are ``created`` and
    ``end``: epoch seconds, timestamps, dates or their text."""
    return TimeSeriesBuild(quant, markets, order, rows_per_task, checkpoint, created, end)


def timeseries_of_market(timeseries: DataFrame, market_id: str) -> DataFrame:
    """One market's series in time order (the key is pushed to the scan
    when ``timeseries`` is read from the written table)."""
    return (timeseries.where(F.col("market_id") == F.lit(market_id))
            .select("timestamp", "price", "zscore", "yes_volume", "no_volume",
                    "yes_count", "no_count", "trade_count", "arimax")
            .orderBy("timestamp"))


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """P10: raise when empty, else add the ``data_points`` count (one number
    read back, not an unpartitioned window)."""
    n = df.count()
    if n == 0:
        raise ValueError(message)
    return df.withColumn("data_points", F.lit(n))
