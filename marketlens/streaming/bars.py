"""Time-bucketed trade bars (D4) over a Structured Streaming source.

The batch operator ``rollups.bars`` buckets on a fixed origin (Monday
2000-01-03); here the same buckets come from ``window(..., startTime)``, so a
stream and a batch run over the same trades give the same bars. State is
bounded by the watermark; each micro-batch's updated bars are appended with
their batch id and ``latest_bars`` keeps the newest version of each bar
(the same latest-wins rule as ``sources.upsert_latest``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketlens.operators.rollups import BUCKET_ORIGIN_S, parse_interval


def _start_time(interval: str) -> str:
    width, kind = parse_interval(interval)
    if kind != "s":
        raise ValueError("streaming bars need a fixed-width interval")
    return f"{BUCKET_ORIGIN_S % width} seconds"


def stream_bars(trades: DataFrame, interval: str = "1 hour", watermark: str = "1 day") -> DataFrame:
    """Streaming (or batch) bars: per market and bucket avg/min/max price,
    usd total and trade count; ``time_window`` is the bucket start (epoch s)."""
    t = trades.withColumn("_et", F.timestamp_seconds("timestamp")).withWatermark("_et", watermark)
    w = F.window("_et", interval, startTime=_start_time(interval))
    g = t.groupBy("market_id", w.alias("_w")).agg(
        F.avg("price").alias("avg_price"), F.min("price").alias("min_price"),
        F.max("price").alias("max_price"), F.sum("usd_amount").alias("total_volume"),
        F.count(F.lit(1)).alias("transaction_count"))
    return g.select("market_id", F.unix_seconds(F.col("_w.start")).alias("time_window"),
                    "avg_price", "min_price", "max_price", "total_volume", "transaction_count")


def start_bars(spark: SparkSession, source_dir: str, schema: str, out_dir: str, checkpoint_dir: str,
               interval: str = "1 hour", watermark: str = "1 day", available_now: bool = True):
    """Run ``stream_bars`` over Parquet files arriving in ``source_dir``;
    each micro-batch's updated bars go to ``out_dir`` tagged with the batch."""
    src = spark.readStream.schema(schema).parquet(source_dir)
    bars = stream_bars(src, interval, watermark)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("append").parquet(out_dir)

    writer = bars.writeStream.outputMode("update").option("checkpointLocation", checkpoint_dir).foreachBatch(write)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def latest_bars(spark: SparkSession, out_dir: str) -> DataFrame:
    """The newest version of every bar written by ``start_bars``."""
    df = spark.read.parquet(out_dir)
    w = Window.partitionBy("market_id", "time_window").orderBy(F.col("_batch").desc())
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_batch")
