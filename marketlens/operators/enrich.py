"""Market enrichment: category, viable catalog, tag lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.functions import constants as K
from marketlens.functions import primary_category, truncated_bigint
from marketlens.operators.joins import join_small


def _epoch_seconds(df: DataFrame, c: str) -> Column:
    dt = df.schema[c].dataType
    if isinstance(dt, T.StringType):  # dates as text; what is no date drops out like NULL
        return F.unix_micros(F.try_to_timestamp(F.col(c))) / F.lit(1e6)
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(F.col(c).cast("timestamp")) / F.lit(1e6)
    return F.col(c).cast("double")


def duration_days(df: DataFrame, created: str, end: str) -> Column:
    return (_epoch_seconds(df, end) - _epoch_seconds(df, created)) / F.lit(86400.0)


def with_category(markets: DataFrame, tags_col: str = "event_tags_json") -> DataFrame:
    return markets.withColumn("category", primary_category(tags_col))


def viable_markets(markets: DataFrame, created: str = "created_s", end: str = "end_s",
                   min_days: float = K.MIN_DURATION_DAYS) -> DataFrame:
    """Markets with a known category that ran at least ``min_days``
    (NULL durations drop out). Returns the catalog columns."""
    m = with_category(markets)
    keep = F.col("category").isNotNull() & (duration_days(m, created, end) >= F.lit(min_days))
    return m.where(keep).select(F.col("id").cast("string").alias("id"), "question", "predicted_label", "category")


def coerce_id(df: DataFrame, c: str = "event_id", out: str = "event_key") -> DataFrame:
    """Key text -> integer (truncating), bad or missing -> NULL."""
    return df.withColumn(out, truncated_bigint(c))


def bad_id_count(df: DataFrame, c: str = "event_id") -> DataFrame:
    return df.agg(F.count_if(truncated_bigint(c).isNull()).alias("bad_ids"))


def first_n_keys(df: DataFrame, c: str = "event_id", n: int = 100) -> DataFrame:
    """Rows whose coerced key is among the n smallest distinct keys.
    The key list is at most n rows, so the semi join broadcasts safely."""
    k = coerce_id(df, c, "_k")
    keys = (k.where(F.col("_k").isNotNull()).select("_k").distinct()
            .orderBy("_k").limit(n))
    return k.join(F.broadcast(keys), "_k", "left_semi").drop("_k")


def attach_tags(markets: DataFrame, cache: DataFrame, c: str = "event_id") -> DataFrame:
    """Tags JSON by event id, '[]' for missing or unusable ids."""
    m = coerce_id(markets, c, "_k")
    tags = cache.select(F.col("event_id").alias("_k"), F.col("tags_json"))
    # Rows without a usable id cannot match: they skip the join instead of
    # piling into the one partition that NULL keys hash to.
    keyed = join_small(m.where(F.col("_k").isNotNull()), tags, "_k", "left")
    unkeyed = m.where(F.col("_k").isNull()).withColumn("tags_json", F.lit(None).cast("string"))
    j = keyed.unionByName(unkeyed)
    return j.withColumn("event_tags_json", F.coalesce(F.col("tags_json"), F.lit("[]"))).drop("_k", "tags_json")


def missing_keys(markets: DataFrame, cache: DataFrame, c: str = "event_id") -> DataFrame:
    """Distinct usable event ids not in the cache yet."""
    keys = coerce_id(markets, c, "event_id_num").where(F.col("event_id_num").isNotNull()) \
        .select(F.col("event_id_num").alias("event_id")).distinct()
    return keys.join(cache.select("event_id"), "event_id", "left_anti")


def key_counts(markets: DataFrame, cache: DataFrame, c: str = "event_id") -> DataFrame:
    """J6 counts: unique ids, of which cached, of which missing (one row)."""
    keys = coerce_id(markets, c, "k").where(F.col("k").isNotNull()).select("k").distinct()
    cached = cache.select(F.col("event_id").alias("k"), F.lit(1).alias("hit")).distinct()
    j = keys.join(cached, "k", "left")
    return j.agg(F.count(F.lit(1)).alias("unique_ids"),
                 F.count("hit").alias("cached"),
                 F.count_if(F.col("hit").isNull()).alias("missing"))


def final_catalog(catalog: DataFrame, kept_ids: DataFrame) -> DataFrame:
    """Catalog rows of markets that made it into the time series."""
    return catalog.join(kept_ids.select(F.col("market_id").alias("id")).distinct(), "id", "left_semi")
