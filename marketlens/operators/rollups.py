"""Market, trader and label rollups; search; top-N (D1-D4, T-1, P5-P8)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketlens.functions import constants as K
from marketlens.operators import skew
from marketlens.functions import epoch_date
from marketlens.session import write_table

# time_bucket origin for day/week widths: Monday 2000-01-03 00:00 UTC.
BUCKET_ORIGIN_S = 946857600
MONTH_ORIGIN = (2000, 1)

_UNITS = {
    "second": 1, "seconds": 1, "minute": 60, "minutes": 60, "hour": 3600, "hours": 3600,
    "day": 86400, "days": 86400, "week": 604800, "weeks": 604800,
}


def parse_interval(interval: str) -> tuple[int, str]:
    """'15 minute' -> (900, 's'); '2 months' -> (2, 'm')."""
    m = re.fullmatch(r"\s*(\d+)\s*([a-zA-Z]+)\s*", interval)
    if not m:
        raise ValueError(f"unsupported interval {interval!r}")
    n, unit = int(m.group(1)), m.group(2).lower()
    if unit in ("month", "months", "mon", "mons"):
        return n, "m"
    if unit in ("year", "years"):
        return 12 * n, "m"
    if unit not in _UNITS:
        raise ValueError(f"unsupported interval unit {unit!r}")
    return n * _UNITS[unit], "s"


def bucket_start(epoch_s: str | Column, interval: str) -> Column:
    """Epoch seconds of the bucket holding ``epoch_s``; fixed widths use the
    Monday 2000-01-03 origin, months count from 2000-01."""
    c = F.col(epoch_s) if isinstance(epoch_s, str) else epoch_s
    width, kind = parse_interval(interval)
    if kind == "s":
        return F.lit(BUCKET_ORIGIN_S) + F.floor((c - F.lit(BUCKET_ORIGIN_S)) / F.lit(width)).cast("long") * F.lit(width)
    d = epoch_date(c)
    months = (F.year(d) - MONTH_ORIGIN[0]) * 12 + (F.month(d) - MONTH_ORIGIN[1])
    start = F.floor(months / F.lit(width)).cast("int") * F.lit(width)
    first = F.make_date(F.lit(MONTH_ORIGIN[0]) + F.floor(start / 12).cast("int"),
                        (F.pmod(start, F.lit(12)) + 1).cast("int"), F.lit(1))
    return F.unix_date(first).cast("long") * F.lit(86400)


def bars(trades: DataFrame, interval: str, market_id: str | None = None) -> DataFrame:
    """Per market and bucket: avg/min/max price, total usd, trade count.
    Only non-empty buckets; partial aggregation before the shuffle."""
    t = trades if market_id is None else trades.where(F.col("market_id") == F.lit(market_id))
    return (t.withColumn("time_window", bucket_start("timestamp", interval))
             .groupBy("market_id", "time_window")
             .agg(F.avg("price").alias("avg_price"), F.min("price").alias("min_price"),
                  F.max("price").alias("max_price"), F.sum("usd_amount").alias("total_volume"),
                  F.count(F.lit(1)).alias("transaction_count")))


def market_summary(markets: DataFrame) -> DataFrame:
    """Per label (NULL is a group): count, total and mean volume."""
    return markets.groupBy("predicted_label").agg(
        F.count(F.lit(1)).alias("total_count"), F.sum("volume").alias("total_volume"),
        F.avg("volume").alias("avg_volume"))


def top_markets(markets: DataFrame, n: int = K.TOP_MARKETS) -> DataFrame:
    """T-1: the n largest markets by volume (id breaks ties)."""
    return (markets.select("id", "predicted_label", "question", "event_title", "volume", "closed", "created_s")
            .orderBy(F.col("volume").desc_nulls_last(), F.col("id")).limit(n))


def search(markets: DataFrame, keyword: str, limit: int = K.SEARCH_LIMIT) -> DataFrame:
    """P5: case-insensitive pattern search over question or event title; '%'
    and '_' in the keyword act as wildcards. Largest volume first."""
    pat = f"%{keyword}%"
    return (markets.where(F.col("question").ilike(pat) | F.col("event_title").ilike(pat))
            .select("id", "predicted_label", "question", "event_title", "volume")
            .orderBy(F.col("volume").desc_nulls_last(), F.col("id")).limit(limit))


def search_literal(catalog: DataFrame, term: str, limit: int = K.SEARCH_LIMIT) -> DataFrame:
    """Literal, case-insensitive match on question or id; the first
    ``limit`` in catalog (id) order, flagged when more matches exist."""
    t = F.lit(term.lower())
    hits = catalog.where(F.coalesce(F.lower("question").contains(t), F.lit(False))
                         | F.coalesce(F.lower(F.col("id").cast("string")).contains(t), F.lit(False)))
    more = hits.limit(limit + 1).count() > limit
    first = hits.select("id", "question").orderBy("id").limit(limit)
    return first.select("id", "question", F.lit(more).alias("has_more"))


def facet_filter(catalog: DataFrame, genre: str = "All", label: str = "All") -> DataFrame:
    """P7: 'All' means no constraint on that facet."""
    out = catalog
    if genre != "All":
        out = out.where(F.col("category") == F.lit(genre))
    if label != "All":
        out = out.where(F.col("predicted_label") == F.lit(label))
    return out


def facets(catalog: DataFrame) -> DataFrame:
    """Distinct non-empty genres and labels, each list led by 'All'."""
    spark = catalog.sparkSession
    genre = catalog.where(F.col("category") != "").select(F.lit("genre").alias("facet"), F.col("category").alias("value"))
    label = catalog.where(F.col("predicted_label") != "").select(F.lit("label").alias("facet"), F.col("predicted_label").alias("value"))
    alls = spark.createDataFrame([("genre", "All"), ("label", "All")], "facet string, value string")
    return genre.union(label).distinct().unionByName(alls)


#: Below this n Spark cuts every group to n rows on the map side, before the shuffle.
GROUP_LIMIT = 1000


def top_n_per_group(df: DataFrame, group: str, order: list[Column], n: int, salt_col: str,
                    rows_per_task: int = skew.ROWS_PER_TASK) -> DataFrame:
    """Exact top-n per group (``rank`` 1..n).

    For a small n one window pass does: no map task sends more than n rows of
    a group. For a larger n every group of more than ``rows_per_task`` rows,
    however many there are, is salted into ceil(size / rows_per_task)
    buckets by a hash of ``salt_col``: top-n within (group, bucket) first, then
    within the group over at most buckets x n survivors."""
    w = Window.partitionBy(group).orderBy(*order)
    if n >= GROUP_LIMIT:
        sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_cnt")).where(F.col("_cnt") > rows_per_task)
        buckets = write_table(sizes.select(group, F.ceil(F.col("_cnt") / rows_per_task).alias("_buckets")), "hot-groups")
        df = (df.join(buckets, group, "left")
              .withColumn("_salt", F.pmod(F.xxhash64(F.col(salt_col)), F.coalesce(F.col("_buckets"), F.lit(1))))
              .drop("_buckets"))
        within = Window.partitionBy(group, "_salt").orderBy(*order)
        df = df.withColumn("_r", F.row_number().over(within)).where(F.col("_r") <= n).drop("_r", "_salt")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def whale_totals(users: DataFrame) -> DataFrame:
    return users.groupBy("market_id", "address", "role").agg(
        F.sum("usd_amount").alias("total_usd_volume"), F.sum("token_amount").alias("total_tokens"),
        F.avg("price").alias("avg_entry_price"))


def whales(users: DataFrame, market_id: str | None = None, n: int = K.TOP_WHALES) -> DataFrame:
    """Per (address, role) usd, tokens and mean price; top n by usd
    within each market (or one market when ``market_id`` is given)."""
    u = users if market_id is None else users.where(F.col("market_id") == F.lit(market_id))
    order = [F.col("total_usd_volume").desc(), F.col("address"), F.col("role")]
    return top_n_per_group(whale_totals(u), "market_id", order, n, salt_col="address")


def role_distribution(users: DataFrame, market_id: str | None = None, approx_rsd: float | None = None) -> DataFrame:
    """D3: distinct addresses and total usd per role (per market). Exact by
    default; with ``approx_rsd`` the distinct count is a HyperLogLog++
    estimate with that relative standard deviation (bounded state per group,
    column named ``approx_unique_users``)."""
    u = users if market_id is None else users.where(F.col("market_id") == F.lit(market_id))
    if approx_rsd is not None:
        return u.groupBy("market_id", "role").agg(
            F.approx_count_distinct("address", approx_rsd).alias("approx_unique_users"),
            F.sum("usd_amount").alias("total_volume"))
    return u.groupBy("market_id", "role").agg(
        F.countDistinct("address").alias("unique_users"), F.sum("usd_amount").alias("total_volume"))
