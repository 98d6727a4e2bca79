"""Registered queries: one Spark callable and one DuckDB oracle per operator.

Each query takes (spark, sf_dir) and reads the driver tables through the
fixture views, so its work grows with the data. Float outputs that are sums
are rounded (same digits in both engines) so the order-dependent last bits
of a floating-point sum do not decide equality.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.functions import duck_round
from marketlens.session import write_table
from marketlens.sources import fixtures as fx
from marketlens.sources.fixtures import with_fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def round_doubles(df: DataFrame, digits: int = 6, only: list[str] | None = None) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DoubleType) and (only is None or f.name in only):
            cols.append(duck_round(f.name, digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# ---------------------------------------------------------------- certainty
from marketlens.operators import certainty as C  # noqa: E402

# The rules stated once more, by other means than the query: a table of the two sides of a market, trades numbered
# in time order, each trade joined with the next number, the last known price by its number.
_CERTAINTY_CTES = """
sides AS (
    SELECT CAST(id AS BIGINT) AS market, token1 AS token, 0.0::DOUBLE AS base, 1.0::DOUBLE AS sign FROM fx_markets
    UNION ALL
    SELECT CAST(id AS BIGINT), token2, 1.0::DOUBLE, -1.0::DOUBLE FROM fx_markets WHERE token2 IS DISTINCT FROM token1
),
numbered AS (
    SELECT s.market, f.timestamp AS moment, s.base + s.sign * f.price AS yes_price, f.usd_amount AS usd,
           row_number() OVER (PARTITION BY s.market ORDER BY f.timestamp, f.block_number, f.log_index) AS k
    FROM sides s JOIN fx_trades f ON f.asset_id = s.token AND TRY_CAST(f.market_id AS BIGINT) = s.market
),
held AS (
    SELECT a.market, sum(a.yes_price * (b.moment - a.moment)) AS area
    FROM numbered a JOIN numbered b ON b.market = a.market AND b.k = a.k + 1 GROUP BY a.market
),
facts AS (
    SELECT market, count(*) AS trades, sum(usd) AS money, sum(yes_price * usd) AS weighted, avg(yes_price) AS plain_mean,
           max(moment) - min(moment) AS lifetime, max(k) FILTER (WHERE yes_price IS NOT NULL) AS last_known
    FROM numbered GROUP BY market
),
means AS (
    SELECT f.market, f.money, l.yes_price AS last_price, CASE WHEN f.money <> 0 THEN f.weighted / f.money END AS by_money,
           CASE WHEN f.trades = 1 OR f.lifetime = 0 THEN f.plain_mean ELSE h.area / f.lifetime END AS by_time
    FROM facts f LEFT JOIN held h USING (market) LEFT JOIN numbered l ON l.market = f.market AND l.k = f.last_known
),
scores AS (
    SELECT p.market AS market_id, m.question, round(p.money, 6) AS volume,
           round(p.last_price, 6) AS last_price, round(2 * greatest(p.last_price - 0.5, 0.5 - p.last_price), 6) AS uncertainty_last,
           round(p.by_time, 6) AS twap, round(2 * greatest(p.by_time - 0.5, 0.5 - p.by_time), 6) AS uncertainty_twap,
           round(p.by_money, 6) AS vwap, round(2 * greatest(p.by_money - 0.5, 0.5 - p.by_money), 6) AS uncertainty_vwap,
           m.outcome_prices, m.predicted_label, m.event_tags_json
    FROM means p JOIN fx_markets m ON CAST(m.id AS BIGINT) = p.market
)"""


def _certainty_sql(select: str) -> str:
    return with_fixtures(["fx_trades", "fx_markets"], _CERTAINTY_CTES + "\n" + select)


_CERTAINTY_SQL = _certainty_sql("SELECT * FROM scores")


@register("certainty_scores", _CERTAINTY_SQL)
def q_certainty_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(C.certainty(fx.fx_trades(spark, sf_dir), fx.fx_markets(spark, sf_dir)))


# ------------------------------------------------------------------ rollups
from marketlens.functions import certainty_bucket  # noqa: E402
from marketlens.functions import constants as K  # noqa: E402
from marketlens.operators import enrich as EN  # noqa: E402
from marketlens.operators import rollups as R  # noqa: E402


def sql_category(j: str) -> str:
    """DuckDB form of ``primary_category``."""
    slugs = ", ".join(f"'{s}'" for s in K.ALLOWED_SLUGS)
    return (f"CASE WHEN json_valid({j}) AND ltrim({j}) LIKE '[%' THEN "
            f"list_filter(from_json({j}, '[{{\"slug\":\"VARCHAR\",\"label\":\"VARCHAR\"}}]'), "
            f"lambda x: x.slug IN ({slugs}))[1].label END")


_CATALOG_CTE = f"""
catalog AS (
    SELECT id, question, predicted_label, category FROM (
        SELECT id, question, predicted_label, created_s, end_s, {sql_category('event_tags_json')} AS category
        FROM fx_markets) m
    WHERE category IS NOT NULL AND (end_s - created_s) / 86400.0 >= 1.0
)"""


@register("market_summary", with_fixtures(["fx_markets"], """
SELECT predicted_label, count(*) AS total_count, round(sum(volume), 4) AS total_volume,
       round(avg(volume), 6) AS avg_volume
FROM fx_markets GROUP BY predicted_label"""))
def q_market_summary(spark, sf_dir):
    df = R.market_summary(fx.fx_markets(spark, sf_dir))
    return round_doubles(round_doubles(df, 4, ["total_volume"]), 6, ["avg_volume"])


@register("top_markets", with_fixtures(["fx_markets"], """
SELECT id, predicted_label, question, event_title, volume, closed, created_s
FROM fx_markets ORDER BY volume DESC NULLS LAST, id LIMIT 10"""))
def q_top_markets(spark, sf_dir):
    return R.top_markets(fx.fx_markets(spark, sf_dir), 10)


@register("search_markets", with_fixtures(["fx_markets"], """
SELECT id, predicted_label, question, event_title, volume FROM fx_markets
WHERE question ILIKE '%ame%' OR event_title ILIKE '%ame%'
ORDER BY volume DESC NULLS LAST, id LIMIT 50"""))
def q_search_markets(spark, sf_dir):
    return R.search(fx.fx_markets(spark, sf_dir), "ame", 50)


@register("search_wildcard", with_fixtures(["fx_markets"], """
SELECT id, predicted_label, question, event_title, volume FROM fx_markets
WHERE question ILIKE '%a_e%' OR event_title ILIKE '%a_e%'
ORDER BY volume DESC NULLS LAST, id LIMIT 50"""))
def q_search_wildcard(spark, sf_dir):
    return R.search(fx.fx_markets(spark, sf_dir), "a_e", 50)


@register("search_literal", with_fixtures(["fx_markets"], f""" {_CATALOG_CTE},
hits AS (
    SELECT id, question FROM catalog
    WHERE coalesce(contains(lower(question), '0001'), false) OR contains(lower(id), '0001')
)
SELECT id, question, (SELECT count(*) FROM hits) > 50 AS has_more
FROM hits ORDER BY id LIMIT 50"""))
def q_search_literal(spark, sf_dir):
    return R.search_literal(EN.viable_markets(fx.fx_markets(spark, sf_dir)), "0001", 50)


@register("whales", with_fixtures(["fx_users"], """
totals AS (
    SELECT market_id, address, role, sum(usd_amount) AS total_usd_volume,
           sum(token_amount) AS total_tokens, avg(price) AS avg_entry_price
    FROM fx_users GROUP BY market_id, address, role
)
SELECT market_id, address, role, round(total_usd_volume, 4) AS total_usd_volume,
       round(total_tokens, 4) AS total_tokens, round(avg_entry_price, 6) AS avg_entry_price, rank
FROM (SELECT *, row_number() OVER (PARTITION BY market_id
                                   ORDER BY total_usd_volume DESC, address, role) AS rank FROM totals)
WHERE rank <= 10"""))
def q_whales(spark, sf_dir):
    df = R.whales(fx.fx_users(spark, sf_dir), None, 10)
    df = round_doubles(df, 4, ["total_usd_volume", "total_tokens"])
    return round_doubles(df, 6, ["avg_entry_price"]).withColumn("rank", F.col("rank").cast("long"))


@register("whales_per_market", with_fixtures(["fx_users"], """
SELECT address, role, round(sum(usd_amount), 4) AS total_usd_volume,
       round(sum(token_amount), 4) AS total_tokens, round(avg(price), 6) AS avg_entry_price
FROM fx_users WHERE market_id = '7' GROUP BY address, role
ORDER BY sum(usd_amount) DESC, address, role LIMIT 10"""))
def q_whales_per_market(spark, sf_dir):
    df = R.whales(fx.fx_users(spark, sf_dir), "7", 10).select(
        "address", "role", "total_usd_volume", "total_tokens", "avg_entry_price")
    df = round_doubles(df, 4, ["total_usd_volume", "total_tokens"])
    return round_doubles(df, 6, ["avg_entry_price"])


@register("role_distribution", with_fixtures(["fx_users"], """
SELECT market_id, role, count(DISTINCT address) AS unique_users, round(sum(usd_amount), 4) AS total_volume
FROM fx_users GROUP BY market_id, role"""))
def q_role_distribution(spark, sf_dir):
    return round_doubles(R.role_distribution(fx.fx_users(spark, sf_dir)), 4)


@register("role_distribution_approx")
def q_role_distribution_approx(spark, sf_dir):
    """D3 with a HyperLogLog++ distinct count (an estimate: no SQL oracle)."""
    return round_doubles(R.role_distribution(fx.fx_users(spark, sf_dir), approx_rsd=0.02), 4)


def _bars_sql(interval: str) -> str:
    return with_fixtures(["fx_quant"], f"""
SELECT market_id, CAST(epoch(time_bucket(INTERVAL '{interval}', make_timestamp(timestamp * 1000000))) AS BIGINT) AS time_window,
       round(avg(price), 6) AS avg_price, min(price) AS min_price, max(price) AS max_price,
       round(sum(usd_amount), 6) AS total_volume, count(*) AS transaction_count
FROM fx_quant GROUP BY ALL""")


def _bars_query(interval: str):
    def q(spark, sf_dir):
        df = R.bars(fx.fx_quant(spark, sf_dir), interval)
        return round_doubles(df, 6, ["avg_price", "total_volume"])
    return q


for _name, _iv in (("bars_15m", "15 minutes"), ("bars_1h", "1 hour"), ("bars_1d", "1 day"),
                   ("bars_7d", "7 days"), ("bars_1mo", "1 month")):
    register(_name, _bars_sql(_iv))(_bars_query(_iv))


@register("bars_one_market", with_fixtures(["fx_quant"], """
SELECT CAST(epoch(time_bucket(INTERVAL '1 hour', make_timestamp(timestamp * 1000000))) AS BIGINT) AS time_window,
       round(avg(price), 6) AS avg_price, min(price) AS min_price, max(price) AS max_price,
       round(sum(usd_amount), 6) AS total_volume, count(*) AS transaction_count
FROM fx_quant WHERE market_id = '7' GROUP BY ALL ORDER BY time_window"""))
def q_bars_one_market(spark, sf_dir):
    df = R.bars(fx.fx_quant(spark, sf_dir), "1 hour", market_id="7").drop("market_id")
    return round_doubles(df, 6, ["avg_price", "total_volume"]).orderBy("time_window")


@register("primary_category", with_fixtures(["fx_markets"], f"""
SELECT id, event_tags_json, {sql_category('event_tags_json')} AS category FROM fx_markets"""))
def q_primary_category(spark, sf_dir):
    return EN.with_category(fx.fx_markets(spark, sf_dir)).select("id", "event_tags_json", "category")


# tag lists whose elements are not all objects, by nation
_TAG_CASES = ['[5,{"slug":"crypto","label":"Crypto"}]', '[{"slug":"crypto","label":"Crypto"},5]', '[null,{"slug":"sports","label":"Sports"}]',
              '["x",{"slug":"sports","label":"Sports"}]', '[{"slug":"other"},{"slug":"politics","label":"Politics"},"x"]', '[{"slug":"crypto"}]']
_TAG_CASE_SQL = "CASE n_nationkey % 6 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TAG_CASES)) + " END"


@register("category_of_mixed_tags", f"""
WITH n AS (SELECT n_nationkey AS id, {_TAG_CASE_SQL} AS tags FROM nation),
e AS (SELECT id, tags, unnest(range(CAST(json_array_length(tags) AS BIGINT))) AS i FROM n),
f AS (SELECT id, i, json_type(json_extract(tags, '$[' || i || ']')) AS kind,
             json_extract_string(tags, '$[' || i || '].slug') AS slug, json_extract_string(tags, '$[' || i || '].label') AS label FROM e),
first AS (SELECT id, min(i) AS i FROM f WHERE kind <> 'OBJECT' OR slug IN ({", ".join(f"'{x}'" for x in K.ALLOWED_SLUGS)}) GROUP BY id)
SELECT n.id, n.tags, CASE WHEN f.kind = 'OBJECT' THEN f.label END AS category
FROM n LEFT JOIN first USING (id) LEFT JOIN f ON f.id = first.id AND f.i = first.i""")
def q_category_of_mixed_tags(spark, sf_dir):
    """2.8 JSON parse on tag lists that hold scalars before or after the match."""
    from marketlens.functions import primary_category
    from marketlens.sources import load
    k = F.col("n_nationkey").cast("long")
    tags = F.element_at(F.array(*[F.lit(t) for t in _TAG_CASES]), (k % 6 + 1).cast("int"))
    n = load(spark, sf_dir, "nation", ["n_nationkey"]).select(F.col("n_nationkey").alias("id"), tags.alias("tags"))
    return n.withColumn("category", primary_category("tags"))


@register("viable_markets", with_fixtures(["fx_markets"], f"{_CATALOG_CTE} SELECT * FROM catalog"))
def q_viable_markets(spark, sf_dir):
    return EN.viable_markets(fx.fx_markets(spark, sf_dir))


@register("facets", with_fixtures(["fx_markets"], f"""{_CATALOG_CTE}
SELECT DISTINCT 'genre' AS facet, category AS value FROM catalog WHERE category <> ''
UNION ALL SELECT DISTINCT 'label', predicted_label FROM catalog WHERE predicted_label <> ''
UNION ALL SELECT 'genre', 'All' UNION ALL SELECT 'label', 'All'"""))
def q_facets(spark, sf_dir):
    return R.facets(EN.viable_markets(fx.fx_markets(spark, sf_dir)))


@register("facet_filter", with_fixtures(["fx_markets"], f"""{_CATALOG_CTE}
SELECT * FROM catalog WHERE category = 'Crypto'"""))
def q_facet_filter(spark, sf_dir):
    return R.facet_filter(EN.viable_markets(fx.fx_markets(spark, sf_dir)), genre="Crypto", label="All")


@register("facet_filter_both", with_fixtures(["fx_markets"], f"""{_CATALOG_CTE}
SELECT * FROM catalog WHERE category = 'Politics' AND predicted_label = 'Stochastic'"""))
def q_facet_filter_both(spark, sf_dir):
    return R.facet_filter(EN.viable_markets(fx.fx_markets(spark, sf_dir)), genre="Politics", label="Stochastic")


# -------------------------------------------------------- time-series build
from marketlens.plans import timeseries as TS  # noqa: E402

_TS_CTES = f"""{_CATALOG_CTE},
q AS (SELECT * FROM fx_quant WHERE market_id IN (SELECT id FROM catalog)),
f1 AS (SELECT *, lag(price) OVER (PARTITION BY market_id ORDER BY timestamp, seq) AS prev_price FROM q),
f2 AS (SELECT *, coalesce(price - prev_price, 0) AS price_diff,
              CASE WHEN prev_price IS NOT NULL AND price / greatest(prev_price, 0.0001) > 0
                   THEN ln(price / greatest(prev_price, 0.0001)) END AS ret
       FROM f1),
f3 AS (SELECT *, price_diff >= 0 AS is_yes,
              CASE WHEN price_diff >= 0 THEN usd_amount ELSE 0.0 END AS yes_vol,
              CASE WHEN price_diff < 0 THEN usd_amount ELSE 0.0 END AS no_vol,
              CASE WHEN count(ret) OVER w10 = 10 THEN stddev_samp(ret) OVER w10 END AS roll_std
       FROM f2
       WINDOW w10 AS (PARTITION BY market_id ORDER BY timestamp, seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
ms AS (SELECT market_id, avg(roll_std) AS rm, stddev_samp(roll_std) AS rs FROM f3 GROUP BY market_id),
f4 AS (SELECT f3.*, CASE WHEN rs IS NULL OR rs < 0.00001 THEN 0.0
                         WHEN roll_std IS NOT NULL THEN greatest(least((roll_std - rm) / rs, 20.0), -20.0) END AS zscore
       FROM f3 JOIN ms USING (market_id)),
feats AS (SELECT *, lead(zscore) OVER (PARTITION BY market_id ORDER BY timestamp, seq) AS future_z FROM f4),
bins AS (
    SELECT market_id, timestamp // 1800 AS bin,
           arg_max(price, (timestamp, seq)) FILTER (WHERE price IS NOT NULL) AS price,
           arg_max(zscore, (timestamp, seq)) FILTER (WHERE zscore IS NOT NULL) AS zscore,
           sum(yes_vol) AS yes_volume, sum(no_vol) AS no_volume,
           count(*) FILTER (WHERE is_yes) AS yes_count, count(*) FILTER (WHERE NOT is_yes) AS no_count,
           count(*) AS trade_count, sum(usd_amount) AS usd, max(price) AS p_max, min(price) AS p_min
    FROM feats GROUP BY ALL
),
ols AS (
    SELECT count(*) AS n, sum(yes_vol) AS sy, sum(no_vol) AS sn, sum(yes_vol * yes_vol) AS syy,
           sum(no_vol * no_vol) AS snn, sum(yes_vol * no_vol) AS syn, sum(future_z) AS sz,
           sum(yes_vol * future_z) AS syz, sum(no_vol * future_z) AS snz
    FROM feats WHERE ret IS NOT NULL AND zscore IS NOT NULL AND future_z IS NOT NULL
),
cramer AS (
    SELECT n,
           n * (syy * snn - syn * syn) - sy * (sy * snn - syn * sn) + sn * (sy * syn - syy * sn) AS det,
           n * (syz * snn - syn * snz) - sz * (sy * snn - syn * sn) + sn * (sy * snz - syz * sn) AS det1,
           n * (syy * snz - syz * syn) - sy * (sy * snz - syz * sn) + sz * (sy * syn - syy * sn) AS det2
    FROM ols
),
imp AS (
    SELECT n, CASE WHEN n > 0 AND det <> 0 THEN det1 / det ELSE 0.000015 END AS yes_impact,
              CASE WHEN n > 0 AND det <> 0 THEN det2 / det ELSE 0.000015 END AS no_impact
    FROM cramer
),
span AS (
    SELECT market_id, sum(trade_count) AS n_trades, sum(usd) AS usd, max(p_max) AS p_max, min(p_min) AS p_min,
           min(bin) AS min_bin, max(bin) AS max_bin, max(bin) - min(bin) + 1 AS n_bins
    FROM bins GROUP BY market_id
),
mid AS (
    SELECT b.market_id, sum(b.trade_count) AS mid_trades FROM bins b JOIN span s USING (market_id)
    WHERE b.bin - s.min_bin >= floor(s.n_bins * 0.2) AND b.bin - s.min_bin < floor(s.n_bins * 0.8)
    GROUP BY b.market_id
),
quality AS (
    SELECT s.*, coalesce(m.mid_trades, 0) AS mid_trades,
           (s.n_bins > 20 AND s.n_trades > 0 AND coalesce(m.mid_trades, 0) / s.n_trades < 0.05) AS dead_middle
    FROM span s LEFT JOIN mid m USING (market_id)
),
kept AS (
    SELECT * FROM quality
    WHERE n_trades >= 50 AND coalesce(usd, 0) >= 5000 AND NOT coalesce(p_max - p_min < 0.10, false)
      AND n_bins >= 24 AND NOT dead_middle AND n_bins > 10
),
grid AS (SELECT market_id, unnest(generate_series(min_bin, max_bin)) AS bin FROM kept),
dj AS (SELECT g.market_id, g.bin, b.price, b.zscore, b.yes_volume, b.no_volume, b.yes_count, b.no_count, b.trade_count
       FROM grid g LEFT JOIN bins b USING (market_id, bin)),
dense AS (
    SELECT market_id, bin,
           last_value(price IGNORE NULLS) OVER w AS price,
           coalesce(last_value(zscore IGNORE NULLS) OVER w, 0.0) AS zscore,
           coalesce(yes_volume, 0.0) AS yes_volume, coalesce(no_volume, 0.0) AS no_volume,
           coalesce(yes_count, 0) AS yes_count, coalesce(no_count, 0) AS no_count,
           coalesce(trade_count, 0) AS trade_count
    FROM dj WINDOW w AS (PARTITION BY market_id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
exog(label, level) AS (VALUES ('Decision-Agent', 0.1543::DOUBLE), ('Objective Outcome', 0.0836::DOUBLE), ('Stochastic', 0.0020::DOUBLE)),
level AS (SELECT c.id, coalesce(e.level, 0.05::DOUBLE) AS level FROM catalog c LEFT JOIN exog e ON e.label = c.predicted_label),
trust(trades, share) AS (VALUES (0, 0.1::DOUBLE), (1, 0.5::DOUBLE), (2, 0.5::DOUBLE)),
forecast AS (
    SELECT b.market_id, b.bin + 1 AS bin, 0.9633::DOUBLE * b.zscore * coalesce(t.share, 1.0::DOUBLE) AS memory,
           i.yes_impact * b.yes_volume AS push_yes, i.no_impact * b.no_volume AS push_no
    FROM dense b LEFT JOIN trust t ON t.trades = b.trade_count CROSS JOIN imp i
),
series AS (
    SELECT now.market_id, now.bin * 1800000 AS timestamp, round(now.price, 4) AS price, round(now.zscore, 2) AS zscore,
           round(now.yes_volume, 2) AS yes_volume, round(now.no_volume, 2) AS no_volume, now.yes_count, now.no_count, now.trade_count,
           round(coalesce(v.level, 0.05::DOUBLE) + f.memory + f.push_yes + f.push_no, 4) AS arimax
    FROM dense now LEFT JOIN forecast f ON f.market_id = now.market_id AND f.bin = now.bin
         LEFT JOIN level v ON v.id = now.market_id
)"""


def _ts_sql(select: str) -> str:
    return with_fixtures(["fx_quant", "fx_markets"], f"{_TS_CTES}\n{select}")


def _ts_build(spark, sf_dir, **kw):
    return TS.build(fx.fx_quant(spark, sf_dir), fx.fx_markets(spark, sf_dir), **kw)


@register("trade_features", _ts_sql("""
SELECT market_id, timestamp, seq, price_diff, yes_vol, no_vol, round(ret, 9) AS ret,
       round(roll_std, 9) AS roll_std, round(zscore, 9) AS zscore, round(future_z, 9) AS future_z FROM feats"""))
def q_trade_features(spark, sf_dir):
    f = _ts_build(spark, sf_dir, checkpoint=False).features
    f = f.select("market_id", "timestamp", "seq", "price_diff", "yes_vol", "no_vol", "ret", "roll_std", "zscore", "future_z")
    return round_doubles(f, 9, ["ret", "roll_std", "zscore", "future_z"])


@register("trade_features_split", ORACLES["trade_features"])
def q_trade_features_split(spark, sf_dir):
    """W2-W7 with a budget of 40 trades a task: nearly every market is hot and cut into chunks."""
    f = _ts_build(spark, sf_dir, checkpoint=False, rows_per_task=40).features
    f = f.select("market_id", "timestamp", "seq", "price_diff", "yes_vol", "no_vol", "ret", "roll_std", "zscore", "future_z")
    return round_doubles(f, 9, ["ret", "roll_std", "zscore", "future_z"])


@register("volatility_z", _ts_sql("""
SELECT market_id, count(*) AS trades, count(roll_std) AS frames, round(avg(roll_std), 9) AS mean_roll_std,
       round(stddev_samp(roll_std), 9) AS sd_roll_std, round(max(zscore), 9) AS max_z, round(min(zscore), 9) AS min_z
FROM feats GROUP BY market_id"""))
def q_volatility_z(spark, sf_dir):
    f = _ts_build(spark, sf_dir, checkpoint=False).features
    out = f.groupBy("market_id").agg(
        F.count(F.lit(1)).alias("trades"), F.count("roll_std").alias("frames"),
        F.avg("roll_std").alias("mean_roll_std"), F.stddev_samp("roll_std").alias("sd_roll_std"),
        F.max("zscore").alias("max_z"), F.min("zscore").alias("min_z"))
    return round_doubles(out, 9)


@register("quality_markets", _ts_sql("""
SELECT market_id, CAST(n_trades AS BIGINT) AS n_trades, round(usd, 6) AS usd, round(p_max - p_min, 9) AS price_range, n_bins, CAST(mid_trades AS BIGINT) AS mid_trades,
       dead_middle, (market_id IN (SELECT market_id FROM kept)) AS keep
FROM quality"""))
def q_quality_markets(spark, sf_dir):
    qm = _ts_build(spark, sf_dir).quality
    out = qm.select("market_id", "n_trades", F.col("usd"), (F.col("p_max") - F.col("p_min")).alias("price_range"),
                    "n_bins", "mid_trades", "dead_middle", "keep")
    return round_doubles(round_doubles(out, 6, ["usd"]), 9, ["price_range"])


@register("dense_bars", _ts_sql("""
SELECT market_id, bin, round(price, 9) AS price, round(zscore, 9) AS zscore, round(yes_volume, 6) AS yes_volume,
       round(no_volume, 6) AS no_volume, yes_count, no_count, trade_count FROM dense"""))
def q_dense_bars(spark, sf_dir):
    d = _ts_build(spark, sf_dir).dense.drop("prev_z", "prev_yes", "prev_no", "prev_tc")
    return round_doubles(round_doubles(d, 9, ["price", "zscore"]), 6, ["yes_volume", "no_volume"])


@register("impact_fit", _ts_sql("""
SELECT n, round(yes_impact, 12) AS yes_impact, round(no_impact, 12) AS no_impact FROM imp"""))
def q_impact_fit(spark, sf_dir):
    return round_doubles(_ts_build(spark, sf_dir).impact, 12)


@register("dashboard_timeseries", _ts_sql("SELECT * FROM series"))
def q_dashboard_timeseries(spark, sf_dir):
    return _ts_build(spark, sf_dir).timeseries


@register("dashboard_timeseries_raw", ORACLES["dashboard_timeseries"])
def q_dashboard_timeseries_raw(spark, sf_dir):
    """The build on the raw inputs: no sequence column (ties in file order), dates as text, numeric market ids."""
    from marketlens.sources import FILE_ORDER
    return TS.build(fx.fx_quant_raw(spark, sf_dir), fx.fx_markets_raw(spark, sf_dir), order=FILE_ORDER,
                    created="created_at", end="end_date").timeseries


@register("arimax_series", _ts_sql("SELECT market_id, timestamp, arimax FROM series WHERE arimax IS NOT NULL"))
def q_arimax_series(spark, sf_dir):
    return _ts_build(spark, sf_dir).timeseries.where("arimax IS NOT NULL").select("market_id", "timestamp", "arimax")


@register("dashboard_catalog", _ts_sql("""
SELECT id, question, predicted_label, category FROM catalog WHERE id IN (SELECT market_id FROM kept)"""))
def q_dashboard_catalog(spark, sf_dir):
    return _ts_build(spark, sf_dir).final_catalog


@register("timeseries_of_market", _ts_sql("""
SELECT timestamp, price, zscore, yes_volume, no_volume, yes_count, no_count, trade_count, arimax
FROM series WHERE market_id = (SELECT min(market_id) FROM kept) ORDER BY timestamp"""))
def q_timeseries_of_market(spark, sf_dir):
    """P2 / T-3: written as the job writes it, read with the key pushed to the scan."""
    from marketlens.plans import jobs
    from marketlens.session import scratch_path
    b = _ts_build(spark, sf_dir)
    first = b.quality.where("keep").agg(F.min("market_id")).first()[0]
    path = scratch_path(spark, "timeseries")
    jobs.save_timeseries(b.timeseries, path)
    return jobs.market_series(spark, path, first)


# ---------------------------------------------------------- dashboard layer
from marketlens.operators import dashboard as DB  # noqa: E402

_DS_CTES = """,
ds0 AS (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY timestamp) - 1 AS pos,
               count(*) OVER (PARTITION BY market_id) AS npts FROM series),
ds1 AS (SELECT * EXCLUDE (pos, npts) FROM ds0
        WHERE npts <= 1440 OR pos % CAST(ceil(npts / 1440.0::DOUBLE) AS BIGINT) = 0),
ds AS (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY timestamp) - 1 AS idx FROM ds1)"""

# the full series, numbered like the thinned one
_FULL_CTES = """,
ds AS (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY timestamp) - 1 AS idx FROM series)"""

_FLOW_CTES = """,
dcat AS (SELECT * FROM catalog WHERE id IN (SELECT market_id FROM kept)),
names AS (
    SELECT CASE WHEN category IS NULL OR category = '' THEN 'Unknown'
                ELSE upper(substr(category, 1, 1)) || substr(category, 2) END AS source,
           CASE WHEN predicted_label IS NULL OR predicted_label = '' THEN 'Unclassified'
                ELSE upper(substr(predicted_label, 1, 1)) || substr(predicted_label, 2) END AS target
    FROM dcat)"""


def _share_sql(n: str, total: str) -> str:
    raw = f"({n} * 100.0::DOUBLE / {total})"
    return f"CASE WHEN {raw} < 0.1 THEN round({raw}, 3) ELSE round({raw}, 1) END"


def _series(spark, sf_dir):
    return _ts_build(spark, sf_dir).timeseries


@register("market_kpis", _ts_sql("""
SELECT market_id, CAST(sum(coalesce(trade_count, 0)) AS BIGINT) AS total_trades, max(coalesce(zscore, 0)) AS max_z,
       round(avg(CASE WHEN coalesce(zscore, 0) > 1.96 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100.0::DOUBLE, 1) AS anomaly_pct,
       coalesce(arg_max(zscore, timestamp), 0) AS current_z, coalesce(arg_max(arimax, timestamp), 0) AS current_arimax
FROM series GROUP BY market_id"""))
def q_market_kpis(spark, sf_dir):
    return DB.market_kpis(_series(spark, sf_dir))


@register("flow_links", _ts_sql(_FLOW_CTES + f"""
SELECT source, target, count(*) AS n, {_share_sql('count(*)', '(SELECT count(*) FROM names)')} AS share_pct,
       sqrt(count(*)) AS weight
FROM names GROUP BY source, target"""))
def q_flow_links(spark, sf_dir):
    return DB.flow_links(_ts_build(spark, sf_dir).final_catalog)


@register("flow_nodes", _ts_sql(_FLOW_CTES + f""",
ends AS (SELECT source AS name FROM names UNION ALL SELECT target FROM names)
SELECT name, count(*) AS n, {_share_sql('count(*)', '(SELECT count(*) FROM names)')} AS share_pct
FROM ends GROUP BY name"""))
def q_flow_nodes(spark, sf_dir):
    return DB.flow_nodes(_ts_build(spark, sf_dir).final_catalog)


@register("timeline_downsampled", _ts_sql(_DS_CTES + """
SELECT market_id, idx, timestamp, strftime(make_timestamp(timestamp * 1000), '%-m/%-d %H:%M') AS time_label,
       price, zscore, CASE WHEN arimax <> 0 THEN arimax END AS arimax,
       coalesce(yes_volume, 0.0) AS yes_volume, coalesce(no_volume, 0.0) AS no_volume,
       coalesce(trade_count, 0) AS trade_count,
       CAST(sum(coalesce(trade_count, 0)) OVER (PARTITION BY market_id ORDER BY idx
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cumulative_count,
       CAST(sum(coalesce(trade_count, 0)) OVER (PARTITION BY market_id) AS BIGINT) AS total_trades
FROM ds"""))
def q_timeline_downsampled(spark, sf_dir):
    return DB.timeline(DB.downsample(_series(spark, sf_dir)))


def _numbered(series):
    from pyspark.sql import Window, functions as F

    return series.withColumn("idx", (F.row_number().over(Window.partitionBy("market_id").orderBy("timestamp")) - 1).cast("long"))


@register("anomaly_regions", _ts_sql(_FULL_CTES + """,
flags AS (SELECT market_id, idx, coalesce(zscore > 1.96, false) AS hot,
                 max(idx) OVER (PARTITION BY market_id) AS last_idx FROM ds),
chg AS (SELECT *, CASE WHEN hot <> coalesce(lag(hot) OVER (PARTITION BY market_id ORDER BY idx), false)
                       THEN 1 ELSE 0 END AS c FROM flags),
runs AS (SELECT *, sum(c) OVER (PARTITION BY market_id ORDER BY idx
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM chg)
SELECT market_id, min(idx) AS start, least(max(idx) + 1, max(last_idx)) AS "end"
FROM runs WHERE hot GROUP BY market_id, run"""))
def q_anomaly_regions(spark, sf_dir):
    return DB.anomaly_regions(_numbered(_series(spark, sf_dir)))


@register("series_extent", _ts_sql(_FULL_CTES + """
SELECT market_id,
       CASE WHEN max(coalesce(yes_volume, 0) + coalesce(no_volume, 0)) = 0 THEN 1.0::DOUBLE
            ELSE max(coalesce(yes_volume, 0) + coalesce(no_volume, 0)) END AS max_volume,
       min(least(coalesce(zscore, 0), coalesce(arimax, 0), -1.0::DOUBLE)) AS min_z,
       max(greatest(coalesce(zscore, 0), coalesce(arimax, 0), 4.0::DOUBLE)) AS max_z
FROM ds GROUP BY market_id"""))
def q_series_extent(spark, sf_dir):
    return DB.series_extent(_numbered(_series(spark, sf_dir)))


@register("liquidity_flags", _ts_sql(_FULL_CTES + """,
v AS (SELECT *, coalesce(yes_volume, 0) + coalesce(no_volume, 0) AS vol,
             max(coalesce(yes_volume, 0) + coalesce(no_volume, 0)) OVER (PARTITION BY market_id) AS mv FROM ds)
SELECT market_id, idx, timestamp,
       (vol < (CASE WHEN mv = 0 THEN 1.0::DOUBLE ELSE mv END) * 0.05::DOUBLE OR coalesce(trade_count, 0) < 3) AS low_liquidity,
       CASE WHEN coalesce(yes_volume, 0) > coalesce(no_volume, 0) THEN 'yes'
            WHEN coalesce(no_volume, 0) > coalesce(yes_volume, 0) THEN 'no' ELSE 'even' END AS dominant_side
FROM v"""))
def q_liquidity_flags(spark, sf_dir):
    return DB.point_flags(_numbered(_series(spark, sf_dir)))


@register("certainty_buckets", with_fixtures(["fx_certainty"], """
SELECT market_id, uncertainty_twap,
       CASE WHEN uncertainty_twap IS NULL THEN 'no data' WHEN uncertainty_twap >= 0.66 THEN 'decided'
            WHEN uncertainty_twap >= 0.33 THEN 'contested' ELSE 'coin-flip' END AS bucket
FROM fx_certainty"""))
def q_certainty_buckets(spark, sf_dir):
    c = fx.fx_certainty(spark, sf_dir)
    return c.select("market_id", "uncertainty_twap", certainty_bucket("uncertainty_twap").alias("bucket"))


@register("label_impact", with_fixtures(["fx_markets"], """
SELECT id, predicted_label,
       CASE predicted_label WHEN 'Decision-Agent' THEN '0.1543' WHEN 'Objective Outcome' THEN '0.0836' ELSE '0.002' END AS impact,
       CASE predicted_label WHEN 'Decision-Agent' THEN 'Volatility is based mostly on previous market momentum.'
            WHEN 'Objective Outcome' THEN 'Volatility is anchored to predictable external events'
            ELSE 'The market moves randomly regardless of past data.' END AS impact_text
FROM fx_markets"""))
def q_label_impact(spark, sf_dir):
    from marketlens.functions import label_impact
    m = fx.fx_markets(spark, sf_dir)
    v, t = label_impact("predicted_label")
    return m.select("id", "predicted_label", v.alias("impact"), t.alias("impact_text"))


# --------------------------------------------------------------- ridgeline
from marketlens.operators import density as DN  # noqa: E402


def _band_sql(v: str) -> str:
    parts = []
    for lo, hi, name in K.VOLUME_BANDS:
        cond = f"{v} >= {lo}" + (f" AND {v} < {hi}" if hi is not None else "")
        parts.append(f"WHEN NOT isnan({v}) AND {cond} THEN '{name}'")
    return "CASE " + " ".join(parts) + " END"


_TYPES_SQL = ", ".join(f"'{t}'" for t in K.MARKET_TYPES)
_CELLS_VALUES = ", ".join(f"('{t}', {ti}, '{b[2]}', {bi})" for ti, t in enumerate(K.MARKET_TYPES)
                          for bi, b in enumerate(K.VOLUME_BANDS))


def _ridge_ctes() -> str:
    return f"""
base AS (
    SELECT market_id, uncertainty_twap AS c, predicted_label AS type, {_band_sql('volume')} AS band
    FROM fx_certainty
    WHERE uncertainty_twap IS NOT NULL AND volume IS NOT NULL AND predicted_label IN ({_TYPES_SQL})
),
b AS (SELECT * FROM base WHERE band IS NOT NULL),
grid AS (SELECT * FROM (VALUES {_CELLS_VALUES}) t(type, type_order, band, band_order)),
stats AS (SELECT type, band, count(*) AS n, min(c) AS lo, max(c) AS hi FROM b GROUP BY ALL),
cells AS (
    SELECT g.type, g.type_order, g.band, g.band_order, coalesce(s.n, 0) AS n,
           coalesce(s.n >= 50 AND s.hi > s.lo, false) AS has_density
    FROM grid g LEFT JOIN stats s USING (type, band)
),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY type, band
                                 ORDER BY md5(cast(market_id AS varchar) || ':0'), market_id) AS r
    FROM b
),
sample AS (SELECT * FROM ranked WHERE (type, band) IN (SELECT (type, band) FROM cells WHERE has_density)),
bw AS (SELECT type, band, count(*) AS m, stddev_samp(c) * pow(count(*)::DOUBLE, -0.2) AS h FROM sample GROUP BY ALL),
pts AS (SELECT s.type, s.band, s.c, w.m, w.h, g.k FROM sample s JOIN bw w USING (type, band)
        CROSS JOIN (SELECT unnest(range(100)) AS k) g),
dens AS (
    SELECT type, band, k,
           sum(exp(-0.5 * ((k / 99.0::DOUBLE - c) / h) * ((k / 99.0::DOUBLE - c) / h)))
           / (first(m) * first(h) * sqrt(2 * pi())) AS d
    FROM pts GROUP BY ALL
)"""


def _ridge_sql() -> str:
    return with_fixtures(["fx_certainty"], _ridge_ctes() + """
SELECT type, band, CAST(k AS INTEGER) AS k, round(k / 99.0::DOUBLE, 4) AS x, round(d, 5) AS density,
       round(d / (SELECT max(d) FROM dens), 6) AS rel_height
FROM dens""")


@register("ridgeline_density", _ridge_sql())
def q_ridgeline_density(spark, sf_dir):
    return DN.ridgeline_density(fx.fx_certainty(spark, sf_dir))


@register("ridgeline_cells", with_fixtures(["fx_certainty"], _ridge_ctes() + """
SELECT type, type_order, band, band_order, n, has_density FROM cells"""))
def q_ridgeline_cells(spark, sf_dir):
    return DN.ridgeline_cells(fx.fx_certainty(spark, sf_dir))


@register("band_share", with_fixtures(["fx_certainty"], _ridge_ctes() + """,
tot AS (SELECT type, sum(n) AS t FROM cells GROUP BY type)
SELECT type, band, n, round(CASE WHEN t > 0 THEN n * 100.0::DOUBLE / t ELSE 0.0 END, 6) AS pct
FROM cells JOIN tot USING (type)"""))
def q_band_share(spark, sf_dir):
    return DN.band_share(DN.ridgeline_cells(fx.fx_certainty(spark, sf_dir)))


@register("volume_bands", with_fixtures(["fx_certainty"], f"""
SELECT market_id, volume, {_band_sql('volume')} AS band FROM fx_certainty"""))
def q_volume_bands(spark, sf_dir):
    from marketlens.functions import volume_band
    c = fx.fx_certainty(spark, sf_dir)
    return c.select("market_id", "volume", volume_band("volume").alias("band"))


# ------------------------------------------------------------------ labels
from marketlens.operators import labels as LB  # noqa: E402

_SPLIT_CTE = """
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(cast(id AS varchar) || ':42'), id) AS r,
           (SELECT count(DISTINCT label) FROM fx_labeled) AS k
    FROM fx_labeled
),
split AS (SELECT *, CASE WHEN r <= 180 // k THEN 'test' ELSE 'train' END AS split FROM ranked)"""

_CLASSES_CTE = """
classes AS (SELECT label FROM fx_labeled UNION SELECT predicted_label FROM fx_labeled),
grid AS (SELECT a.label AS true_label, b.label AS pred_label FROM classes a, classes b),
counts AS (SELECT label AS true_label, predicted_label AS pred_label, count(*) AS n FROM fx_labeled GROUP BY ALL),
cm AS (SELECT g.true_label, g.pred_label, coalesce(c.n, 0) AS n FROM grid g LEFT JOIN counts c USING (true_label, pred_label))"""


@register("label_ids", with_fixtures(["fx_labeled"], """
SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS label_id
FROM (SELECT DISTINCT label FROM fx_labeled WHERE label IS NOT NULL)"""))
def q_label_ids(spark, sf_dir):
    return LB.label_ids(fx.fx_labeled(spark, sf_dir)).withColumn("label_id", F.col("label_id").cast("long"))


@register("stratified_split", with_fixtures(["fx_labeled"], _SPLIT_CTE + """
SELECT id, label, split FROM split"""))
def q_stratified_split(spark, sf_dir):
    return LB.stratified_split(fx.fx_labeled(spark, sf_dir)).select("id", "label", "split")


@register("label_counts", with_fixtures(["fx_labeled"], """
SELECT label, count(*) AS n FROM fx_labeled GROUP BY label ORDER BY label"""))
def q_label_counts(spark, sf_dir):
    return LB.label_counts(fx.fx_labeled(spark, sf_dir))


@register("accuracy", with_fixtures(["fx_labeled"], """
SELECT count(*) AS n, round(avg(CASE WHEN predicted_label = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS accuracy
FROM fx_labeled"""))
def q_accuracy(spark, sf_dir):
    return round_doubles(LB.accuracy(fx.fx_labeled(spark, sf_dir)), 9)


@register("confusion_matrix", with_fixtures(["fx_labeled"], _CLASSES_CTE + """
SELECT true_label, pred_label, n FROM cm"""))
def q_confusion_matrix(spark, sf_dir):
    return LB.confusion(fx.fx_labeled(spark, sf_dir))


@register("classification_report", with_fixtures(["fx_labeled"], _CLASSES_CTE + """,
per AS (
    SELECT t.true_label AS cls, t.n AS tp, s.support, p.predicted,
           CASE WHEN p.predicted > 0 THEN t.n / p.predicted ELSE 0.0 END AS precision,
           CASE WHEN s.support > 0 THEN t.n / s.support ELSE 0.0 END AS recall
    FROM (SELECT * FROM cm WHERE true_label = pred_label) t
    JOIN (SELECT true_label AS cls, sum(n) AS support FROM cm GROUP BY 1) s ON s.cls = t.true_label
    JOIN (SELECT pred_label AS cls, sum(n) AS predicted FROM cm GROUP BY 1) p ON p.cls = t.true_label
),
per2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM per),
tot AS (SELECT sum(support) AS total, sum(tp) AS hits, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
               sum(precision * support) AS wp, sum(recall * support) AS wr, sum(f1 * support) AS wf FROM per2)
SELECT cls AS class, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1_score,
       CAST(support AS BIGINT) AS support FROM per2
UNION ALL SELECT 'accuracy', NULL, NULL, round(hits / total, 4), CAST(total AS BIGINT) FROM tot
UNION ALL SELECT 'macro avg', round(mp, 4), round(mr, 4), round(mf, 4), CAST(total AS BIGINT) FROM tot
UNION ALL SELECT 'weighted avg', round(wp / total, 4), round(wr / total, 4), round(wf / total, 4), CAST(total AS BIGINT) FROM tot"""))
def q_classification_report(spark, sf_dir):
    return LB.classification_report(fx.fx_labeled(spark, sf_dir))


@register("classification_summary", with_fixtures(["fx_labeled"], """
known AS (SELECT DISTINCT label FROM fx_labeled WHERE label IS NOT NULL),
per AS (SELECT predicted_label AS label, count(*) AS n, avg(confidence) AS mc FROM fx_labeled GROUP BY 1)
SELECT k.label, coalesce(p.n, 0) AS count,
       round(coalesce(p.n, 0) * 100.0::DOUBLE / (SELECT count(*) FROM fx_labeled), 2) AS percent,
       round(p.mc, 4) AS mean_confidence
FROM known k LEFT JOIN per p USING (label)"""))
def q_classification_summary(spark, sf_dir):
    df = fx.fx_labeled(spark, sf_dir)
    return LB.classification_summary(df, LB.classes(df, "label"))


@register("classification_overall", with_fixtures(["fx_labeled"], """
SELECT count(*) AS total_markets_classified, round(avg(confidence), 4) AS mean_confidence,
       count(*) FILTER (WHERE confidence < 0.5) AS low_confidence_count FROM fx_labeled"""))
def q_classification_overall(spark, sf_dir):
    return LB.classification_overall(fx.fx_labeled(spark, sf_dir))


@register("unknown_labels", with_fixtures(["fx_labeled"], _SPLIT_CTE + """
SELECT DISTINCT predicted_label AS label FROM split WHERE split = 'test' AND predicted_label IS NOT NULL
EXCEPT SELECT DISTINCT label FROM split WHERE split = 'train'"""))
def q_unknown_labels(spark, sf_dir):
    s = LB.stratified_split(fx.fx_labeled(spark, sf_dir))
    hold = s.where("split = 'test'").select(F.col("predicted_label").alias("label"))
    return LB.unknown_labels(hold, s.where("split = 'train'"))


from marketlens.operators import model_selection as MS  # noqa: E402


def _md5_bucket_sql(w: str) -> str:
    digit = "instr('0123456789abcdef', substr(md5({w}), {i}, 1)) - 1"
    return " + ".join(f"({digit.format(w=w, i=i + 1)}) * {16 ** (3 - i)}" for i in range(4))


def _words_sql(text: str) -> str:
    return f"unnest(regexp_extract_all(translate(coalesce({text}, ''), '{MS.UPPER}', '{MS.LOWER}'), '[^\\x20\\x09-\\x0D]+'))"


def _log_sql(share: str) -> str:
    return f"CAST(floor(ln({share}) * {MS.UNIT}.0::DOUBLE + 0.5::DOUBLE) AS BIGINT)"


_STEPS_SQL = ", ".join(f"({i + 1}, {a}::DOUBLE)" for i, a in enumerate(MS.SMOOTHING))
# naive Bayes of every step: counts by label and bucket on the train split, log probabilities in integer units
_NB_CTES = _SPLIT_CTE + f""",
words AS (SELECT label, {_md5_bucket_sql('w')} AS bucket, count(*) AS c
          FROM (SELECT label, {_words_sql('question')} AS w FROM split WHERE split = 'train') GROUP BY ALL),
lab AS (SELECT label, count(*) AS d, sum(count(*)) OVER () AS docs FROM split WHERE split = 'train' GROUP BY label),
tot AS (SELECT lab.label, {_log_sql('d::DOUBLE / docs::DOUBLE')} AS prior, coalesce(t, 0) AS t
        FROM lab LEFT JOIN (SELECT label, sum(c) AS t FROM words GROUP BY label) USING (label)),
steps(step, a) AS (VALUES {_STEPS_SQL}),
params AS (SELECT * FROM steps, tot),
asked AS ({{asked}}),
hashed AS (SELECT id, {_md5_bucket_sql('w')} AS bucket, count(*) AS n
           FROM (SELECT id, {_words_sql('question')} AS w FROM asked) GROUP BY ALL),
used AS (SELECT DISTINCT bucket FROM hashed),
weight AS (SELECT p.step, p.label, u.bucket,
                  {_log_sql(f"(coalesce(w.c, 0) + p.a) / (p.t + p.a * {MS.BUCKETS})")} AS v
           FROM used u CROSS JOIN params p LEFT JOIN words w ON w.bucket = u.bucket AND w.label = p.label),
sums AS (SELECT h.id, v.step, v.label, sum(h.n * v.v) AS s FROM hashed h JOIN weight v USING (bucket) GROUP BY ALL),
scored AS (SELECT q.id, p.step, p.label, CAST(p.prior + coalesce(s.s, 0) AS BIGINT) AS s
           FROM asked q CROSS JOIN params p LEFT JOIN sums s ON s.id = q.id AND s.step = p.step AND s.label = p.label),
answer AS (SELECT id, step, label, 1.0::DOUBLE / sum(exp((s - m) / {MS.UNIT}.0::DOUBLE)) OVER (PARTITION BY id, step) AS p,
                  row_number() OVER (PARTITION BY id, step ORDER BY s DESC, label) AS r
           FROM (SELECT *, max(s) OVER (PARTITION BY id, step) AS m FROM scored))"""
_NB_METRICS = """
metrics AS (SELECT a.step, st.a AS smoothing, count(*) AS n, count(*) FILTER (WHERE a.label = s.label) AS hits
            FROM answer a JOIN (SELECT id, label FROM split WHERE split = 'test') s USING (id) JOIN steps st USING (step)
            WHERE a.r = 1 GROUP BY ALL)"""


@register("model_metrics", with_fixtures(["fx_labeled"], _NB_CTES.replace(
    "{asked}", "SELECT id, question FROM split WHERE split = 'test'") + "," + _NB_METRICS + """
SELECT step, smoothing, n, hits, round(hits / n, 9) AS accuracy,
       step = (SELECT step FROM metrics ORDER BY hits DESC, step LIMIT 1) AS best FROM metrics"""))
def q_model_metrics(spark, sf_dir):
    """M6: held-out accuracy of every training step and the step that is kept."""
    s = LB.stratified_split(fx.fx_labeled(spark, sf_dir))
    model = MS.naive_bayes_steps(s.where("split = 'train'"))
    return MS.step_metrics(model, s.where("split = 'test'"))


@register("document_labels", with_fixtures(["fx_labeled"], _NB_CTES.replace(
    "{asked}", "SELECT id, question FROM split") + "," + _NB_METRICS + """
SELECT id, label AS predicted_label, round(p, 6) AS confidence FROM answer
WHERE r = 1 AND step = (SELECT step FROM metrics ORDER BY hits DESC, step LIMIT 1)"""))
def q_document_labels(spark, sf_dir):
    """M3 / M4: the best step's model labels every text of the whole table, with its confidence."""
    s = LB.stratified_split(fx.fx_labeled(spark, sf_dir))
    model = MS.naive_bayes_steps(s.where("split = 'train'"))
    best = MS.best_step(MS.step_metrics(model, s.where("split = 'test'")))
    return MS.label_rows(model, s, best, keep=["id"])


@register("text_scoring")
def q_text_scoring(spark, sf_dir):
    """M3/M4: the epoch of the highest held-out accuracy (whole texts) scores every market."""
    s = write_table(LB.stratified_split(fx.fx_labeled(spark, sf_dir).select("id", "question", "label")), "labelled-split")
    model, _ = MS.fit_best_text_classifier(s.where("split = 'train'"), s.where("split = 'test'"))
    scored = LB.score_text(fx.fx_markets(spark, sf_dir).select("id", "question"), model)
    return scored.select("id", "predicted_label", "confidence")


# -------------------------------------------------------------- enrichment
_COERCE_SQL = "coalesce(TRY_CAST(event_id AS BIGINT), CASE WHEN isfinite(TRY_CAST(event_id AS DOUBLE)) THEN CAST(trunc(TRY_CAST(event_id AS DOUBLE)) AS BIGINT) END)"


@register("coerce_id", with_fixtures(["fx_markets"], f"""
SELECT id, event_id, {_COERCE_SQL} AS event_key FROM fx_markets"""))
def q_coerce_id(spark, sf_dir):
    return EN.coerce_id(fx.fx_markets(spark, sf_dir)).select("id", "event_id", "event_key")


@register("bad_id_count", with_fixtures(["fx_markets"], f"""
SELECT count(*) FILTER (WHERE {_COERCE_SQL} IS NULL) AS bad_ids FROM fx_markets"""))
def q_bad_id_count(spark, sf_dir):
    return EN.bad_id_count(fx.fx_markets(spark, sf_dir))


@register("attach_tags", with_fixtures(["fx_markets", "fx_tag_cache"], f"""
SELECT m.id, m.event_id, coalesce(c.tags_json, '[]') AS event_tags_json
FROM fx_markets m LEFT JOIN fx_tag_cache c ON {_COERCE_SQL.replace('event_id', 'm.event_id')} = c.event_id"""))
def q_attach_tags(spark, sf_dir):
    m = fx.fx_markets(spark, sf_dir).drop("event_tags_json")
    return EN.attach_tags(m, fx.fx_tag_cache(spark, sf_dir)).select("id", "event_id", "event_tags_json")


@register("missing_keys", with_fixtures(["fx_markets", "fx_tag_cache"], f"""
SELECT DISTINCT {_COERCE_SQL} AS event_id FROM fx_markets WHERE {_COERCE_SQL} IS NOT NULL
EXCEPT SELECT event_id FROM fx_tag_cache"""))
def q_missing_keys(spark, sf_dir):
    return EN.missing_keys(fx.fx_markets(spark, sf_dir), fx.fx_tag_cache(spark, sf_dir))


@register("key_counts", with_fixtures(["fx_markets", "fx_tag_cache"], f"""
keys AS (SELECT DISTINCT {_COERCE_SQL} AS k FROM fx_markets WHERE {_COERCE_SQL} IS NOT NULL)
SELECT count(*) AS unique_ids, count(c.event_id) AS cached, count(*) FILTER (WHERE c.event_id IS NULL) AS missing
FROM keys LEFT JOIN (SELECT DISTINCT event_id FROM fx_tag_cache) c ON keys.k = c.event_id"""))
def q_key_counts(spark, sf_dir):
    return EN.key_counts(fx.fx_markets(spark, sf_dir), fx.fx_tag_cache(spark, sf_dir))


@register("upsert_latest", with_fixtures(["fx_tag_cache", "fx_tag_batch"], """
u AS (SELECT *, 0 AS b FROM fx_tag_cache UNION ALL SELECT *, 1 AS b FROM fx_tag_batch)
SELECT event_id, tags_json, fetched_at FROM (
    SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY fetched_at DESC NULLS LAST, b DESC) AS rn FROM u)
WHERE rn = 1"""))
def q_upsert_latest(spark, sf_dir):
    from marketlens.sources import upsert_latest
    return upsert_latest(fx.fx_tag_cache(spark, sf_dir), fx.fx_tag_batch(spark, sf_dir), "event_id", "fetched_at")


@register("first_n_keys", with_fixtures(["fx_markets"], f"""
keys AS (SELECT DISTINCT {_COERCE_SQL} AS k FROM fx_markets WHERE {_COERCE_SQL} IS NOT NULL ORDER BY k LIMIT 5)
SELECT id, event_id FROM fx_markets WHERE {_COERCE_SQL} IN (SELECT k FROM keys)"""))
def q_first_n_keys(spark, sf_dir):
    return EN.first_n_keys(fx.fx_markets(spark, sf_dir), "event_id", 5).select("id", "event_id")


@register("certainty_of", _certainty_sql("""
SELECT market_id, twap, uncertainty_twap, vwap, uncertainty_vwap, last_price, uncertainty_last
FROM scores WHERE market_id = TRY_CAST('42' AS BIGINT) LIMIT 1"""))
def q_certainty_of(spark, sf_dir):
    return C.certainty_of(q_certainty_scores(spark, sf_dir), "42")


@register("audit", _certainty_sql("""
SELECT count(*) AS rows, count(*) FILTER (WHERE predicted_label IS NULL) AS null_labels FROM scores"""))
def q_audit(spark, sf_dir):
    return C.audit(q_certainty_scores(spark, sf_dir))


@register("json_safe", _ts_sql("SELECT market_id, timestamp, price, zscore, arimax FROM series"))
def q_json_safe(spark, sf_dir):
    from marketlens.functions import json_safe
    return json_safe(_series(spark, sf_dir).select("market_id", "timestamp", "price", "zscore", "arimax"))


# ------------------------------------------------------------ sources, misc
@register("spread_sample", with_fixtures(["fx_trades"], """
nb AS (SELECT max(block_number) + 1 AS total FROM fx_trades),
idx AS (
    SELECT DISTINCT CAST(round_even(i * (total - 1) / 9.0::DOUBLE, 0) AS BIGINT) AS b
    FROM nb, range(10) r(i)
)
SELECT market_id, timestamp, block_number, log_index, price FROM fx_trades WHERE block_number IN (SELECT b FROM idx)"""))
def q_spread_sample(spark, sf_dir):
    """Ten evenly spread blocks (endpoints included) of the trade tape;
    the block count is one aggregate read back."""
    from marketlens.sources import spread_sample
    t = fx.fx_trades(spark, sf_dir)
    total = t.agg(F.max("block_number")).first()[0] + 1
    return spread_sample(t, "block_number", 10, int(total)).select(
        "market_id", "timestamp", "block_number", "log_index", "price")


@register("catalog_counts", _ts_sql("""
SELECT (SELECT count(DISTINCT id) FROM catalog) AS viable_markets,
       (SELECT count(*) FROM catalog WHERE id IN (SELECT market_id FROM kept)) AS catalog_markets"""))
def q_catalog_counts(spark, sf_dir):
    """Distinct viable markets and markets in the final catalog."""
    b = _ts_build(spark, sf_dir)
    kept = b.final_catalog.count()  # one number read back
    return b.catalog.agg(F.countDistinct("id").alias("viable_markets"),
                         F.lit(kept).cast("long").alias("catalog_markets"))


@register("top_markets_display", with_fixtures(["fx_markets"], """
SELECT id, volume, strftime(make_timestamp(created_s * 1000000), '%Y-%m-%d %H:%M:%S') AS created_at
FROM fx_markets ORDER BY volume DESC NULLS LAST, id LIMIT 10"""))
def q_top_markets_display(spark, sf_dir):
    """T-1 with P16: the creation time rendered as text."""
    t = R.top_markets(fx.fx_markets(spark, sf_dir), 10)
    from marketlens.functions import epoch_label
    return t.select("id", "volume", epoch_label("created_s", "iso").alias("created_at"))


def _score_part(cols: list[str]):
    def q(spark, sf_dir):
        return q_certainty_scores(spark, sf_dir).select("market_id", *cols)
    return q


for _name, _cols in (("last_price", ["last_price", "uncertainty_last"]), ("vwap", ["volume", "vwap", "uncertainty_vwap"]),
                     ("twap", ["twap", "uncertainty_twap"])):
    register(_name, _certainty_sql(f"SELECT market_id, {', '.join(_cols)} FROM scores"))(_score_part(_cols))


@register("twap_split", ORACLES["twap"])
def q_twap_split(spark, sf_dir):
    """W1 / D5d with a budget of 20 trades a task."""
    c = C.certainty(fx.fx_trades(spark, sf_dir), fx.fx_markets(spark, sf_dir), rows_per_task=20)
    return round_doubles(c.select("market_id", "twap", "uncertainty_twap"))


@register("dominant_side", _ts_sql("""
SELECT market_id, timestamp, CASE WHEN coalesce(yes_volume, 0) > coalesce(no_volume, 0) THEN 'yes'
            WHEN coalesce(no_volume, 0) > coalesce(yes_volume, 0) THEN 'no' ELSE 'even' END AS dominant_side
FROM series"""))
def q_dominant_side(spark, sf_dir):
    from marketlens.functions import dominant_side
    s = _series(spark, sf_dir)
    return s.select("market_id", "timestamp", dominant_side("yes_volume", "no_volume").alias("dominant_side"))
