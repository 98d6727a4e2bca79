"""Fixture views: the application's input tables derived from the driver's
TPC-H-like tables (see FIXTURES.md).

Each fixture exists twice: as a Spark DataFrame built from the parquet
tables, and as DuckDB SQL text used as a CTE by the oracle queries. Both
derive every row from the given tables, so the work grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions import ntz_epoch_seconds
from marketlens.sources import load, with_file_order

# Slug / label pairs used to build the fixture tag JSON (fixture constants,
# by nation key modulo 12 for 0..7).
_FX_SLUGS = ["sports", "politics", "crypto", "technology", "esports", "weather", "finance", "pop-culture"]
_FX_LABELS = ["sports", "Politics", "Crypto", "Technology", "Esports", "Weather", "Finance", "Pop Culture"]


def fx_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value", "props"])
    return ev.select(
        F.col("user_id").cast("string").alias("market_id"),
        ntz_epoch_seconds("ts").alias("timestamp"),
        F.expr("event_id div 100").alias("block_number"),
        (F.col("event_id") % 100).alias("log_index"),
        F.col("event_type").alias("asset_id"),
        ((F.regexp_extract("props", "[0-9]+", 0).cast("int") + 1) / F.lit(102.0)).alias("price"),
        (F.col("value") * F.lit(1.6)).alias("usd_amount"),
    )


def fx_quant(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fx_trades(spark, sf_dir)
    return t.select(
        "market_id", "timestamp",
        (F.col("block_number") * 100 + F.col("log_index")).alias("seq"),
        "price", "usd_amount",
    )


def fx_quant_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tape without a sequence column: trades of one instant in the order of the events file."""
    ev = with_file_order(load(spark, sf_dir, "events"))
    return ev.select(
        F.col("user_id").cast("string").alias("market_id"), ntz_epoch_seconds("ts").alias("timestamp"),
        ((F.regexp_extract("props", "[0-9]+", 0).cast("int") + 1) / F.lit(102.0)).alias("price"),
        (F.col("value") * F.lit(1.6)).alias("usd_amount"), "file", "row")


def fx_markets_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The markets with a numeric id and dates as text (two spellings)."""
    m = fx_markets(spark, sf_dir)
    short = F.date_format(F.timestamp_seconds("created_s"), "yyyy-MM-dd HH:mm:ss")
    zoned = F.date_format(F.timestamp_seconds("end_s"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return m.withColumns({"id": F.col("id").cast("long"), "created_at": short, "end_date": zoned}).drop("created_s", "end_s")


def fx_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
    n = load(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    r = load(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    k = F.col("c_custkey")
    m12 = F.col("c_nationkey") % 12
    idx = (m12 + 1).cast("int")
    slug = F.element_at(F.array(*[F.lit(s) for s in _FX_SLUGS]), idx)
    lab = F.element_at(F.array(*[F.lit(s) for s in _FX_LABELS]), idx)
    tags = (
        F.when(m12 == 10, F.lit("[]"))
        .when(m12 == 11, F.lit("garbage"))
        .when(m12 == 9, F.lit('[{"slug":"other","label":"Other"}]'))
        .when(m12 == 8, F.lit('[{"slug":"sports"},{"slug":"crypto","label":"Crypto"}]'))
        .otherwise(F.concat(F.lit('[{"slug":"all","label":"All"},{"slug":"'), slug,
                            F.lit('","label":"'), lab, F.lit('"}]')))
    )
    seg = F.col("c_mktsegment")
    label = (
        F.when(seg == "AUTOMOBILE", F.lit("Stochastic"))
        .when(seg == "HOUSEHOLD", F.lit("Stochastic"))
        .when(seg == "BUILDING", F.lit("Objective Outcome"))
        .when(seg == "FURNITURE", F.lit("Decision-Agent"))
    )
    return j.select(
        k.cast("string").alias("id"),
        F.concat_ws(" ", "c_name", "n_name").alias("question"),
        F.when(k % 10 == 0, F.lit(""))
        .when(k % 10 == 1, F.concat(F.lit("x"), F.col("c_nationkey").cast("string")))
        .otherwise(F.col("c_nationkey").cast("string")).alias("event_id"),
        F.col("r_name").alias("event_title"),
        F.col("c_acctbal").alias("volume"),
        (k % 2 == 0).alias("closed"),
        (F.lit(1704067200) + k).alias("created_s"),
        (F.lit(1704067200) + k + (k % 4) * 43200).alias("end_s"),
        F.lit("click").alias("token1"),
        F.lit("view").alias("token2"),
        F.lit('["0.5", "0.5"]').alias("outcome_prices"),
        label.alias("predicted_label"),
        tags.alias("event_tags_json"),
    )


def fx_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem",
              ["l_suppkey", "l_partkey", "l_linestatus", "l_extendedprice", "l_quantity", "l_discount"])
    return li.select(
        F.col("l_suppkey").cast("string").alias("market_id"),
        F.col("l_partkey").alias("address"),
        F.when(F.col("l_linestatus") == "O", F.lit("maker")).otherwise(F.lit("taker")).alias("role"),
        F.col("l_extendedprice").alias("usd_amount"),
        F.col("l_quantity").alias("token_amount"),
        F.col("l_discount").alias("price"),
    )


def fx_certainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice", "o_orderstatus"])
    st = F.col("o_orderstatus")
    return o.select(
        F.col("o_orderkey").alias("market_id"),
        ((F.col("o_orderkey") * 7919 % 1001) / F.lit(1000.0)).alias("uncertainty_twap"),
        F.col("o_totalprice").alias("volume"),
        F.when(st == "F", F.lit("Stochastic")).when(st == "O", F.lit("Objective Outcome"))
        .when(st == "P", F.lit("Decision-Agent")).alias("predicted_label"),
    )


def fx_labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled texts. The question is the whole document text (never a prefix)."""
    d = load(spark, sf_dir, "documents", ["doc_id", "text", "lang", "n_chars"])
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("question"),
        F.col("lang").alias("label"),
        F.when(F.col("doc_id") % 7 == 0, F.lit("en")).otherwise(F.col("lang")).alias("predicted_label"),
        ((F.col("n_chars") % 1000) / F.lit(1000.0)).alias("confidence"),
    )


def fx_tag_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    return n.where(F.col("n_nationkey") % 3 != 0).select(
        F.col("n_nationkey").cast("long").alias("event_id"),
        F.concat(F.lit('[{"slug":"'), F.lower("n_name"), F.lit('"}]')).alias("tags_json"),
        F.col("n_regionkey").cast("double").alias("fetched_at"),
    )


def fx_tag_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "nation", ["n_nationkey"])
    return n.where(F.col("n_nationkey") % 2 == 0).select(
        F.col("n_nationkey").cast("long").alias("event_id"),
        F.lit('[{"slug":"new"}]').alias("tags_json"),
        F.lit(10.0).alias("fetched_at"),
    )


# --- DuckDB text of the same views (CTE bodies for oracle SQL) --------------

FX_SQL = {
    "fx_trades": """
SELECT cast(user_id AS varchar) AS market_id, epoch_us(ts)//1000000 AS timestamp,
       event_id//100 AS block_number, event_id%100 AS log_index, event_type AS asset_id,
       (cast(regexp_extract(props,'[0-9]+') AS int)+1)/102.0::double AS price, value*1.6 AS usd_amount
FROM events""",
    "fx_quant": """
SELECT market_id, timestamp, block_number*100+log_index AS seq, price, usd_amount FROM fx_trades""",
    "fx_markets": """
SELECT cast(c_custkey AS varchar) AS id, c_name||' '||n_name AS question,
       CASE WHEN c_custkey%10=0 THEN '' WHEN c_custkey%10=1 THEN 'x'||c_nationkey ELSE cast(c_nationkey AS varchar) END AS event_id,
       r_name AS event_title, c_acctbal AS volume, c_custkey%2=0 AS closed,
       1704067200+c_custkey AS created_s, 1704067200+c_custkey+(c_custkey%4)*43200 AS end_s,
       'click' AS token1, 'view' AS token2, '["0.5", "0.5"]' AS outcome_prices,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Stochastic' WHEN 'HOUSEHOLD' THEN 'Stochastic'
            WHEN 'BUILDING' THEN 'Objective Outcome' WHEN 'FURNITURE' THEN 'Decision-Agent' END AS predicted_label,
       CASE c_nationkey%12 WHEN 10 THEN '[]' WHEN 11 THEN 'garbage' WHEN 9 THEN '[{"slug":"other","label":"Other"}]'
            WHEN 8 THEN '[{"slug":"sports"},{"slug":"crypto","label":"Crypto"}]'
            ELSE '[{"slug":"all","label":"All"},{"slug":"'||['sports','politics','crypto','technology','esports','weather','finance','pop-culture'][c_nationkey%12+1]
                 ||'","label":"'||['sports','Politics','Crypto','Technology','Esports','Weather','Finance','Pop Culture'][c_nationkey%12+1]||'"}]' END AS event_tags_json
FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey""",
    "fx_users": """
SELECT cast(l_suppkey AS varchar) AS market_id, l_partkey AS address,
       CASE l_linestatus WHEN 'O' THEN 'maker' ELSE 'taker' END AS role,
       l_extendedprice AS usd_amount, l_quantity AS token_amount, l_discount AS price FROM lineitem""",
    "fx_certainty": """
SELECT o_orderkey AS market_id, (o_orderkey*7919%1001)/1000.0::double AS uncertainty_twap, o_totalprice AS volume,
       CASE o_orderstatus WHEN 'F' THEN 'Stochastic' WHEN 'O' THEN 'Objective Outcome' WHEN 'P' THEN 'Decision-Agent' END AS predicted_label
FROM orders""",
    "fx_labeled": """
SELECT doc_id AS id, text AS question, lang AS label,
       CASE WHEN doc_id%7=0 THEN 'en' ELSE lang END AS predicted_label, (n_chars%1000)/1000.0::double AS confidence FROM documents""",
    "fx_tag_cache": """
SELECT cast(n_nationkey AS bigint) AS event_id, '[{"slug":"'||lower(n_name)||'"}]' AS tags_json, cast(n_regionkey AS double) AS fetched_at
FROM nation WHERE n_nationkey%3<>0""",
    "fx_tag_batch": """
SELECT cast(n_nationkey AS bigint) AS event_id, '[{"slug":"new"}]' AS tags_json, 10.0::double AS fetched_at FROM nation WHERE n_nationkey%2=0""",
}

# fx_quant reads fx_trades.
_FX_DEPS = {"fx_quant": ["fx_trades"]}


def with_fixtures(names: list[str], body: str) -> str:
    """Oracle SQL: the named fixture CTEs, then ``body``.

    ``body`` is either a plain ``SELECT`` or further CTEs written as
    ``name AS (...), ... SELECT ...``.
    """
    order: list[str] = []
    for n in names:
        for d in _FX_DEPS.get(n, []):
            if d not in order:
                order.append(d)
        if n not in order:
            order.append(n)
    ctes = ",\n".join(f"{n} AS ({FX_SQL[n]}\n)" for n in order)
    body = body.strip()
    if body.upper().startswith("SELECT"):
        return f"WITH {ctes}\n{body}"
    return f"WITH {ctes},\n{body}"
