"""Plan-shape checks and a one-hot-market workload."""

from pyspark.sql import functions as F

from marketlens.operators import certainty as C
from marketlens.operators import skew
from marketlens.operators import tape as TP
from marketlens.sources import fixtures as fx

import __spark_entry__ as E
from conftest import SF001, SF01


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_shuffle_the_tape_once(spark):
    feats = TP.trade_features(fx.fx_quant(spark, SF01))
    feats.write.format("noop").mode("overwrite").save()
    plan = _plan(feats)
    # lag, rolling frames, market statistics and lead share one exchange
    assert plan.count("Exchange hashpartitioning(") == 1, plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_scans_are_pruned(spark):
    df = E.queries()["certainty_scores"](spark, SF001)
    df.write.format("noop").mode("overwrite").save()
    plan = _plan(df)
    # the events scan reads only the six columns the trade view needs
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double,props:string>" in plan


def test_no_python_udfs_in_the_library():
    import os
    import re
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "marketlens")
    for d, _, files in os.walk(root):
        for f in files:
            if f.endswith(".py") and os.path.basename(d) != "llm":
                src = open(os.path.join(d, f)).read()
                assert not re.search(r"\b(pandas_udf|udf|mapInPandas|applyInPandas)\(", src), f


def test_certainty_plan_has_no_python(spark):
    plan = E.queries()["certainty_scores"](spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
    assert "PythonUDF" not in plan


def test_one_hot_market_is_split_and_exact(spark):
    # a third of all trades moved into one market
    t = fx.fx_trades(spark, SF01)
    hot = t.withColumn("market_id", F.when(F.col("block_number") % 3 == 0, F.lit("7")).otherwise(F.col("market_id")))
    n_hot = hot.where("market_id = '7'").count()
    assert n_hot * 3 >= t.count() - 3
    budget = 200
    chunked, split = skew.split_hot_keys(hot, "market_id", "timestamp", "block_number", "log_index", rows_per_task=budget)
    assert split
    per_task = chunked.groupBy("market_id", "_chunk").count().agg(F.max("count")).first()[0]
    assert per_task <= budget
    sizes = {r["_chunk"]: r["n"] for r in chunked.where("market_id = '7'").groupBy("_chunk").count()
             .withColumnRenamed("count", "n").collect()}
    assert len(sizes) > 8 and max(sizes.values()) < n_hot / 4
    markets = fx.fx_markets(spark, SF01)
    base = {r["market_id"]: r for r in C.certainty(hot, markets).collect()}
    got = {r["market_id"]: r for r in C.certainty(hot, markets, rows_per_task=budget).collect()}
    assert base.keys() == got.keys()
    for k in base:
        for c in ("volume", "last_price", "twap", "vwap"):
            a, b = base[k][c], got[k][c]
            assert (a is None and b is None) or abs(a - b) < 1e-9, (k, c, a, b)


def test_small_chunks_come_in_few_partitions(spark):
    # 6,000 rows of 20 keys, 3 rows a task: thousands of chunks, no more partitions than a shuffle has
    rows = [(f"m{i % 20}", None if i % 97 == 0 else i // 40, i) for i in range(6000)]
    df = spark.createDataFrame(rows, "market_id string, timestamp long, seq long")
    normal, chunked = skew.split(df, "market_id", ("timestamp", "seq"), skew.hot_keys(df, "market_id", 3))
    assert normal.isEmpty() and len(chunked.inputFiles()) <= max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    got = chunked.collect()
    assert sorted(r["seq"] for r in got) == list(range(6000))
    by = {}
    for r in got:
        by.setdefault((r["market_id"], r["_chunk"]), []).append((r["timestamp"] is not None, r["timestamp"] or 0, r["seq"]))
    assert max(map(len, by.values())) <= 3
    for m in {m for m, _ in by}:
        parts = [by[m, c] for k, c in sorted(by) if k == m]
        assert all(max(a) < min(b) for a, b in zip(parts, parts[1:], strict=False))
