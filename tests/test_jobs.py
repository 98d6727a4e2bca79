import os
import tempfile

from marketlens.plans import jobs
from marketlens.sources import fixtures as fx

from conftest import SF001, SF01


def test_timeseries_job_writes_sorted_outputs(spark):
    out = tempfile.mkdtemp(prefix="ml-job-")
    res = jobs.timeseries_job(spark, fx.fx_quant(spark, SF01), fx.fx_markets(spark, SF01), out)
    assert res["markets"] == 28 and res["rows"] == 39267
    one = jobs.market_series(spark, os.path.join(out, "dashboard_timeseries"), "10")
    rows = one.collect()
    assert len(rows) > 0 and [r["timestamp"] for r in rows] == sorted(r["timestamp"] for r in rows)
    assert "EqualTo(market_id,10)" in jobs.pushed_filters(one)


def test_certainty_job_audit(spark):
    d = tempfile.mkdtemp(prefix="ml-job-")
    fx.fx_trades(spark, SF01).write.parquet(os.path.join(d, "trades"))
    fx.fx_markets(spark, SF01).write.parquet(os.path.join(d, "markets"))
    res = jobs.certainty_job(spark, os.path.join(d, "trades"), os.path.join(d, "markets"), os.path.join(d, "out"))
    assert res == {"rows": 150, "null_labels": res["null_labels"]} and res["null_labels"] >= 0


def test_summary_report_files(spark):
    from marketlens.operators import labels as LB
    rows = [("B", 0.75)] * 1500 + [("A", 0.25)] * 500 + [("A", None)]
    df = spark.createDataFrame(rows, "predicted_label string, confidence double")
    d = tempfile.mkdtemp(prefix="ml-sum-")
    known = ["B", "C", "A"]
    LB.write_summary(LB.classification_summary(df, known), LB.classification_overall(df), d, elapsed_s=12.345)
    with open(os.path.join(d, "summary.json"), "rb") as f:
        assert f.read() == b"""{
  "total_markets_classified": 2001,
  "elapsed_seconds": 12.35,
  "label_distribution": {
    "A": {
      "count": 501,
      "percent": 25.04
    },
    "B": {
      "count": 1500,
      "percent": 74.96
    },
    "C": {
      "count": 0,
      "percent": 0.0
    }
  },
  "mean_confidence": 0.625,
  "mean_confidence_by_label": {
    "A": 0.25,
    "B": 0.75
  },
  "low_confidence_count_below_0.5": 500
}""".replace(b"12.35", str(round(12.345, 2)).encode())
    with open(os.path.join(d, "summary.txt"), "rb") as f:
        assert f.read() == b"""Markets classification summary
========================================
Markets classified: 2,001
Elapsed: 12.3s
Mean confidence: 0.6250
Low confidence (<0.5): 500

Predicted label distribution:
  A: 501 (25.04%)
  B: 1,500 (74.96%)
  C: 0 (0.0%)

Mean confidence by label:
  A: 0.2500
  B: 0.7500
"""


def _rows_scanned(df):
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            node = node.executedPlan()
        if node.nodeName().startswith("Scan") or "FileSourceScan" in node.getClass().getName():
            found.append(node.metrics().apply("numOutputRows").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))
        if "QueryStage" in node.nodeName():
            walk(node.plan())

    walk(plan)
    return sum(found)


def test_point_read_skips_row_groups_by_bloom_filter(spark):
    from pyspark.sql import functions as F

    from marketlens.sources import save

    d = tempfile.mkdtemp(prefix="ml-bloom-")
    # every file holds ids over the whole range, so their smallest and largest values skip nothing
    t = spark.range(0, 40_000, 1, 8).select(F.col("id").alias("v"), F.format_string("m%05d", F.pmod(F.col("id") * 7919, F.lit(40_000))).alias("market_id"))
    save(t, f"{d}/plain")
    save(t, f"{d}/bloom", bloom={"market_id": 5_000})
    read = {k: spark.read.parquet(f"{d}/{k}").where("market_id = 'm12345'") for k in ("plain", "bloom")}
    assert [r["v"] for r in read["bloom"].collect()] == [r["v"] for r in read["plain"].collect()] != []
    assert _rows_scanned(read["plain"]) == 40_000
    assert 5_000 <= _rows_scanned(read["bloom"]) <= 15_000


def test_enrichment_rewrites_only_touched_ranges(spark):
    import glob

    from marketlens.plans.jobs import enrichment_job
    from marketlens.sources import cached, upsert_latest

    d = tempfile.mkdtemp(prefix="ml-enrich-")
    cache, out = os.path.join(d, "cache"), os.path.join(d, "out")
    markets = fx.fx_markets(spark, SF001)
    first, batch = fx.fx_tag_cache(spark, SF001), fx.fx_tag_batch(spark, SF001).where("event_id < 10")

    def files():
        return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{cache}/*/*.parquet")}

    assert enrichment_job(spark, markets, first, cache, out, width=5)["ranges_rewritten"] == 5
    before = files()
    res = enrichment_job(spark, markets, batch, cache, out, width=5)
    assert res["ranges_rewritten"] == 2
    kept = {f: t for f, t in files().items() if f in before}
    assert kept and all(before[f] == t for f, t in kept.items())
    assert {f.split("key_range=")[1].split("/")[0] for f in kept} == {"2", "3", "4"}
    want = sorted(tuple(r) for r in upsert_latest(first, batch, "event_id", "fetched_at").collect())
    again = enrichment_job(spark, markets, batch, cache, out, width=5)
    assert again == res and sorted(tuple(r) for r in cached(spark, cache).select(*first.columns).collect()) == want
    assert spark.read.parquet(out).count() == markets.count()
