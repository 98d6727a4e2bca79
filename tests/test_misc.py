import os
import tempfile

import pytest
from pyspark.sql import functions as F

from marketlens.operators import certainty as C
from marketlens.operators import labels as LB
from marketlens.plans import timeseries as TS
from marketlens.sources import fixtures as fx
from marketlens.sources import lookup, register_sources

from conftest import SF001, SF01


def test_register_sources_and_lookup(spark):
    views = register_sources(spark, {"ml_nation": f"{SF001}/nation.parquet"})
    assert spark.sql("SELECT count(*) FROM ml_nation").first()[0] == views["ml_nation"].count() == 25
    lk = lookup(spark, {"a": 1.0, "b": 2.0}, "k", "v")
    assert sorted(r["v"] for r in lk.collect()) == [1.0, 2.0]


def test_require_rows_and_point_lookup(spark):
    scores = C.certainty(fx.fx_trades(spark, SF001), fx.fx_markets(spark, SF001))
    some = scores.select("market_id").first()[0]
    one = TS.require_rows(C.certainty_of(scores, str(some)), "none")
    assert one.first()["data_points"] == 1
    assert C.certainty_of(scores, "12.0").count() <= 1
    with pytest.raises(ValueError):
        TS.require_rows(C.certainty_of(scores, "not-an-id"), "No uncertainty data")


def test_evaluate_holdout_from_csv(spark):
    df = LB.stratified_split(fx.fx_labeled(spark, SF01))
    model = LB.fit_text_classifier(df.where("split = 'train'"), max_iter=10)
    known = LB.classes(df.where("split = 'train'"), "label")
    d = tempfile.mkdtemp(prefix="ml-holdout-")
    p = os.path.join(d, "holdout.csv")
    rows = df.where("split = 'test'").select("id", "question", "label").toPandas()
    rows.to_csv(p, index=False, encoding="cp1252", errors="replace")
    from marketlens.sources import load_labeled_csv
    hold = load_labeled_csv(spark, p)
    res = LB.evaluate_holdout(hold, model, known)
    acc = res["accuracy"].first()
    assert acc["n"] == 180 and 0.0 <= acc["accuracy"] <= 1.0
    assert sum(r["n"] for r in res["confusion"].collect()) == 180
    bad = hold.withColumn("label", F.lit("unknown-label"))
    with pytest.raises(ValueError):
        LB.evaluate_holdout(bad, model, known)


def test_approx_role_distribution_close_to_exact(spark):
    from marketlens.operators import rollups as R
    u = fx.fx_users(spark, SF01)
    exact = {(r["market_id"], r["role"]): r["unique_users"] for r in R.role_distribution(u).collect()}
    approx = {(r["market_id"], r["role"]): r["approx_unique_users"]
              for r in R.role_distribution(u, approx_rsd=0.02).collect()}
    assert exact.keys() == approx.keys()
    for k, v in exact.items():
        assert abs(approx[k] - v) <= max(2, 0.1 * v)


def test_text_scoring_scores_every_market(spark):
    from marketlens.plans.registry import QUERIES
    rows = QUERIES["text_scoring"](spark, SF01).collect()
    assert sorted(r["id"] for r in rows) == sorted(r["id"] for r in fx.fx_markets(spark, SF01).select("id").collect())
    known = set(LB.classes(fx.fx_labeled(spark, SF01), "label"))
    assert all(r["predicted_label"] in known and 0 < r["confidence"] <= 1 for r in rows)


def test_each_text_is_read_once_to_train(spark):
    from marketlens.operators import model_selection as MS
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    words = {"a": "red green blue", "b": "one two three"}
    rows = [(i, f"{words['ab'[i % 2]]} {i}", "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, question string, label string").withColumn("question", seen("question"))
    model, metrics = MS.fit_best_text_classifier(df.where("id < 40"), df.where("id >= 40"), epochs=2, iterations=3)
    assert read.value == 60
    assert [(m[0], m[1], m[3]) for m in metrics] == [(1, 20, True), (2, 20, False)] and metrics[0][2] == 1.0
    assert model.stages[0].labels == ["a", "b"]
