"""Hand-built edge cases."""

import math
import os
import tempfile

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from marketlens.functions import duck_round, primary_category, safe_bigint, truncated_bigint
from marketlens.operators import bars as B
from marketlens.operators import dashboard as DB
from marketlens.operators import density as DN
from marketlens.operators import impact as IM
from marketlens.operators import labels as LB
from marketlens.operators import rollups as R
from marketlens.sources import load_labeled_csv, spread_indices


def _series(spark, n, market="m", z=None):
    rows = [Row(market_id=market, timestamp=i * 1_800_000, zscore=(z[i] if z else 0.0), arimax=None,
                yes_volume=1.0, no_volume=0.0, trade_count=1) for i in range(n)]
    return spark.createDataFrame(rows, "market_id string, timestamp long, zscore double, arimax double, "
                                       "yes_volume double, no_volume double, trade_count long")


@pytest.mark.parametrize("n,kept", [(1440, 1440), (1441, 721), (2881, 961)])
def test_downsample_sizes(spark, n, kept):
    out = DB.downsample(_series(spark, n)).collect()
    assert len(out) == kept
    step = 1 if n <= 1440 else math.ceil(n / 1440)
    assert sorted(r["timestamp"] // 1_800_000 for r in out) == list(range(0, n, step))


def test_anomaly_runs_including_open_end(spark):
    z = [0.0, 3.0, 3.0, 0.0, 0.0, 2.5, 0.0, 3.0, 3.0]
    s = DB.downsample(_series(spark, len(z), z=z))
    got = sorted((r["start"], r["end"]) for r in DB.anomaly_regions(s).collect())
    assert got == [(1, 3), (5, 6), (7, 8)]


def test_text_to_bigint(spark):
    df = spark.createDataFrame([(v,) for v in ["12", "12.0", "12.5", "-2.5", "1e3", "", "x7", " 7 ", None]], "v string")
    got = [(r["a"], r["b"]) for r in df.select(safe_bigint("v").alias("a"), truncated_bigint("v").alias("b")).collect()]
    assert got == [(12, 12), (12, 12), (13, 12), (-3, -2), (1000, 1000), (None, None), (None, None), (7, 7),
                   (None, None)]


def test_primary_category_json_cases(spark):
    cases = ['[{"slug":"all","label":"All"},{"slug":"crypto","label":"Crypto"}]',
             '[{"slug":"sports"},{"slug":"crypto","label":"Crypto"}]',
             '{"slug":"crypto","label":"Crypto"}', '[]', 'garbage', None,
             '[{"slug":"weather","label":"Weather"}]']
    df = spark.createDataFrame([(c,) for c in cases], "j string")
    got = [r[0] for r in df.select(primary_category("j")).collect()]
    assert got == ["Crypto", None, None, None, None, None, "Weather"]


def test_duck_round_scales_first(spark):
    df = spark.createDataFrame([(0.285,), (1.005,), (-2.5,), (2.675,)], "x double")
    got = [r[0] for r in df.select(duck_round("x", 2)).collect()]
    assert got == [0.28, 1.0, -2.5, 2.68]


def _features(spark, rows):
    """Trade features of ``rows`` (market, bin, yes_vol, no_vol, future_z), one trade each."""
    out = [(m, b * 1800 + i % 1800, i, 0.5, 0.1, y, n, y > 0, 1.0, 0.0, z) for i, (m, b, y, n, z) in enumerate(rows)]
    return spark.createDataFrame(out, "market_id string, timestamp long, seq long, price double, zscore double, yes_vol double, "
                                 "no_vol double, is_yes boolean, usd_amount double, ret double, future_z double")


def test_impact_singular_gives_defaults(spark):
    # every trade on the YES side -> no-volume column is all zero -> singular
    r = IM.fit_impact(B.bin_table(_features(spark, [("a", k, float(k + 1), 0.0, 0.5) for k in range(3)]))).first()
    assert (r["n"], r["yes_impact"], r["no_impact"]) == (3, 0.000015, 0.000015)
    r = IM.fit_impact(B.bin_table(_features(spark, []))).first()
    assert (r["n"], r["yes_impact"], r["no_impact"]) == (0, 0.000015, 0.000015)


@pytest.mark.parametrize("offset", [0.0, 1e9])
def test_impact_recovers_exact_plane(spark, offset):
    import random
    rnd = random.Random(1)
    rows = []
    for k in range(400):
        y, n = rnd.random() * 10, rnd.random() * 10
        rows.append((f"m{k % 3}", k % 11, offset + y, offset + n, 0.3 + 0.02 * y - 0.05 * n))
    rows.append(("m0", 3, 5.0, 5.0, None))  # no next z: not an observation
    r = IM.fit_impact(B.bin_table(_features(spark, rows))).first()
    assert r["n"] == 400
    assert abs(r["yes_impact"] - 0.02) < 1e-7 and abs(r["no_impact"] + 0.05) < 1e-7


def test_ridgeline_min_n_and_zero_range(spark):
    rows = [Row(market_id=i, uncertainty_twap=(i % 7) / 10.0, volume=5.0, predicted_label="Stochastic") for i in range(49)]
    rows += [Row(market_id=100 + i, uncertainty_twap=(i % 7) / 10.0, volume=50.0, predicted_label="Stochastic") for i in range(50)]
    rows += [Row(market_id=200 + i, uncertainty_twap=0.5, volume=500.0, predicted_label="Stochastic") for i in range(60)]
    rows += [Row(market_id=300, uncertainty_twap=0.5, volume=-1.0, predicted_label="Stochastic")]
    df = spark.createDataFrame(rows)
    cells = {(r["type"], r["band"]): (r["n"], r["has_density"]) for r in DN.ridgeline_cells(df).collect()}
    assert len(cells) == 21
    assert cells[("Stochastic", "< $10")] == (49, False)
    assert cells[("Stochastic", "$10 – $100")] == (50, True)
    assert cells[("Stochastic", "$100 – $1k")] == (60, False)
    dens = DN.ridgeline_density(df).collect()
    assert {(r["type"], r["band"]) for r in dens} == {("Stochastic", "$10 – $100")}
    # density integrates to about 1 on [0, 1] when the data sit inside it
    xs = sorted((r["k"], r["density"]) for r in dens)
    area = sum(d for _, d in xs) / 99.0
    assert 0.8 < area < 1.05


def test_cap_keeps_exact_count(spark):
    rows = [Row(market_id=i, uncertainty_twap=(i % 13) / 13.0, volume=50.0, predicted_label="Decision-Agent")
            for i in range(400)]
    s = DN.kde_sample(spark.createDataFrame(rows), cap=100)
    assert s.count() == 100


def test_search_wildcards_vs_literal(spark):
    df = spark.createDataFrame([("1", "50% chance", "x", 1.0, None), ("2", "50 chance", "x", 2.0, None)],
                               "id string, question string, event_title string, volume double, predicted_label string")
    assert {r["id"] for r in R.search(df, "50%").collect()} == {"1", "2"}
    assert {r["id"] for r in R.search_literal(df.withColumn("category", F.lit("c")), "50%").collect()} == {"1"}


def test_salted_top_n_equals_plain_window(spark):
    from pyspark.sql.window import Window
    rows = [Row(market_id="hot" if i % 3 else f"m{i % 5}", address=i % 997, role="maker", usd_amount=float((i * 37) % 101),
                token_amount=1.0, price=0.5) for i in range(5000)]
    u = spark.createDataFrame(rows)
    t = R.whale_totals(u)
    order = [F.col("total_usd_volume").desc(), F.col("address"), F.col("role")]
    got = {(r["market_id"], r["rank"], r["address"])
           for r in R.top_n_per_group(t, "market_id", order, 10, "address", rows_per_task=50).collect()}
    plain = {(r["market_id"], r["rank"], r["address"]) for r in R.whales(u, None, 10).collect()}
    w = Window.partitionBy("market_id").orderBy(F.col("total_usd_volume").desc(), "address", "role")
    want = {(r["market_id"], r["rank"], r["address"])
            for r in t.withColumn("rank", F.row_number().over(w)).where("rank <= 10").collect()}
    assert got == want and plain == want


def test_split_requires_divisible(spark):
    df = spark.createDataFrame([Row(id=i, label=("a", "b", "c", "d", "e", "f", "g")[i % 7]) for i in range(70)])
    with pytest.raises(ValueError):
        LB.stratified_split(df, test_size=180)


def test_report_counts_label_never_true(spark):
    df = spark.createDataFrame([Row(label="a", predicted_label="a"), Row(label="a", predicted_label="c"),
                                Row(label="b", predicted_label="b")])
    rep = {r["class"]: r for r in LB.classification_report(df).collect()}
    assert rep["c"]["support"] == 0 and rep["c"]["precision"] == 0.0 and rep["c"]["f1_score"] == 0.0
    assert rep["accuracy"]["f1_score"] == round(2 / 3, 4)
    cm = LB.confusion(df).collect()
    assert len(cm) == 9 and sum(r["n"] for r in cm) == 3


def test_csv_encoding_fallback(spark):
    d = tempfile.mkdtemp(prefix="ml-csv-")
    p = os.path.join(d, "gt.csv")
    with open(p, "wb") as f:
        f.write("id,question,label\n1,Café – ok?,Stochastic\n".encode("cp1252"))
    df = load_labeled_csv(spark, p)
    r = df.first()
    assert r["question"] == "Café – ok?" and r["label"] == "Stochastic"
    p2 = os.path.join(d, "bom.csv")
    with open(p2, "wb") as f:
        f.write("id,question,label\n2,plain,Decision-Agent\n".encode("utf-8-sig"))
    assert load_labeled_csv(spark, p2).columns == ["id", "question", "label"]


def test_spread_indices():
    assert spread_indices(10, 20) == list(range(10))
    assert spread_indices(10, 1) == [5]
    assert spread_indices(11, 3) == [0, 5, 10]
    assert spread_indices(100, 4) == [0, 33, 66, 99]


def test_primary_category_reads_tags_one_by_one(spark):
    from marketlens.functions import constants as K
    from marketlens.functions import primary_category

    slug = K.ALLOWED_SLUGS[0]
    rows = [('[{"slug": "%s", "label": "L"}, 7]' % slug, "L"), ('\n [{"slug": "x"}, {"slug": "%s", "label": "M"}]' % slug, "M"),
            ('{"slug": "%s"}' % slug, None), ("[7, null]", None), (None, None)]
    df = spark.createDataFrame(rows, "t string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", primary_category("t").alias("got")).collect())


def test_split_of_repeated_ids_and_bare_labels(spark):
    from marketlens.operators import labels as LB

    rows = [(i // 2, f"t{i}", "abc"[i % 600 // 2 % 3]) for i in range(1200)]
    df = spark.createDataFrame(rows, "id long, question string, label string")
    out = LB.stratified_split(df)
    assert out.count() == 1200
    test = {r["label"]: r["count"] for r in out.where("split = 'test'").groupBy("label").count().collect()}
    assert test == {"a": 60, "b": 60, "c": 60}
    with pytest.raises(ValueError):
        LB.stratified_split(df.union(spark.createDataFrame([(9999, "x", None)], df.schema)))
