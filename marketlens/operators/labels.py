"""Labelled-text data preparation, evaluation and scoring (M1-M6, D9,
D16-D19, P11, P12).

Class vocabularies (a handful of labels) are the only thing read back to the
driver; every per-row step is a Spark job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketlens.functions import constants as K
from marketlens.functions import duck_round
from marketlens.operators.rollups import top_n_per_group
from marketlens.session import write_table


def require_columns(df: DataFrame, cols) -> None:
    """Fail early with the missing and present column names."""
    missing = set(cols) - set(df.columns)
    if missing:
        raise ValueError(f"missing columns {sorted(missing)}; have {df.columns}")


def classes(df: DataFrame, *cols: str) -> list[str]:
    """Sorted distinct non-NULL values of the given label columns."""
    vals = None
    for c in cols:
        v = df.select(F.col(c).alias("label")).where(F.col("label").isNotNull())
        vals = v if vals is None else vals.union(v)
    return sorted(r[0] for r in vals.distinct().collect())


def label_ids(df: DataFrame, label: str = "label") -> DataFrame:
    """M2: label <-> id in sorted label order. The vocabulary (a handful of
    labels) is read back and returned as a small literal table."""
    cls = classes(df, label)
    return df.sparkSession.createDataFrame(list(zip(cls, range(len(cls)))), "label string, label_id long")


def stratified_split(df: DataFrame, test_size: int = K.TEST_SIZE, seed: int = K.RANDOM_SEED,
                     label: str = "label", key: str = "id") -> DataFrame:
    """M1: equal count per class in the test split (test_size / classes,
    which must divide), the rest train. The per-class order is md5(key:seed)
    (a seeded shuffle that any engine reproduces); of rows equal in class and
    key any may be the ones on the edge. A row without a label is an error:
    it belongs to no class.

    The rank decides in one pass: the last (hash, key) of each class's first
    rows is the edge; rows before it are test, and of those on it as many as
    are still needed."""
    ids = df.select(label, key)
    found = ids.agg(F.countDistinct(label).alias("classes"), F.count_if(F.col(label).isNull()).alias("bare")).first()
    if found["bare"]:
        raise ValueError(f"{found['bare']} rows have no {label}")
    n_classes = found["classes"]
    if n_classes == 0 or test_size % n_classes != 0:
        raise ValueError(f"test_size {test_size} must be divisible by {n_classes} classes")
    per = test_size // n_classes
    ranked = df.withColumn("_h", F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}"))))
    first = top_n_per_group(ranked.select(label, key, "_h"), label, [F.col("_h"), F.col(key)], per, salt_col=key)
    edge = first.groupBy(label).agg(F.max("_h").alias("_edge"), F.count_if(F.col("_h").isNotNull()).alias("_taken"))
    on_edge = first.join(edge, label).where("_h = _edge").groupBy(label).agg(F.count(F.lit(1)).alias("_needed"))
    # one row per class of the vocabulary
    out = ranked.join(F.broadcast(edge.join(on_edge, label).select(label, "_edge", "_needed")), label)
    same = Window.partitionBy(label, "_h").orderBy(key)  # rows of one key, never of a whole class
    n = F.row_number().over(same)
    test = (F.col("_h") < F.col("_edge")) | ((F.col("_h") == F.col("_edge")) & (n <= F.col("_needed")))
    return out.withColumn("split", F.when(test, F.lit("test")).otherwise(F.lit("train"))).select(*df.columns, "split")


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """D19."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(label)


def accuracy(df: DataFrame, label: str = "label", pred: str = "predicted_label") -> DataFrame:
    """Share of rows whose prediction equals the label."""
    hit = F.when(F.col(pred) == F.col(label), 1.0).otherwise(0.0)
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"))


def confusion(df: DataFrame, cls: list[str] | None = None, label: str = "label",
              pred: str = "predicted_label") -> DataFrame:
    """Counts per (true, predicted) over all class pairs, zeros kept.
    The class grid is classes x classes (a few labels), built from literals."""
    cls = cls if cls is not None else classes(df, label, pred)
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b) for a in cls for b in cls], "true_label string, pred_label string")
    counts = df.groupBy(F.col(label).alias("true_label"), F.col(pred).alias("pred_label")) \
        .agg(F.count(F.lit(1)).alias("n"))
    return (F.broadcast(grid).join(counts, ["true_label", "pred_label"], "left")
            .select("true_label", "pred_label", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))


def _safe_div(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def classification_report(df: DataFrame, cls: list[str] | None = None, label: str = "label",
                          pred: str = "predicted_label", digits: int = 4) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy,
    macro and weighted averages; 0 where undefined; rounded to ``digits``.
    The confusion table (classes x classes rows) is written once, so the
    labelled rows are aggregated a single time for all the report's parts."""
    cm = write_table(confusion(df, cls, label, pred), "confusion")
    tp = cm.where(F.col("true_label") == F.col("pred_label")).select(F.col("true_label").alias("cls"), F.col("n").alias("tp"))
    sup = cm.groupBy(F.col("true_label").alias("cls")).agg(F.sum("n").alias("support"))
    prd = cm.groupBy(F.col("pred_label").alias("cls")).agg(F.sum("n").alias("predicted"))
    per = tp.join(sup, "cls").join(prd, "cls")
    p = _safe_div(F.col("tp").cast("double"), F.col("predicted"))
    r = _safe_div(F.col("tp").cast("double"), F.col("support"))
    per = per.select("cls", "tp", "support", p.alias("precision"), r.alias("recall"))
    per = per.withColumn("f1_score", _safe_div(2 * F.col("precision") * F.col("recall"),
                                               F.col("precision") + F.col("recall")))
    tot = per.agg(F.sum("support").alias("total"), F.sum("tp").alias("hits"),
                  F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1_score").alias("mf"),
                  F.sum(F.col("precision") * F.col("support")).alias("wp"),
                  F.sum(F.col("recall") * F.col("support")).alias("wr"),
                  F.sum(F.col("f1_score") * F.col("support")).alias("wf"))
    t = F.col("total")
    acc = tot.select(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"), _safe_div(F.col("hits").cast("double"), t).alias("f1_score"),
                     t.alias("support"))
    macro = tot.select(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                       F.col("mf").alias("f1_score"), t.alias("support"))
    weighted = tot.select(F.lit("weighted avg").alias("class"), _safe_div(F.col("wp"), t).alias("precision"),
                          _safe_div(F.col("wr"), t).alias("recall"), _safe_div(F.col("wf"), t).alias("f1_score"),
                          t.alias("support"))
    rows = per.select(F.col("cls").alias("class"), "precision", "recall", "f1_score", "support")
    out = rows.unionByName(acc).unionByName(macro).unionByName(weighted)
    return out.select("class", *[duck_round(c, digits).alias(c) for c in ("precision", "recall", "f1_score")],
                      F.col("support").cast("long").alias("support"))


def classification_summary(df: DataFrame, known: list[str], label: str = "predicted_label",
                           conf: str = "confidence") -> DataFrame:
    """D9 per label: count and percent (2 dp) for every known label (0 when
    absent) and mean confidence (4 dp) for labels that occur."""
    spark = df.sparkSession
    total = df.count()
    per = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("count"),
                                                      F.avg(conf).alias("_mc"))
    grid = F.broadcast(spark.createDataFrame([(k,) for k in known], "label string"))
    j = grid.join(per, "label", "left")
    cnt = F.coalesce(F.col("count"), F.lit(0)).cast("long")
    pct = duck_round(cnt * F.lit(100.0) / F.lit(float(total)), 2) if total else F.lit(0.0)
    return j.select("label", cnt.alias("count"), pct.alias("percent"), duck_round("_mc", 4).alias("mean_confidence"))


def classification_overall(df: DataFrame, conf: str = "confidence") -> DataFrame:
    """D9 totals: rows classified, mean confidence (4 dp), confidence < 0.5."""
    return df.agg(F.count(F.lit(1)).alias("total_markets_classified"),
                  duck_round(F.avg(conf), 4).alias("mean_confidence"),
                  F.count_if(F.col(conf) < F.lit(K.LOW_CONFIDENCE)).alias("low_confidence_count"))


def summary_document(summary: DataFrame, overall: DataFrame, elapsed_s: float) -> dict:
    """The whole report as one document; its size is that of the label set."""
    rows, total = sorted(summary.collect(), key=lambda r: r["label"]), overall.first()
    mean = total["mean_confidence"]
    return {
        "total_markets_classified": total["total_markets_classified"],
        "elapsed_seconds": round(elapsed_s, 2),
        "label_distribution": {r["label"]: {"count": r["count"], "percent": r["percent"]} for r in rows},
        "mean_confidence": float("nan") if mean is None else mean,
        "mean_confidence_by_label": {
            r["label"]: float("nan") if r["mean_confidence"] is None else r["mean_confidence"] for r in rows if r["count"]},
        "low_confidence_count_below_0.5": total["low_confidence_count"],
    }


def summary_text(doc: dict) -> str:
    """The document as a text report."""
    # fixed values: the report's wording and number formats
    out = "Markets classification summary\n" + "=" * 40 + "\n"
    out += "Markets classified: {:,}\n".format(doc["total_markets_classified"])
    out += "Elapsed: {:.1f}s\n".format(doc["elapsed_seconds"])
    out += "Mean confidence: {:.4f}\n".format(doc["mean_confidence"])
    out += "Low confidence (<0.5): {:,}\n".format(doc["low_confidence_count_below_0.5"])
    out += "\nPredicted label distribution:\n"
    out += "".join("  {}: {:,} ({}%)\n".format(k, v["count"], v["percent"]) for k, v in doc["label_distribution"].items())
    out += "\nMean confidence by label:\n"
    return out + "".join("  {}: {:.4f}\n".format(k, v) for k, v in doc["mean_confidence_by_label"].items())


def write_summary(summary: DataFrame, overall: DataFrame, path: str, elapsed_s: float = 0.0) -> dict:
    """``path``/summary.json and ``path``/summary.txt, on whatever file system ``path`` names."""
    import json

    from marketlens.session import write_file

    doc = summary_document(summary, overall, elapsed_s)
    write_file(summary.sparkSession, f"{path}/summary.json", json.dumps(doc, indent=2))
    write_file(summary.sparkSession, f"{path}/summary.txt", summary_text(doc))
    return doc


def unknown_labels(holdout: DataFrame, known: DataFrame, label: str = "label") -> DataFrame:
    """Distinct holdout labels missing from the known label set."""
    h = holdout.select(F.col(label).alias("label")).where(F.col("label").isNotNull()).distinct()
    k = known.select(F.col(label).alias("label")).distinct()
    return h.join(k, "label", "left_anti")


# ------------------------------------------------------------------ scoring

def with_text(df: DataFrame, text: str = "question") -> DataFrame:
    """NULL text read as empty, in the column the classifier looks at."""
    return df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))


def text_features(text: str = "question", label: str = "label", num_features: int = 1 << 16):
    """The stages before the classifier: label index, tokens, hashed term counts, IDF."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer, StringIndexer

    return Pipeline(stages=[
        StringIndexer(inputCol=label, outputCol="_label_idx", stringOrderType="alphabetAsc", handleInvalid="skip"),
        RegexTokenizer(inputCol="_text", outputCol="_tokens", pattern=r"(?U)\W+", minTokenLength=1),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="_features"),
    ])


def fit_text_classifier(train: DataFrame, text: str = "question", label: str = "label",
                        num_features: int = 1 << 16, max_iter: int = 30):
    """M3 (re-aimed): a Spark ML pipeline over the whole text: tokenize,
    hashed term counts, IDF, multinomial logistic regression.
    ``model_selection.fit_best_text_classifier`` keeps the best epoch."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression

    last = LogisticRegression(featuresCol="_features", labelCol="_label_idx", maxIter=max_iter, family="multinomial",
                              probabilityCol="_prob", predictionCol="_pred_idx", rawPredictionCol="_raw")
    stages = [*text_features(text, label, num_features).getStages(), last]
    return Pipeline(stages=stages).fit(with_text(train, text))


def score_text(df: DataFrame, model, text: str = "question") -> DataFrame:
    """M4: label with the highest probability and that probability as the
    confidence (NULL text scored as empty text). Without a label column the
    label indexer, which would look for it, is left out."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array

    labels = model.stages[0].labels
    if model.stages[0].getInputCol() not in df.columns:
        model = PipelineModel(model.stages[1:])
    scored = model.transform(df.withColumn("_text", F.coalesce(F.col(text), F.lit(""))))
    probs = vector_to_array("_prob")
    names = F.array(*[F.lit(x) for x in labels])
    out = scored.withColumn("predicted_label", F.element_at(names, F.col("_pred_idx").cast("int") + 1)) \
        .withColumn("confidence", F.array_max(probs))
    return out.drop("_text", "_tokens", "_tf", "_features", "_raw", "_prob", "_pred_idx")


def evaluate_holdout(holdout: DataFrame, model, known: list[str], text: str = "question",
                     label: str = "label") -> dict[str, DataFrame]:
    """M5: check the columns (P11) and that every holdout label is known
    (P12), score the texts (M4), then accuracy, confusion matrix and report
    over the known classes (D16-D18)."""
    require_columns(holdout, [text, label])
    known_df = holdout.sparkSession.createDataFrame([(k,) for k in known], "label string")
    # the error message lists at most 50 of the unknown labels
    unknown = [r[0] for r in unknown_labels(holdout.select(F.col(label).alias("label")), known_df)
               .orderBy("label").limit(50).collect()]
    if unknown:
        raise ValueError(f"no training rows for these labels of the holdout: {sorted(unknown)}; known are {sorted(known)}")
    scored = score_text(holdout, model, text).select(F.col(label).alias("label"), "predicted_label", "confidence")
    return {
        "scored": scored,
        "accuracy": accuracy(scored),
        "confusion": confusion(scored, sorted(known)),
        "report": classification_report(scored, sorted(known)),
    }
