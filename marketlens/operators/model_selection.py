"""Training with a held-out metric per step, the best step kept (M3, M6).

``naive_bayes_steps`` trains a multinomial naive Bayes model whose parameters
are word counts, so every step (a smoothing strength) follows from one
aggregate in closed form. Words are hashed into ``BUCKETS`` buckets, which
fixes the size of the model. Log probabilities are integers (in units of 2^-16),
so that scores, ties and the choice of the best step do not depend on the
order of a floating-point sum.

``fit_best_text_classifier`` takes the iterative classifier epoch by epoch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions import duck_round
from marketlens.operators import labels as LB
from marketlens.session import write_table

#: Buckets of words (four hex digits of md5), smoothing per step, unit of log probabilities.
BUCKETS = 1 << 16
SMOOTHING = (10.0, 1.0, 0.1)
UNIT = 65536
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def buckets(text: Column) -> Column:
    """The buckets of a text's words, one per occurrence; NULL text has none."""
    words = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))
    return F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int"))


def _log(share: Column) -> Column:
    return F.floor(F.ln(share) * F.lit(float(UNIT)) + F.lit(0.5)).cast("long")


@dataclass
class NaiveBayes:
    """``weights``: (bucket, w) with w[step][label] for the buckets that occur in training; ``unseen`` and ``priors`` as literals."""

    labels: list[str]
    steps: tuple[float, ...]
    weights: DataFrame
    unseen: Column
    priors: Column

    def scores(self, df: DataFrame, text: str, keep: list[str]) -> DataFrame:
        """``keep`` of ``df`` and ``scores``[step][label] per row."""
        d = df.select(F.monotonically_increasing_id().alias("_row"), *keep, F.col(text).alias("_text"))
        d = d.select("_row", *keep, F.explode_outer(buckets(F.col("_text"))).alias("bucket"))
        # at most BUCKETS rows of steps x labels numbers: a broadcast of a fixed size
        d = d.join(F.broadcast(self.weights), "bucket", "left")
        n_steps, n_labels = len(self.steps), len(self.labels)
        w = F.when(F.col("bucket").isNotNull(), F.coalesce("w", self.unseen))
        sums = [F.coalesce(F.sum(w[s][k]), F.lit(0)).alias(f"_s{s}_{k}") for s in range(n_steps) for k in range(n_labels)]
        out = d.groupBy("_row").agg(*[F.any_value(c).alias(c) for c in keep], *sums)
        total = F.array(*[F.array(*[F.col(f"_s{s}_{k}") + self.priors[k] for k in range(n_labels)]) for s in range(n_steps)])
        return out.select(*keep, total.alias("scores"))

    def predicted(self, scores: Column) -> Column:
        """The label with the highest score; ties go to the first label in order."""
        names = F.array(*[F.lit(x) for x in self.labels])
        return F.element_at(names, F.array_position(scores, F.array_max(scores)).cast("int"))

    def confidence(self, scores: Column) -> Column:
        """The probability of that label."""
        top = F.array_max(scores)
        rest = F.aggregate(scores, F.lit(0.0), lambda a, s: a + F.exp((s - top) / F.lit(float(UNIT))))
        return F.lit(1.0) / rest


def naive_bayes_steps(train: DataFrame, text: str = "question", label: str = "label", steps: tuple[float, ...] = SMOOTHING) -> NaiveBayes:
    """The model of every step from one pass over the training texts; rows without a label are left out."""
    train = train.where(F.col(label).isNotNull())
    names = LB.classes(train, label)
    docs = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    per = {r[label]: r["n"] for r in docs.collect()}  # one row per label
    words = train.select(label, F.explode(buckets(F.col(text))).alias("bucket"))
    counts = words.groupBy("bucket").agg(*[F.count_if(F.col(label) == c).alias(f"c{k}") for k, c in enumerate(names)])
    counts = write_table(counts, "bucket-counts")  # at most BUCKETS rows
    total = counts.agg(*[F.coalesce(F.sum(f"c{k}"), F.lit(0)).alias(f"t{k}") for k in range(len(names))]).first()

    def weights(count) -> Column:
        return F.array(*[F.array(*[_log((count(k) + F.lit(a)) / F.lit(total[k] + a * BUCKETS)) for k in range(len(names))]) for a in steps])

    priors = F.array(*[_log(F.lit(float(per[c])) / F.lit(float(sum(per.values())))) for c in names])
    return NaiveBayes(names, tuple(steps), counts.select("bucket", weights(lambda k: F.col(f"c{k}")).alias("w")),
                      weights(lambda k: F.lit(0.0)), priors)


def step_metrics(model: NaiveBayes, held_out: DataFrame, text: str = "question", label: str = "label") -> DataFrame:
    """M6: one row per step: step (from 1), smoothing, rows, hits, accuracy, and whether it is the best (the first of equals)."""
    scored = model.scores(held_out, text, [label])
    hits = [F.count_if(model.predicted(F.col("scores")[s]) == F.col(label)).alias(f"h{s}") for s in range(len(model.steps))]
    one = scored.agg(F.count(F.lit(1)).alias("n"), *hits)
    rows = F.array(*[F.struct(F.lit(s + 1).alias("step"), F.lit(a).alias("smoothing"), F.col("n"), F.col(f"h{s}").alias("hits"))
                     for s, a in enumerate(model.steps)])
    best = F.greatest(*[F.col(f"h{s}") for s in range(len(model.steps))]) if len(model.steps) > 1 else F.col("h0")
    first = F.array_position(F.array(*[F.col(f"h{s}") for s in range(len(model.steps))]), best)
    m = one.select(F.explode(rows).alias("r"), first.alias("first")).select("r.*", (F.col("r.step") == F.col("first")).alias("best"))
    accuracy = F.when(F.col("n") > 0, F.col("hits") / F.col("n"))
    return m.select("step", "smoothing", "n", "hits", duck_round(accuracy, 9).alias("accuracy"), "best")


def best_step(metrics: DataFrame) -> int:
    """The position (from 0) of the best step of a metric table."""
    return metrics.where("best").first()["step"] - 1


def label_rows(model: NaiveBayes, df: DataFrame, step: int, text: str = "question", keep: list[str] | None = None) -> DataFrame:
    """M4: predicted_label and confidence (6 dp) of every row by one step's model."""
    keep = keep or [c for c in df.columns if c != text]
    s = model.scores(df, text, keep).withColumn("scores", F.col("scores")[step])
    return s.select(*keep, model.predicted(F.col("scores")).alias("predicted_label"),
                    duck_round(model.confidence(F.col("scores")), 6).alias("confidence"))


def fit_best_text_classifier(train: DataFrame, held_out: DataFrame, epochs: int = 3, iterations: int = 10, text: str = "question",
                             label: str = "label"):
    """M3 / M6 for the iterative classifier: (best model, metric rows as (epoch, n, accuracy, best)).

    Its optimiser is deterministic, so that a fit stopped after ``epoch * iterations``
    steps is the state of one run after that epoch. Each text is read, cut into words and
    counted once; the weights of the words are fitted on the written counts. The
    model of the highest held-out accuracy stays, the first of equals.
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression

    index, tokens, counts, idf = LB.text_features(text, label).getStages()
    words = PipelineModel([tokens, counts])
    counted = write_table(words.transform(LB.with_text(train, text)).select(label, "_tf"), "train-counts")
    held = write_table(words.transform(LB.with_text(held_out, text)).select(label, "_tf"), "held-out-counts")
    index = index.fit(counted)
    idf = idf.fit(index.transform(counted))
    weigh = PipelineModel([index, idf])
    columns = ["_label_idx", "_features"]
    ready, test = weigh.transform(counted).select(*columns), weigh.transform(held).select(*columns)
    n, rows, best = held.count(), [], None
    for epoch in range(1, epochs + 1):
        step = LogisticRegression(featuresCol="_features", labelCol="_label_idx", maxIter=epoch * iterations, family="multinomial",
                                  probabilityCol="_prob", predictionCol="_pred_idx", rawPredictionCol="_raw").fit(ready)
        hits = step.transform(test).where("_pred_idx = _label_idx").count()  # labels not met in training never count as hits
        rows.append([epoch, n, hits / n if n else None, False])
        if best is None or hits > best[0]:
            best = (hits, step, epoch)
    for r in rows:
        r[3] = r[0] == best[2]
    return PipelineModel([index, tokens, counts, idf, best[1]]), [tuple(r) for r in rows]
