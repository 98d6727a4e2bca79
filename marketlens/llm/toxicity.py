"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities of a learned lexicon (whole words and word
beginnings that labelled toxic texts hold and clean ones do not) and of a
small stated lexicon, lexicon words near second-person words, capitals,
punctuation, obfuscated words (letters broken by digits or signs), length.
Trees and calibration are pyspark.ml's and run on Spark.

Fitting uses a bounded sample of the labelled rows (``SAMPLE`` rows expected,
chosen by a hash of the id; all rows if there are fewer). The lexicon feature
of a fitting row comes from a lexicon learned without the row's own fold, so
the trees see it as an unseen text would have it; the calibration is learned
on scores of a fold that the trees have not seen. Scoring is one pass over the
documents, without a shuffle.

Defined cases: null text is read as empty and scored like any other; a null
id or label, or an id labelled both ways, is not learned from; without labels
of both kinds every score is the share of toxic labels (0 without labels);
repeated rows are each scored; columns of any name are carried through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.session import write_table

#: Labelled rows to fit on (expected number), folds, terms in the learned lexicon.
SAMPLE = 20_000
FOLDS = 5
TERMS = 3_000
#: A term must occur in this many toxic texts, and be this many times likelier in them.
LEAST_TEXTS = 3
LEAST_RATIO = 6.0
#: Lengths of word beginnings that can be terms.
BEGINNINGS = (3, 4, 5, 6)
#: Characters around a second-person word that count as near.
NEAR = 40
THRESHOLD = 0.7

# Stated lexicon of insults, second-person words, signs read as letters.
INSULTS = (
    "arsehole asshole bastard bitch braindead clown crap cretin damn degenerate disgusting dumb dumbass filth filthy fool freak fuck "
    "garbage idiot idiotic imbecile jerk loser lunatic moron moronic pathetic pig retard scum shit shut stupid sucker trash ugly "
    "vermin worthless abschaum arschloch dumm hurensohn idiota imbecil imbécile connard crétin salaud stupide basura cerdo estúpido "
    "mierda tonto trottel versager"
).split()
SECOND_PERSON = (
    "you your yours yourself u ur ya du dich dir dein deine deinen ihr euch euer sie tu te toi ton ta tes vous votre vos tú ti usted "
    "ustedes vosotros vuestro"
).split()
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": ""})

FEATURES = ("length", "term_density", "term_count", "term_kinds", "term_weight", "term_best", "near_you", "you_density",
            "insult_density", "hidden_insults", "obfuscated", "capitals", "shouted", "exclaimed", "questioned", "punctuation", "digits")

_BROKEN = re.compile(r"(?<![\w@$*])[^\W\d_]+(?:[0-9@$*!._-]+[^\W\d_]+)+(?!\w)")
_SHOUT = re.compile(r"\b[A-Z]{3,}\b")
# ASCII signs and white space separate words
_TO_SPACE = {c: " " for c in range(128) if not chr(c).isalnum()}
_TO_SPACE_BYTES = bytes(32 if c in _TO_SPACE else c for c in range(256))


def _spaced(text: str) -> str:
    return " " + text.lower().encode("utf-8", "replace").translate(_TO_SPACE_BYTES).decode() + " "


def terms_of(text: str) -> set[str]:
    """Terms of a text: ' word ' for words, ' begin' for beginnings."""
    out = set()
    for w in set(_spaced(text).split()):
        if len(w) > 24 or len(w) < 3:
            continue
        out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in BEGINNINGS if n < len(w))
    return out


@dataclass
class Lexicon:
    """Terms with their weights (log of how much likelier they are in toxic texts)."""

    weights: dict[str, float]

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for t, w in self.weights.items():
            a.add_word(t, (1, t, w, len(t)))
        for t in INSULTS:
            old = a.get(f" {t} ", None)
            a.add_word(f" {t} ", (old[0] | 2 if old else 2, f" {t} ", old[2] if old else 0.0, len(t) + 2))
        for t in SECOND_PERSON:
            a.add_word(f" {t} ", (4, f" {t} ", 0.0, len(t) + 2))
        a.make_automaton()
        return a


def features(text: str | None, automaton) -> list[float]:
    text = text or ""
    spaced = _spaced(text)
    words = max(1, len(spaced.split()))
    term_at: dict[int, float] = {}
    kinds: set[str] = set()
    insults = hidden = 0
    you: list[int] = []
    for end, (kind, term, weight, n) in automaton.iter(spaced):
        start = end - n + 1
        if kind & 1:
            term_at[start] = max(weight, term_at.get(start, 0.0))
            kinds.add(term)
        if kind & 2:
            insults += 1
            term_at.setdefault(start, 0.0)
        if kind & 4:
            you.append(start)
    near = 0
    if you and term_at:
        y, t = np.array(you), np.fromiter(term_at, int)
        i = np.searchsorted(y, t)
        gap = np.minimum(np.abs(t - y[np.minimum(i, len(y) - 1)]), np.abs(t - y[np.maximum(i - 1, 0)]))
        near = int((gap <= NEAR).sum())
    broken = _BROKEN.findall(text)
    for w in set(broken):
        plain = f" {w.lower().translate(LOOKALIKE)} "
        hidden += any(kind & 3 for _, (kind, *_) in automaton.iter(plain))
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace") or b" ", np.uint8), minlength=256)
    size = max(1, len(text))
    upper, lower = int(raw[65:91].sum()), int(raw[97:123].sum())
    signs = int(raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum())
    weights = list(term_at.values())
    return [
        float(np.log1p(words)), len(term_at) / words, float(np.log1p(len(term_at))), float(np.log1p(len(kinds))), sum(weights) / words,
        max(weights, default=0.0), near / words, len(you) / words, insults / words, float(hidden), len(broken) / words,
        upper / max(1, upper + lower), len(_SHOUT.findall(text)) / words, raw[33] / size, raw[63] / size, signs / size, int(raw[48:58].sum()) / size,
    ]


def _term_counts(rows: DataFrame) -> DataFrame:
    """(term, fold, label, n): texts of the sample with the term, for terms in at least ``LEAST_TEXTS`` toxic texts."""
    spark = rows.sparkSession

    def count(wanted=None):
        def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                c: Counter = Counter()
                for fold, label, text in zip(b["fold"], b["label"], b["text"], strict=True):
                    found = terms_of(text)
                    c.update((t, fold, label) for t in (found if wanted is None else found & wanted.value))
                yield pd.DataFrame([(t, f, y, n) for (t, f, y), n in c.items()], columns=["term", "fold", "label", "n"])

        return f

    schema = "term string, fold int, label int, n long"
    toxic = rows.filter("label = 1").mapInPandas(count(), schema)
    total = toxic.groupBy("term").agg(F.sum("n").alias("total")).filter(F.col("total") >= LEAST_TEXTS)
    # at most 20 candidates per term that is kept in the end, the most frequent first: a bounded list
    likely = total.orderBy(F.desc("total"), "term").limit(20 * TERMS).select("term").collect()
    wanted = spark.sparkContext.broadcast(frozenset(r["term"] for r in likely))
    sums = rows.mapInPandas(count(wanted), schema).groupBy("term", "fold", "label").agg(F.sum("n").alias("n"))
    return write_table(sums, "toxic-terms")


def choose_terms(counts: DataFrame, sizes: Counter, without: int | None) -> Lexicon:
    """The ``TERMS`` strongest terms, by (toxic texts with it) x (log of how
    much likelier it is in toxic texts), of all folds but ``without``."""
    n_toxic, n_clean = (sum(n for (f, y), n in sizes.items() if y == k and f != without) for k in (1, 0))
    c = counts if without is None else counts.filter(F.col("fold") != without)
    c = c.groupBy("term").agg(*(F.coalesce(F.sum(F.when(F.col("label") == k, F.col("n"))), F.lit(0)).alias(name) for k, name in ((1, "toxic"), (0, "clean"))))
    ratio = (F.col("toxic") / (n_toxic + 1)) / ((F.col("clean") + 0.5) / (n_clean + 1))
    c = c.filter(F.col("toxic") >= LEAST_TEXTS).withColumn("ratio", ratio).filter(F.col("ratio") >= LEAST_RATIO)
    best = c.withColumn("weight", F.log("ratio")).orderBy(F.desc(F.col("toxic") * F.col("weight")), "term").limit(TERMS).select("term", "weight")
    return Lexicon({r["term"]: r["weight"] for r in best.collect()})


def feature_udf(spark: SparkSession, lexicons: list[Lexicon]):
    """Column function (text, index of the lexicon) -> array of features."""
    shared = spark.sparkContext.broadcast([x.weights for x in lexicons])

    @F.pandas_udf("array<double>")
    def f(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        automata = [Lexicon(w).automaton() for w in shared.value]
        for text, which in batches:
            yield pd.Series([np.array(features(t, automata[i]), dtype=float) for t, i in zip(text, which, strict=True)], dtype=object)

    return f


class Model:
    """A fitted scorer: lexicon, trees and calibration, or a constant."""

    def __init__(self, lexicon: Lexicon | None, trees: GBTClassificationModel | None, steps: list[tuple[float, float]], constant: float):
        self.lexicon, self.trees, self.steps, self.constant = lexicon, trees, steps, constant

    def score(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """``docs`` as a struct column ``row``, with ``score`` beside it."""
        d = docs.select(F.struct("*").alias("row"))
        if self.trees is None:
            return d.withColumn("score", F.lit(float(self.constant)))
        f = feature_udf(docs.sparkSession, [self.lexicon])
        d = d.withColumn("features", array_to_vector(f(F.col("row")[text_col].cast("string"), F.lit(0))))
        d = self.trees.transform(d).select("row", vector_to_array("probability")[1].alias("p"))
        return d.select("row", self.calibrated(F.col("p")).alias("score"))

    def calibrated(self, p):
        """The isotonic step function, linear between its points, as a column expression."""
        out = F.lit(self.steps[-1][1])
        for (a, ya), (b, yb) in reversed(list(zip(self.steps[:-1], self.steps[1:], strict=True))):
            line = F.lit(ya) + (p - F.lit(a)) * F.lit((yb - ya) / (b - a) if b > a else 0.0)
            out = F.when(p < F.lit(b), line).otherwise(out)
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(p <= F.lit(self.steps[0][0]), F.lit(self.steps[0][1])).otherwise(out)))


def held_out(id_col: str):
    """Rows of the test part: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on the labelled rows that are not held out."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id IS NOT NULL AND label IN (0, 1)")
    known = known.filter(~held_out("id")).groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most")
    at = F.crc32(F.concat(F.lit("sample-"), F.col("id").cast("string")))
    n = known.count()
    if n > SAMPLE:
        known = known.filter(at < F.lit(int(2**32 * SAMPLE / n)))
    text = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    fold = (F.crc32(F.concat(F.lit("fold-"), F.col("id").cast("string"))) % FOLDS).cast("int")
    rows = write_table(text.join(known, "id").select("id", "text", "label", fold.alias("fold")), "toxic-fit")
    sizes = Counter({(r["fold"], r["label"]): r["count"] for r in rows.groupBy("fold", "label").count().collect()})
    n_toxic, n_clean = (sum(c for (_, y), c in sizes.items() if y == k) for k in (1, 0))
    if not n_toxic or not n_clean:
        return Model(None, None, [], n_toxic / max(1, n_toxic + n_clean))

    counts = _term_counts(rows)
    spark = docs.sparkSession
    f = feature_udf(spark, [choose_terms(counts, sizes, i) for i in range(FOLDS)])
    train = write_table(rows.select("id", "label", "fold", f("text", "fold").alias("f")), "toxic-features")
    train = train.withColumn("features", array_to_vector("f")).withColumn("label", F.col("label").cast("double"))
    gbt = GBTClassifier(maxIter=20, maxDepth=4, stepSize=0.3, seed=7, maxBins=64, minInstancesPerNode=2, featuresCol="features", labelCol="label")
    part = train.filter(F.col("fold") != 0)
    if part.select("label").distinct().count() < 2:
        part = train
    trees = gbt.fit(part)
    seen = trees.transform(train.filter("fold = 0")).select("label", vector_to_array("probability")[1].alias("p"))
    # one clean row at 0 and one toxic row at 1 keep the two ends defined in small samples
    ends = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "label double, p double")
    iso = IsotonicRegression(featuresCol="p", labelCol="label").fit(seen.union(ends))
    steps = list(zip(iso.boundaries.toArray().tolist(), iso.predictions.toArray().tolist(), strict=True))
    return Model(choose_terms(counts, sizes, None), trees, steps, 0.0)


def score_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = fit(docs, labels).score(docs)
    ident = F.col("row")["doc_id"]
    return scored.select(
        ident.alias("doc_id"), F.coalesce(F.crc32(ident.cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def remove_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents scored below the threshold, with the columns of ``docs``."""
    return fit(docs, labels).score(docs).filter(F.col("score") < THRESHOLD).select("row.*")
