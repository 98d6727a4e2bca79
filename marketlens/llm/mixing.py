"""Mixing sources to target weights (native DataFrame operations only).

Every document gets a hash-random key (md5 of its id). Within a source the
documents are in key order; the key's leading hex digits are range buckets,
so the order is a distributed range sort: word counts are summed per
(source, bucket), prefix sums over the buckets give each bucket's start, and
a window inside each (source, bucket) gives each document's own start. A
source of any size is therefore spread over ``16 ** BUCKET_DIGITS`` groups.

A source's target is met exactly: whole epochs over all its documents, then
one more pass in key order that is cut at the remaining budget; the document
on the cut gives only the words that still fit.

Defined cases: null text has size 0; a null source is a source of its own,
ordered last; a null doc_id has the key of the empty string; rows equal in id
and size may swap places in the order, which leaves the result the same as a
set; an empty table gives an empty result. Columns other than those named in
the arguments are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values of the contract: weights by source order, largest number of epochs, word pattern.
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
WORD = r"[^\x20\x09-\x0D]+"

#: Hex digits of the key that form the range buckets (4096 of them per source).
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``target`` for rows (no_source, source, source_size), one row per source.

    Shares of the total by weight, none above ``MAX_EPOCHS`` times its source's
    size: sources are put in order of cap / weight; if the first k of them are
    capped, the others share what is left at one rate per unit of weight. The
    largest k whose k-th cap lies below the rate before it is the fixed point
    that repeated resharing of the excess ends in. One row per source is
    sorted in one task; documents never are.
    """
    order = W.orderBy("no_source", "source")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), "no_source", "source")
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = (
        sizes.withColumn("place", F.row_number().over(order) - 1)
        .withColumn("weight", weight.cast("double"))
        .withColumn("cap", (F.col("source_size") * MAX_EPOCHS).cast("double"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("rest", F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("rate", F.col("left") / F.col("rest"))
        .withColumn("capped", F.col("cap") < F.col("rate") * F.col("weight"))
    )
    rate = F.min(F.when(~F.col("capped"), F.struct("rank", "rate"))).over(everything).getField("rate")
    s = s.withColumn("rank", F.row_number().over(by_cap)).withColumn("final", rate)
    return s.select(
        "no_source", "source", "source_size",
        F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("final") * F.col("weight"), F.col("cap"))).alias("target"),
    )


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: its words, its source's size and target, and the words the mix takes from it.

    ``keep`` names further columns of ``docs`` to carry along.
    """
    # "m_" names cannot clash with carried columns: only the aliases below exist from here on.
    d = docs.select(
        F.col(id_col).alias("m_id"),
        F.col(source_col).isNull().alias("no_source"),
        F.coalesce(F.col(source_col), F.lit("")).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("key"),
        *([F.struct(*keep).alias("kept")] if keep else []),
    ).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    by = ["no_source", "source"]
    per_bucket = d.groupBy(*by, "bucket").agg(F.sum("size").alias("bucket_size"))
    in_source = W.partitionBy(*by).orderBy("bucket")
    starts = per_bucket.withColumn("bucket_start", F.sum("bucket_size").over(in_source) - F.col("bucket_size"))
    goal = targets(per_bucket.groupBy(*by).agg(F.sum("bucket_size").alias("source_size")))
    starts = starts.join(goal, by).drop("bucket_size")
    inner = W.partitionBy(*by, "bucket").orderBy("key", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = d.withColumn("upto", F.sum("size").over(inner)).join(starts, [*by, "bucket"])
    first = F.col("bucket_start") + F.col("upto") - F.col("size")
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    return (
        placed.withColumn("epochs", epochs)
        .withColumn("cut", budget - F.col("epochs") * F.col("source_size"))
        .withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("cut") - first)).cast("long"))
        .select(
            F.col("m_id").alias("doc_id"),
            "size",
            "source_size",
            "target",
            (F.col("epochs") * F.col("size") + F.col("extra")).alias("taken"),
            "epochs",
            "extra",
            *([F.col("kept")] if keep else []),
        )
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed rows themselves, with the columns of ``docs``: one row per
    epoch of a document, and one row with the first ``extra`` words of the
    document on the cut. Documents without words stay once: they cost nothing."""
    p = plan(docs, id_col, text_col, source_col, keep=tuple(docs.columns))
    part = F.array_join(F.slice(F.regexp_extract_all(F.col("kept")[text_col], F.lit(rf"(?s)[\x20\x09-\x0D]*{WORD}"), 0), 1,
                                F.col("extra").cast("int")), "")
    whole = F.when(F.col("size") == 0, 1).otherwise(F.col("epochs") + F.when(F.col("extra") == F.col("size"), 1).otherwise(0))
    rows = F.array_repeat(F.lit(True), whole.cast("int"))
    cut = F.when((F.col("extra") > 0) & (F.col("extra") < F.col("size")), F.array(F.lit(False))).otherwise(F.array().cast("array<boolean>"))
    out = p.withColumn("whole", F.explode(F.concat(rows, cut)))
    fields = []
    for name in docs.columns:
        value = F.col("kept")[name]
        if name == text_col:
            value = F.when(F.col("whole"), value).otherwise(part)
        elif name == "n_chars":
            value = F.when(F.col("whole"), value).otherwise(F.length(part)).cast(docs.schema[name].dataType)
        fields.append(value.alias(name))
    return out.select(*fields)


#: DuckDB form of ``plan``'s contract columns over a relation ``docs`` (doc_id, text, source).
PLAN_SQL = r"""
WITH d AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
s0 AS (SELECT no_source, source, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
s1 AS (
  SELECT *, (CASE (row_number() OVER (ORDER BY no_source, encode(source)) - 1) % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END)::DOUBLE AS weight,
         (source_size * 3)::DOUBLE AS cap FROM s0),
s2 AS (
  SELECT *, row_number() OVER w AS rank,
         ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS rate
  FROM s1 WINDOW w AS (ORDER BY cap / weight, no_source, encode(source))),
s3 AS (
  SELECT *, cap < rate * weight AS capped, arg_min(rate, rank) FILTER (WHERE NOT cap < rate * weight) OVER () AS final FROM s2),
s AS (SELECT no_source, source, source_size, CASE WHEN capped THEN cap ELSE least(final * weight, cap) END AS target FROM s3),
p AS (
  SELECT d.doc_id, d.size, s.source_size, s.target, round(s.target)::BIGINT AS budget,
         sum(d.size) OVER (PARTITION BY d.no_source, d.source ORDER BY d.key, d.size ROWS UNBOUNDED PRECEDING) - d.size AS first
  FROM d JOIN s USING (no_source, source)),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - first)))::BIGINT AS taken
FROM e
"""
