"""A training corpus from the documents table, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. ``run`` writes each stage's result as
Parquet under the shared scratch folder and gives it to the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import line_dedup, mixing, order_minhash, packing, toxicity
from marketlens.llm.common import DOC_COLUMNS, table
from marketlens.llm.queries import TOKENIZER
from marketlens.session import write_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below its threshold; it learns from ``labels`` of documents still there."""
    return toxicity.remove_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines are cut out; a document of which nothing is left goes."""
    d = line_dedup.dedup_lines(docs, counts=True)
    gone = (F.col("line_dedup.n_removed") > 0) & (F.col("line_dedup.n_removed") == F.col("line_dedup.n_lines"))
    return d.filter(~gone).drop("line_dedup")


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return order_minhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target sizes: documents repeat by epochs, the one on the cut is shortened."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens."""
    return packing.pack_table(docs, TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("mix_sources", mix_sources),
    ("packing", pack_sequences),
]

#: Toxicity scores and near duplicates have no SQL form; tests/llm/test_pipeline.py checks the rows instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over ``documents``."""
    docs = table(spark, sf_dir, "documents").select(*DOC_COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
