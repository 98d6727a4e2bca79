"""The registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marketlens.llm import (
    conversation_repair,
    html_extract,
    jaccard_groups,
    line_dedup,
    mixing,
    nn_descent,
    order_minhash,
    packing,
    repair,
    suffix_dedup,
    token_alignment,
    topk,
    toxicity,
)
from marketlens.llm.common import table

#: Tokenizer file of the queries; the operators take any file the tokenizers library reads.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: The two tokenizers of the alignment.
ALIGNED = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op1_token_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.encode_table(table(spark, sf_dir, "documents"), TOKENIZER, end_id=2)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_table(table(spark, sf_dir, "documents"), TOKENIZER, end_id=0, capacity=2048)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), counts=True).select("doc_id", "line_dedup.*", "text")


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.membership(table(spark, sf_dir, "documents"))


def op5_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.search_table(table(spark, sf_dir, "embeddings"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search_table(table(spark, sf_dir, "embeddings"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op11_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups.jaccard_components(table(spark, sf_dir, "documents")).drop("class_id")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_table(table(spark, sf_dir, "documents"), *ALIGNED)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_table(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_repair": op1_token_repair,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_line_dedup": op3_line_dedup,
    "op4_order_minhash": op4_order_minhash,
    "op5_nn_descent": op5_nn_descent,
    "op6_mix_sources": op6_mix_sources,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_toxicity": op9_toxicity,
    "op10_main_text": op10_main_text,
    "op11_jaccard_groups": op11_jaccard_groups,
    "op12_token_alignment": op12_token_alignment,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLES: dict[str, str] = {
    "op3_line_dedup": line_dedup.DEDUP_SQL,
    "op6_mix_sources": mixing.PLAN_SQL,
    "op8_exact_top_k": topk.TOP_K_SQL,
    "op11_jaccard_groups": jaccard_groups.COMPONENTS_SQL,
}
