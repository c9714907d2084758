"""The registered queries of the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, chat, chunks, embeddings, mixing, neardup, packing, pii, pipeline, quality, repetition, search, suffixes, urls
from .common import saved, table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_documents(table(spark, sf_dir, "documents"), words=2)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), returned=True)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digest(chat.format_chats(chat.with_planted(table(spark, sf_dir, "conversations"))))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality_rules(table(spark, sf_dir, "documents"))


def op8_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(mixing.mix(table(spark, sf_dir, "documents")))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"), save=lambda df: saved(df, "pii"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokens(table(spark, sf_dir, "documents"))


def op12_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.encode_documents(table(spark, sf_dir, "documents"))


QUERIES = {
    "pipeline": pipeline.run,
    "op1_quality_classifier": op1_quality_classifier,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_url_filters": op3_url_filters,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_quality_rules": op7_quality_rules,
    "op8_mixing_sources": op8_mixing_sources,
    "op9_pii": op9_pii,
    "op10_packing": op10_packing,
    "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
    "op12_ranked_lexical_search": op12_ranked_lexical_search,
    "op13_bpe_encoding": op13_bpe_encoding,
}

ORACLES = {
    "op2_minhash_near_dedup": neardup.SQL,
    "op3_url_filters": urls.SQL,
    "op4_suffix_dedup": suffixes.SQL,
    "op5_embedding_near_dedup": embeddings.SQL,
    "op6_chat_formatting": chat.SQL,
    "op8_mixing_sources": mixing.SQL,
    "op12_ranked_lexical_search": search.SQL,
}
