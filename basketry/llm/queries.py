"""Registered queries of the package: thin digests of the operators' results over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basketry.llm import bpe, bytebpe, chat, embed, html, lexical, mixing, negatives, quality, secrets, shards, simhash, topk
from basketry.llm.common import read_table


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), every=100, k=10)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read_table(spark, sf_dir, "documents"), tokenizer_path(), ids=False)


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(read_table(spark, sf_dir, "documents"), shards=8)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(read_table(spark, sf_dir, "documents"), words=4, radius=4)


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_duplicates(read_table(spark, sf_dir, "embeddings"), limit=0.95)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(read_table(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read_table(spark, sf_dir, "pages"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(read_table(spark, sf_dir, "conversations"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(read_table(spark, sf_dir, "embeddings"), every=100, positives=5, negatives=5)


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=10)


def op13_bytebpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return bytebpe.encode_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                                    public_tokenizers.PATTERN, ids=False)


QUERIES = {
    "op1_topk": op1_topk,
    "op2_bpe": op2_bpe,
    "op3_shards": op3_shards,
    "op4_simhash": op4_simhash,
    "op5_embeddings": op5_embeddings,
    "op6_quality": op6_quality,
    "op7_mixing": op7_mixing,
    "op8_secrets": op8_secrets,
    "op9_html": op9_html,
    "op10_chat": op10_chat,
    "op11_negatives": op11_negatives,
    "op12_lexical": op12_lexical,
    "op13_bytebpe": op13_bytebpe,
}
