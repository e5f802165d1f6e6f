"""Corpus pipeline: quality filter, near-dedup, secret redaction, source mix, token ids.

STAGES lists (name, function) pairs. A function takes (spark, docs, sf_dir);
its result, written as Parquet and read again, is the next one's docs. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basketry.llm import bpe, mixing, quality, secrets, simhash
from basketry.llm.common import materialise, read_table
from basketry.llm.queries import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score 0.7 or more)."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the smallest doc_id, null ids last."""
    return simhash.dedup(docs, words=4, radius=4)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by a mark; no row goes."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each whole text and the digests of the round trip."""
    return bpe.encode_documents(docs, tokenizer_path(), keep=("doc_id", "source"), ids=True)


STAGES = [
    ("quality", keep_quality),
    ("simhash", near_dedup),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: A fitted classifier and XXH64 are not SQL; tests compare run() with the stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a Parquet table in the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
