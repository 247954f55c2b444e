"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import secrets
from .bpe import encode_decode_digests
from .decontam import decontaminate
from .langid import language_id
from .licenses import license_scan
from .minhash import near_duplicates
from .oracles import ORACLES
from .phrases import substring_dedup
from .ranking import ranked_search
from .simjoin import similar_vectors
from .sstable import read_token_ids, write_token_ids
from .suffixes import suffix_dedup
from .tokencount import token_counts
from .whitening import whiten


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is on this machine; every executor has the same files."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"), n=20, texts=False)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=512)


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode_digests(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.95)


def op7_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_ids(write_token_ids(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), w=2, percent=80).drop("k")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents"), n=50, texts=False)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"), components=32)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scan, op2_substring_dedup, op3_license_scan, op4_token_counts, op5_bpe_codec, op6_embedding_near_dedup, op7_token_id_output, op8_minhash_near_dedup, op9_language_id, op10_decontamination, op11_ranked_search, op12_suffix_dedup, op13_whitening, pipeline)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
