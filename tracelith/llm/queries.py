"""The opN_ queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import embed_dedup, host_quality, licenses, ngram_join, oracles, packing, sanitize, sentencepiece_bpe, suffix_index, warc, weak_quality
from .common import ship, table


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_quality.quality(table(spark, sf_dir, "documents"))


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return sentencepiece_bpe.encode_decode(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"), digests=True)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack_documents(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("byte_bpe_50k.tiktoken"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return sanitize.spans(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return suffix_index.remove_repeats(table(spark, sf_dir, "documents"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return weak_quality.classify(table(spark, sf_dir, "documents"))


QUERIES = {"op1_license_scan": op1_license_scan, "op3_quality_classifier": op3_quality_classifier, "op7_suffix_dedup": op7_suffix_dedup, "op8_ngram_join": op8_ngram_join, "op9_embedding_dedup": op9_embedding_dedup, "op4_pii": op4_pii, "op6_warc": op6_warc, "op2_sentencepiece": op2_sentencepiece, "op10_packing": op10_packing, "op5_quality_rules": op5_quality_rules}

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": licenses.oracle_sql(), "op5_quality_rules": oracles.OP5, "op8_ngram_join": oracles.OP8, "op9_embedding_dedup": oracles.OP9,
}
