"""Corpus pipeline: quality rules, near-duplicate join, repeated passages, personal data, packing.

Every stage works on all rows its predecessor kept. A stage returns the columns of documents, the last
one the packed pieces. Null texts count as empty; an empty table passes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelith.llm import host_quality, ngram_join, packing, sanitize, suffix_index
from tracelith.llm.common import row_keys, ship, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near duplicates: words of a shingle, least similarity in percent.
WORDS, PERCENT = 5, 80


def _columns(docs: DataFrame) -> list[str]:
    return [c for c in COLUMNS if c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text fails the base rules or whose host's verdict rejects them go."""
    return host_quality.filter_rows(docs).select(*_columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays, once. Different texts of one id, or of null, are rows of their own."""
    ship(spark)
    rows, _ = row_keys(docs)
    found = ngram_join.jaccard_components(rows.select(F.col("_key").alias("doc_id"), "text"), WORDS, PERCENT)
    keep = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    keep = written(keep, "stay")
    out = rows.join(keep.select(F.col("doc_id").alias("_key")), "_key", "left_semi")
    if not keep.where("rows > 1").isEmpty():
        out = out.dropDuplicates(["_key"])
    return out.select(*_columns(docs))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that a smaller doc_id has go, with characters cut by that; emptied documents go."""
    ship(spark)
    rows, _ = row_keys(docs)
    kept = suffix_index.remove_keyed(rows.select(F.col("_key").alias("doc_id"), "text"), digests=False)
    # decode() would put marks for bytes of a cut character; they belong to the removed passage.
    clean = kept.where("n_removed = 0 or n_removed < n_bytes").select(F.col("doc_id").alias("_key"), suffix_index.valid_text("kept").alias("text")).dropDuplicates(["_key"])
    rest = rows.drop("text").join(clean, "_key")
    if "n_chars" in docs.columns:
        rest = rest.withColumn("n_chars", F.length("text").cast("long"))
    return rest.select(*_columns(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced in the texts."""
    ship(spark)
    return sanitize.sanitize(docs).select(*_columns(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of up to 2048 ids."""
    import public_tokenizers

    ship(spark)
    path = public_tokenizers.path
    return packing.pack_documents(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: Suffix arrays and token packing have no SQL form; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
