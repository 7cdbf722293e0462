"""Corpus pipeline: stages over the documents table, each written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from stratum.llm import bagminhash, bpe, decontaminate, quality, suffixes
from stratum.llm.common import held_out, scratch, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels of this input, doesn't reject."""
    root = scratch(spark, "quality")
    quality.with_features(docs.filter(~held_out(F.col("doc_id")))).write.parquet(root)  # narrow rows meet the labels
    return quality.keep_good(docs, quality.learn(spark.read.parquet(root), table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return bagminhash.keep_one(docs)


#: Bytes of a string that may not repeat: passages of fifty words are longer, chance repeats
#: and stock phrases shorter. No copy of a passage stays, so no document depends on another's fate.
PASSAGE = 250


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of ``PASSAGE`` bytes that start anywhere else."""
    result, packed = suffixes.remove_repeats(docs, keep_rest=True, length=PASSAGE)
    root = scratch(spark, "unrepeated")
    result.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns).write.parquet(root)
    packed.unpersist()
    return spark.read.parquet(root)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate, less the benchmark windows in them."""
    kept = decontaminate.remove_spans(docs, table(spark, sf_dir, "benchmark"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document that is left, with digests of ids and decoded bytes."""
    out = bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    decimal = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good),
    ("near-duplicates", distinct),
    ("suffix-array dedup", unrepeated),
    ("decontamination", uncontaminated),
    ("byte BPE", encode),
]

#: The stages learn a classifier, sketch and encode: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns the last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    root = scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{root}/{i}")
        docs = spark.read.parquet(f"{root}/{i}")
    return docs
