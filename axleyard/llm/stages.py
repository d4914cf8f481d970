"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir), works on all of ``docs`` and returns what it keeps."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, line_dedup, near_dedup, quality_model
from .common import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. A document's host is its source, its path the source's language section.

    Null and empty texts are judged by their features (of no words) and usually go; null sources and languages are
    groups of their own; repeated rows stay or go together; a score of 0.5 stays; an empty table gives none. A very
    long text is judged whole. Columns pass through, whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    site = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    return quality_model.keep_quality(docs, labels, F.col("source"), site)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shared lines go from all documents but one; n_chars follows the text.

    No row goes. A null text becomes an empty one; rows with a null id keep all lines; rows that repeat an id count
    as one document, and the largest id keeps a shared line. A very long text is cut whole; an empty table gives none.
    Columns pass through, whatever their names.
    """
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles, 0.8) stays: the one with the smallest id.

    Null, empty and blank texts are near nothing; of such rows that repeat id and text one stays. Null ids come last
    where a group has others; of equal ids the smallest text fingerprint stays, and one of rows that repeat both. A
    similarity of exactly 0.8 is near. Very long texts are compared whole; an empty table gives none. Columns pass
    through, whatever their names.
    """
    return near_dedup.keep_one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go.

    Null and empty texts hold none and stay; repeated rows stay or go together, whatever their ids; a share equal to
    its limit counts as held. Null or empty items match nothing. Very long texts are searched whole; an empty table
    gives none. Columns pass through, whatever their names.
    """
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of what they decode to: doc_id, n_tokens, ids, decoded_sha256.

    A null text is an empty one, without ids; repeated rows and null ids are encoded one by one. Very long texts are
    encoded whole; an empty table gives none. Columns but id and text are not read.
    """
    e = bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return e.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontaminate", benchmark_leaks), ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents; what one returns is written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
