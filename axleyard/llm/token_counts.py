"""Token counts (operator 9): a cache of counts keyed by content digest and tokenizer digest.

Every text is reduced to the digest of its normalised content (runs of white space are one blank: the
tokenizer drops white space, so its count is unchanged). Digests found in the cache take the stored count;
the others are encoded once per distinct digest and appended to the cache.

Defined results: a null text counts as empty (0 tokens); rows with null or repeated ids are counted one by
one; an empty table gives no rows and leaves the cache as it is. Texts of one normalised content are encoded once, the text
of the smallest id. A very long text is encoded whole. Other columns are not read, so their names may clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import SPACE, crc_bucket, shared_dir, slices, text_key, text_or_empty, written

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """SHA-256 of the tokenizer's file: another version never reads this one's counts."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def _exists(df_session, path: str) -> bool:
    jvm = df_session._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(df_session._jsc.hadoopConfiguration()).exists(p)


def _count(tokenizer_path: str, slice_bytes: int = 2_000_000):
    def run(batches):
        bpe = encoder(tokenizer_path)
        seen: set[bytes] = set()  # rows that repeat both id and text meet in one task
        for batch in batches:
            digests = batch.column(0).to_pylist()
            batch = batch.filter(pa.array([d not in seen and not seen.add(d) for d in digests], pa.bool_()))
            texts = batch.column(1).to_pylist()
            n = np.zeros(len(texts), np.int64)
            for a, b in slices([len(t) for t in texts], slice_bytes):
                n[a:b] = [len(x) for x in bpe.encode(texts[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n)], names=["digest", "n_tokens"])

    return run


def _keyed(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str, text_col: str) -> DataFrame:
    """(_ax_id, keeper, key, n_bytes, digest) of each row; by then the cache holds the counts of all their digests.

    Texts move once, and only to pick one row for each distinct digest that the cache lacks.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    text = text_or_empty(text_col)
    normal = F.trim(F.regexp_replace(text, SPACE + "+", " "))
    lowest = F.lit(-(2**63))
    keeper = F.coalesce(F.col(id_col).cast("long"), lowest) if dict(docs.dtypes)[id_col] in ("int", "bigint", "smallint", "tinyint") else F.xxhash64(F.col(id_col))
    # one pass normalises and digests every text; from here on rows are known by id and text fingerprint
    keyed = written(docs.select(F.col(id_col).alias("_ax_id"), keeper.alias("keeper"), text_key(text_col).alias("key"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(normal.cast("binary"), 256)).alias("digest")))
    cached = spark.createDataFrame([], CACHE_SCHEMA)
    if _exists(spark.sparkContext, cache_path):
        cached = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    known = cached.filter(F.col("tokenizer") == version).select("digest").distinct()
    one = keyed.groupBy("digest").agg(F.min("keeper").alias("keeper"))
    misses = keyed.join(one.join(known, "digest", "left_anti"), ["digest", "keeper"]).select("digest", "keeper", "key")
    texts = docs.select(keeper.alias("keeper"), text_key(text_col).alias("key"), text.alias("text"))
    todo = texts.join(misses.distinct().hint("shuffle_hash"), ["keeper", "key"]).select("digest", "text")
    fresh = todo.mapInArrow(_count(tokenizer_path), "digest binary, n_tokens long")
    fresh.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").option("compression", "zstd").parquet(cache_path)
    return keyed


def _counts(spark, tokenizer_path: str, cache_path: str) -> DataFrame:
    """(digest, n_tokens) as the cache is now.

    Its files are named one by one: two reads of one folder at different times would count as the same in a plan.
    """
    files = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).inputFiles()
    held = spark.read.schema(CACHE_SCHEMA).parquet(*files) if files else spark.createDataFrame([], CACHE_SCHEMA)
    return held.filter(F.col("tokenizer") == tokenizer_digest(tokenizer_path)).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``n_bytes`` and ``n_tokens``.

    ``cache_path`` holds the counts between runs; without it a new cache is begun in the shared folder.
    """
    cache_path = cache_path or shared_dir(docs.sparkSession)
    keyed = _keyed(docs, tokenizer_path, cache_path, id_col, text_col)
    return keyed.join(_counts(docs.sparkSession, tokenizer_path, cache_path), "digest", "left").select(F.col("_ax_id").alias(id_col), "n_bytes", "n_tokens")


def counts_result(docs: DataFrame, tokenizer_path: str, limit: int = 2048, parts: int = 2) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row.

    The rows are counted in ``parts`` by a hash of their ids, as batches that come in one after another: each part meets the
    cache that those before it filled, and encodes only what they lack.
    """
    cache, keyed = shared_dir(docs.sparkSession), None
    for k in range(parts):
        own = _keyed(docs.filter(crc_bucket("doc_id", parts) == k), tokenizer_path, cache, "doc_id", "text")
        keyed = own if keyed is None else keyed.unionByName(own)
    out = keyed.join(_counts(docs.sparkSession, tokenizer_path, cache), "digest", "left")
    return out.select(F.col("_ax_id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
