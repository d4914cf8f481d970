"""What the text operators share: words, hashes, written tables, safe column names."""

from __future__ import annotations

import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import local_folder

#: White space between words: blank and \t \n \v \f \r. ``bytes.split()`` splits at exactly these.
SPACE = r"[\x20\x09-\x0D]"
_U = np.uint64
MIX_A, MIX_B, MIX_C = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; only where that is unset and Spark is local (tests), under a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not jdir.isDefined():
            spark.sparkContext.setCheckpointDir(local_folder(spark))
            jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = jdir.get()
    return f"{base.rstrip('/')}/axleyard-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df`` written as Parquet in the shared folder and read back: computed once, lineage cut."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """The written tables of one job: ``clear`` deletes them once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame) -> DataFrame:
        path = shared_dir(self.spark)
        df.write.option("compression", "zstd").parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self, but: DataFrame | None = None) -> None:
        """Deletes all tables written so far, but the one that ``but`` reads."""
        kept = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in but.inputFiles()} if but is not None else set()
        jvm = self.spark._jvm
        for path in self.paths:
            if path.rsplit("/", 1)[-1] not in kept:
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.paths = [p for p in self.paths if p.rsplit("/", 1)[-1] in kept]


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def text_key(col: str = "text") -> Column:
    """A fingerprint of the text that tells rows with one doc_id but different texts apart."""
    return F.xxhash64(F.col(col))


def crc_bucket(col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null ids count as the text ''."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % mod


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (uint64 in, uint64 out)."""
    x = x.copy()
    x ^= x >> _U(30)
    x *= MIX_B
    x ^= x >> _U(27)
    x *= MIX_C
    x ^= x >> _U(31)
    return x


class WordHasher(dict):
    """word (bytes) -> 64-bit hash. Emptied when it holds ``limit`` words, so memory stays bounded."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; with fewer words the whole sequence is the one run. No words: none."""
    n = len(words)
    if n == 0:
        return words
    run = min(width, n)
    out = words[: n - run + 1].copy()
    for j in range(1, run):
        out *= MIX_A
        out += words[j : n - run + 1 + j]
    return mixed(out + _U(run))


def slices(sizes, most: int):
    """Consecutive (start, end) index pairs whose sizes add up to ``most`` or hold one item."""
    start = total = 0
    for i, s in enumerate(sizes):
        if total and total + s > most:
            yield start, i
            start, total = i, 0
        total += s
    if start < len(sizes):
        yield start, len(sizes)
