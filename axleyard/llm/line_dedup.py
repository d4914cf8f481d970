"""Line dedup (operator 4): lines that many documents share stay only in the document with the largest id.

Lines are exploded with their positions, normalised (white space stripped at both ends, A-Z lower-cased)
and hashed to 128 bits. Documents are counted per hash; a hash in at least ``min_docs`` documents loses
its lines everywhere but in the largest id; texts are put together again from the positions that stay.
Only hashes and positions are shuffled besides one pass of the texts to meet their dropped positions; the
join by hash is a plain sort-merge join, whose hot hashes (a line in a third of all documents) Spark splits.

Defined results: a null or empty text is one empty line. Rows that repeat an id count as one document and
each is returned. Rows with a null id are no document: they are returned with nothing dropped. Lines of one key
in one document are all kept or all dropped. A very long text is one row throughout: its lines are hashed where
it stands and its dropped positions come back as one array. An empty table gives no rows. Columns besides id and
text pass through untouched in ``dedup_lines``, whatever their names (names that begin with ``_ax_`` are the library's own).
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_key, text_or_empty, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NOT_STARTS = bytes(range(0x80, 0xC0))


def line_key(line: bytes) -> bytes:
    """Bytes strip and lower only touch ASCII: white space at both ends, A-Z."""
    return line.strip().lower()


def code_points(key: bytes) -> int:
    return len(key.translate(None, _NOT_STARTS))


def _hashed_lines(min_chars: int):
    """(id, text fingerprint, text) -> a row for each line whose key is long enough: its position and its key's hash."""

    def run(batches):
        for batch in batches:
            rows, pos, hashes = [], [], []
            for row, text in enumerate(batch.column(2).to_pylist()):
                for i, line in enumerate(text.split(b"\n")):
                    if len(line) >= min_chars:
                        key = line_key(line)
                        if len(key) >= min_chars and code_points(key) >= min_chars:
                            rows.append(row), pos.append(i), hashes.append(xxhash.xxh3_128_digest(key))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(pos, pa.int32()), pa.array(hashes, pa.binary())], names=["_ax_id", "_ax_text", "pos", "hash"])

    return run


def dropped_positions(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_ax_id, _ax_text, dropped array<int>): sorted positions of the lines to drop, for texts that lose any."""
    kind = docs.schema[id_col].dataType.simpleString()
    some = docs.filter(F.col(id_col).isNotNull() & (F.length(text_col) >= min_chars)).select(F.col(id_col).alias("_ax_id"), text_key(text_col).alias("_ax_text"), F.col(text_col).cast("binary").alias("text"))
    lines = written(some.mapInArrow(_hashed_lines(min_chars), f"_ax_id {kind}, _ax_text long, pos int, hash binary"))
    shared = (
        lines.select("hash", "_ax_id").distinct().groupBy("hash").agg(F.count("*").alias("n"), F.max("_ax_id").alias("keeper"))
        .filter(F.col("n") >= min_docs).select("hash", "keeper")
    )
    hits = lines.join(shared, "hash").filter(F.col("_ax_id") != F.col("keeper"))
    # rows that repeat both id and text give each position more than once
    return hits.groupBy("_ax_id", "_ax_text").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its text replaced by the lines that stay, and ``_ax_lines``, ``_ax_dropped`` (counts)."""
    drops = dropped_positions(docs, min_chars, min_docs, id_col, text_col).withColumnRenamed("dropped", "_ax_pos")
    d = docs.withColumn("_ax_key", text_key(text_col))
    joined = d.join(drops, (d[id_col] == drops["_ax_id"]) & (d["_ax_key"] == drops["_ax_text"]), "left")
    lines = F.split(text_or_empty(text_col), "\n", -1)
    # the runs of lines between dropped ones: each line is copied once, however many are dropped
    runs = F.transform(
        F.sequence(F.lit(0), F.size("_ax_pos")),
        lambda i: F.slice(
            lines,
            F.when(i == 0, F.lit(1)).otherwise(F.get(F.col("_ax_pos"), i - 1) + 2),
            F.coalesce(F.get(F.col("_ax_pos"), i), F.size(lines)) - F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("_ax_pos"), i - 1) + 1),
        ),
    )
    kept = F.when(F.col("_ax_pos").isNull(), text_or_empty(text_col)).otherwise(F.concat_ws("\n", F.flatten(runs)))
    return joined.withColumn("_ax_lines", F.size(lines).cast("long")).withColumn("_ax_dropped", F.coalesce(F.size("_ax_pos"), F.lit(0)).cast("long")).withColumn(text_col, kept).drop("_ax_key", "_ax_id", "_ax_text", "_ax_pos")


def line_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row."""
    return dedup_lines(docs.select("doc_id", "text")).select(
        "doc_id", F.col("_ax_lines").alias("n_lines"), F.col("_ax_dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


SQL = r"""
WITH lines AS (
  SELECT doc_id, i AS pos, l[i] AS line,
    translate(regexp_replace(l[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
shared AS (SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT x.doc_id, x.pos, x.line, s.key IS NOT NULL AND x.doc_id <> s.keeper AS dropped FROM lines x LEFT JOIN shared s USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
