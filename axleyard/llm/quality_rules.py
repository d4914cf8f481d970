"""Quality rules (operator 5): compression bands.

zstandard ratios (bytes before / bytes after) of the whole text and of its fixed chunks are held against
limits for the text's length: repetitive text compresses too well, noise too badly. Counts of words,
symbols, repeated lines and repeated 3-word windows come with them.

Defined results: a null text is an empty one; an empty text has no words and fails the base rule. One row
comes out for each row in, whatever its id, repeated rows too; other columns are not read, so their names may clash.
A very long text is measured whole. A ratio equal to a limit is inside it. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: (bytes from, lowest ratio, highest ratio): the lowest lie under the 0.1 percentile of labelled clean prose of sf0.1 and
#: rise with the logarithm of the length from one row to the next; texts under the second row's length have none.
WHOLE_BANDS = ((0, 0.0, 4.0), (256, 1.33, 4.0), (512, 1.43, 5.0), (1024, 1.67, 5.0), (2048, 1.87, 7.0), (4096, 2.03, 7.0), (8192, 2.12, 7.0), (16384, 2.2, 9.0), (131072, 2.2, 12.0))
#: Chunks have CHUNK_BYTES; a last one under CHUNK_LEAST joins the one before it. The lowest ratio is the one of a text of the
#: chunk's length. CHUNK_SHARE is the share of chunks that may be outside.
CHUNK_BYTES, CHUNK_LEAST, CHUNK_HIGH, CHUNK_SHARE = 4096, 512, 8.0, 0.2
SYMBOLS = b"#*$%&|<>"
_NOT_CONTINUED = bytes(range(0x80, 0xC0))


@functools.lru_cache(maxsize=1)
def _zstd() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3)


def ratio(data: bytes) -> float:
    """Bytes before / after; 1.0 for none."""
    return len(data) / len(_zstd().compress(data)) if data else 1.0


def limits(size: int, bands=WHOLE_BANDS) -> tuple[float, float]:
    """(lowest, highest) ratio of a text of ``size`` bytes."""
    at = next(k for k in reversed(range(len(bands))) if size >= bands[k][0])
    start, low, high = bands[at]
    if start and at + 1 < len(bands):
        end, then, _ = bands[at + 1]
        low += (then - low) * math.log(size / start) / math.log(end / start)
    return low, high


def chunk_ends(size: int, chunk_bytes: int = CHUNK_BYTES) -> list[tuple[int, int]]:
    """(start, end) of the chunks of a text: they cover all of it."""
    starts = list(range(0, size, chunk_bytes))
    if len(starts) > 1 and size - starts[-1] < CHUNK_LEAST:
        starts.pop()
    return list(zip(starts, [*starts[1:], size]))


def in_bands(data: bytes, whole: float, chunks: list[float], whole_bands=WHOLE_BANDS, chunk_high=CHUNK_HIGH, chunk_share=CHUNK_SHARE, chunk_bytes=CHUNK_BYTES) -> bool:
    low, high = limits(len(data), whole_bands)
    outside = sum(not limits(b - a, whole_bands)[0] <= c <= chunk_high for (a, b), c in zip(chunk_ends(len(data), chunk_bytes), chunks))
    return low <= whole <= high and outside <= chunk_share * len(chunks)


def measured(data: bytes, chunk_bytes: int = CHUNK_BYTES) -> dict:
    words = data.split()
    windows = list(zip(words, words[1:], words[2:]))
    twice = {w for w, c in Counter(windows).items() if c > 1}
    repeated, last = 0, -1
    if twice:
        for i, w in enumerate(windows):
            if w in twice:
                repeated += i + 2 - max(last, i - 1)
                last = i + 2
    lines = [x for x in data.split(b"\n") if x.split()]
    chunks = [ratio(data[a:b]) for a, b in chunk_ends(len(data), chunk_bytes)]
    whole = ratio(data)
    joined = b"".join(words)
    n = len(words)
    failed = n < 50 or 100 * repeated > 50 * n
    return {
        "n_words": n,
        "word_chars": len(joined.translate(None, _NOT_CONTINUED)),
        "n_symbols": len(data) - len(data.translate(None, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated,
        "base_failed": failed,
        "zstd_ratio": whole,
        "chunk_ratio_min": min(chunks, default=whole),
        "chunk_ratio_max": max(chunks, default=whole),
        "kept": not failed and in_bands(data, whole, chunks, chunk_bytes=chunk_bytes),
    }


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, zstd_ratio double, chunk_ratio_min double, chunk_ratio_max double, kept boolean"


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, the counts, the ratios and ``kept``. A narrow map: no shuffle."""

    def run(batches):
        for batch in batches:
            rows = [measured(data) for data in batch.column(1).to_pylist()]
            body = pa.Table.from_pylist(rows, schema=arrow) if rows else arrow.empty_table()
            yield pa.RecordBatch.from_arrays([batch.column(0), *(c.combine_chunks() for c in body.columns)], names=[id_col, *arrow.names])

    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    arrow = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in SCHEMA.split(", ")])
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_or_empty(text_col).cast("binary").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")


def rules_result(docs: DataFrame) -> DataFrame:
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *(F.round(c, 6).alias(c) for c in ("zstd_ratio", "chunk_ratio_min", "chunk_ratio_max")))
