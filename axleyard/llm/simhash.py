"""SimHash near-dedup (operator 12): multi-index hashing over the distinct fingerprints.

1. Each text becomes a 64-bit fingerprint: a bit is set if it is set in over half the XXH64 (seed 42) hashes of
   its word shingles, repeats included. From here on distinct fingerprints are rows, so copies cost one row.
2. A fingerprint has two segments of 32 bits. Of two that differ in ``distance`` bits at most, some segment differs
   within a small Hamming ball (for 2: the first in one bit at most, or the second in none). The table of a segment holds
   each fingerprint under its segment, and the ball is enumerated by clearing each set bit: of two segments that
   differ in one bit, one becomes the other so. Entries that meet are verified on all 64 bits where they stand; a
   table place gives a spanning forest of its links, never its pairs.
3. Places that hold more than ``block`` fingerprints are split by the same rule on the halves of the other segment.
4. The links form components; a component's id is the smallest document id in it.

Defined results: texts that are null, empty or only white space have fingerprint zero and are linked like any other;
fewer words than the width are one shingle. A very long text is hashed whole. Rows that repeat an id or have none are
rows of their own; null ids never name a component that has another id. An empty table gives no rows. Other columns
are not read, so their names may clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_or_empty
from .components import _forest, connected_components

_U = np.uint64


def fingerprint(text: bytes, width: int = 3, part: int = 50_000) -> int:
    """The fingerprint of a whole text, counted over ``part`` shingles at a time."""
    words = text.lower().split()
    if not words:
        return 0
    line, n = b" ".join(words), max(len(words) - width + 1, 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1].tolist()
    ends = ends[width - 1 :].tolist() if len(words) >= width else [len(line)]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, part):
        h = np.array([digest(line[a:b], 42) for a, b in zip(starts[k : k + part], ends[k : k + part])], ">u8")
        ones += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _printed(width: int):
    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], _U)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["_ax_id", "fp"])

    return run


def _radii(distance: int) -> tuple[int, int]:
    """Of two halves, the bits that each may differ in so that one of them always holds."""
    if distance not in (0, 1, 2, 3):
        raise ValueError("distance: 0 to 3 bits")
    r, rest = divmod(distance, 2)
    return (r, r if rest else r - 1)


def _ball(segment: np.ndarray, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, place): each segment, and with radius 1 also with each of its set bits cleared."""
    at = np.arange(len(segment))
    if radius < 0:
        return at[:0], segment[:0]
    rows, places = [at], [segment]
    for b in range(bits if radius else 0):
        one = at[(segment >> _U(b) & _U(1)).astype(bool)]
        rows.append(one), places.append(segment[one] & ~_U(1 << b))
    return np.concatenate(rows), np.concatenate(places)


def _placed(distance: int):
    """Fingerprints (fp) -> (place, fp): the places of both tables, the table's number above 32 bits."""

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(_U)
            for k, (radius, segment) in enumerate(zip(_radii(distance), (fp >> _U(32), fp & _U(2**32 - 1)))):
                row, place = _ball(segment, 32, radius)
                yield pa.RecordBatch.from_arrays([pa.array((place | _U(k << 32)).view(np.int64)), pa.array(fp[row].view(np.int64))], names=["place", "fp"])

    return run


def _split(distance: int):
    """(place, fp) of crowded places -> (place, sub, fp): by the halves of the segment that the place leaves open."""

    def run(batches):
        for batch in batches:
            place, fp = (batch.column(c).to_numpy().view(_U) for c in (0, 1))
            other = np.where(place >> _U(32) == 0, fp & _U(2**32 - 1), fp >> _U(32))
            for k, (radius, half) in enumerate(zip(_radii(distance), (other >> _U(16), other & _U(2**16 - 1)))):
                row, sub = _ball(half, 16, radius)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (place[row], sub | _U((k + 1) << 16), fp[row])], names=["place", "sub", "fp"])

    return run


def joined(fp: np.ndarray, distance: int) -> np.ndarray:
    """For each of the fingerprints (uint64), the first that a chain of links within them leads to."""
    label = np.arange(len(fp))
    step = max(1, 2_000_000 // len(fp))
    for a in range(0, len(fp) - 1, step):
        i, j = np.nonzero(np.bitwise_count(fp[a : a + step, None] ^ fp[None, a + 1 :]) <= distance)
        i, j = i + a, j + a + 1
        while (apart := label[i] != label[j]).any():
            i, j = i[apart], j[apart]
            np.minimum.at(label, np.maximum(label[i], label[j]), np.minimum(label[i], label[j]))
            while (label[label] != label).any():
                label = label[label]
    return label


def _linked(distance: int):
    """Rows (place, sub, fp) in order, one partition -> edges (u, v) of a forest of the links within each place."""

    def edges(place, sub, fp):
        cut = np.flatnonzero((np.diff(place) != 0) | (np.diff(sub) != 0)) + 1
        starts, ends = np.r_[0, cut], np.r_[cut, len(place)]
        for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
            label = joined(fp[a:b], distance)
            child = np.flatnonzero(label != np.arange(b - a))
            if len(child):
                yield pa.RecordBatch.from_arrays([pa.array(fp[a:b][x].view(np.int64)) for x in (child, label[child])], names=["u", "v"])

    def found(batches):
        rest = None
        for batch in batches:
            new = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(_U)]
            rest = new if rest is None else [np.concatenate(x) for x in zip(rest, new)]
            if not len(rest[0]):
                continue
            # the last place may go on in the next batch
            last = np.flatnonzero((rest[0] != rest[0][-1]) | (rest[1] != rest[1][-1]))
            end = last[-1] + 1 if len(last) else 0
            if end:
                yield from edges(*(x[:end] for x in rest))
            rest = [x[end:] for x in rest]
        if rest is not None and len(rest[0]):
            yield from edges(*rest)

    def run(batches):
        yield from _forest(1_000_000)(found(batches))

    return run


def links(fps: DataFrame, distance: int, keep: Scratch, block: int = 50_000) -> DataFrame:
    """Edges (a, b) with the same components as all links between the distinct fingerprints ``fps`` (fp)."""
    placed = fps.mapInArrow(_placed(distance), "place long, fp long")
    crowded = keep.written(placed.groupBy("place").count().filter(F.col("count") > block).select("place"))
    whole = placed
    if crowded.limit(1).count():
        split = placed.join(crowded, "place").select("place", "fp").mapInArrow(_split(distance), "place long, sub long, fp long")
        whole = placed.join(crowded, "place", "left_anti").select("place", F.lit(0).cast("long").alias("sub"), "fp").unionByName(split)
    else:
        whole = placed.select("place", F.lit(0).cast("long").alias("sub"), "fp")
    met = whole.repartition("place", "sub").sortWithinPartitions("place", "sub", "fp")
    return keep.written(met.mapInArrow(_linked(distance), "u long, v long").select(F.col("u").alias("a"), F.col("v").alias("b")))


def near_fingerprints(docs: DataFrame, width: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text", block: int = 50_000) -> DataFrame:
    """One row per row of ``docs``: _ax_id, ``fp`` (long) and ``component_id``. ``block`` bounds what is compared in one place; it changes no result."""
    keep = Scratch(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("_ax_id"), text_or_empty(text_col).cast("binary").alias("text"))
    rows = keep.written(texts.mapInArrow(_printed(width), f"_ax_id {kind}, fp long"))
    fps = keep.written(rows.groupBy("fp").agg(F.min("_ax_id").alias("first")))
    labels = connected_components(links(fps.select("fp"), distance, keep, block), keep)
    of = fps.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    lowest = of.groupBy("label").agg(F.min("first").alias("component_id"))
    named = keep.written(of.join(lowest, "label").select("fp", "component_id"))
    out = keep.written(rows.join(named, "fp").select("_ax_id", "fp", "component_id"))
    keep.clear(but=out)
    return out


def simhash_result(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id."""
    return near_fingerprints(docs).select(F.col("_ax_id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
