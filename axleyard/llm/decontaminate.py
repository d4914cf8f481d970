"""Benchmark decontamination (operator 10): BM25 over test items with block-max WAND.

Test items are indexed with BM25 impacts, each divided by the item's score against itself, so one
threshold serves items of any length. Every training text is cut into overlapping passages long enough
to hold the longest item whole; each passage is a query and all items at or above the threshold are
retrieved. A hit is verified on the words themselves: either most of the item's 5-word shingles are in the
passage, or all of its words but one in ten stand in it in their order (a changed word takes five shingles with it);
and most of its answer's words (the item's last sentence) are there too.

Before the cursors of a passage move, the sums of its terms' block maxima are held against the threshold
for all passages of a text at once: where no block reaches it there is no pivot, whatever the cursors do.

Items are indexed in blocks of bounded bytes. A benchmark that fits one block takes one narrow pass over the
texts. More blocks take a pass each, which writes its hits alone before the next block's index is made, so the driver
and the tasks hold one block's index at a time; the hits then meet the rows again. Document frequencies are of all items.

Defined results: null and empty texts hold nothing; null or empty items, and items whose words are all
punctuation, match nothing; an item with a null id is found like any other and reported as null; items that repeat a
text are all reported. Item ids may be of any type. Items shorter than a shingle are one shingle. Each row in gives one
row out, whatever its id, repeated rows too. A very long text is searched whole, passage by passage. A share equal to its
limit counts. Other columns pass through, whatever their names (names that begin with ``_ax_`` are the library's own).
An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .common import text_key, written

K1, B = 1.2, 0.75
#: Items in a block of the index.
BLOCK = 8
_PUNCT = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256)).lower()


def words_of(data: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words of letters, digits and bytes beyond ASCII."""
    return data.translate(_PUNCT).split()


def shingles(words: list[bytes], width: int = 5) -> set:
    return set(zip(*(words[i:] for i in range(width)))) if len(words) >= width else {tuple(words)} if words else set()


def answer_of(data: bytes) -> bytes:
    """The last sentence or line of an item that has several; none otherwise."""
    parts = [p for p in re.split(rb"(?<=[.?!])\s+|\n", data.strip()) if p.strip()]
    return parts[-1] if len(parts) > 1 else b""


def in_order(item: list[bytes], words: list[bytes]) -> int:
    """The length of the longest common subsequence of two word lists: one number holds a bit for each word of ``item``."""
    where: dict[bytes, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in words:
        hit = row & where.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


def changed(item: list[bytes], words: list[bytes], every: int = 10) -> bool:
    """Whether some stretch of ``words`` holds ``item`` in order with at most one word in ``every`` changed, left out or put in."""
    spare = len(item) // every
    if not spare or len(words) < len(item) - spare:
        return False
    own = set(item)
    inside = np.cumsum(np.r_[0, np.fromiter((w in own for w in words), np.int64, len(words))])
    span = min(len(words), len(item) + spare)
    fits = inside[span:] - inside[:-span] >= len(item) - spare
    at = np.flatnonzero(fits)
    # stretches next to one another are tried as one
    for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else ():
        for a in run[:: max(1, spare)].tolist():
            if in_order(item, words[a : a + span + spare]) >= len(item) - spare:
                return True
    return False


class ItemIndex:
    """Inverted index of a block of items with normalised impacts and block maxima."""

    def __init__(self, items: list[tuple[object, bytes]], df: dict[bytes, int], total: int, average: float):
        self.ids, self.words, self.shingles, self.answers, lengths, weights = [], [], [], [], [], []
        for item_id, data in items:
            words = words_of(data)
            if not words:
                continue
            tf: dict[bytes, int] = {}
            for w in words:
                tf[w] = tf.get(w, 0) + 1
            norm = K1 * (1 - B + B * len(words) / average)
            own = {w: math.log(1 + (total - df[w] + 0.5) / (df[w] + 0.5)) * n * (K1 + 1) / (n + norm) for w, n in tf.items()}
            full = sum(own.values())
            weights.append({w: x / full for w, x in own.items()})
            self.ids.append(item_id), self.words.append(words), self.shingles.append(shingles(words)), self.answers.append(words_of(answer_of(data))), lengths.append(len(words))
        self.longest = max(lengths, default=1)
        self.terms: dict[bytes, int] = {}
        postings: list[list[tuple[int, float]]] = []
        for at, own in enumerate(weights):
            for w, x in own.items():
                postings.append([]) if self.terms.setdefault(w, len(self.terms)) == len(postings) else None
                postings[self.terms[w]].append((at, x))
        self.docs = [[at for at, _ in p] for p in postings]
        self.impacts = [[x for _, x in p] for p in postings]
        # block maxima: for each term the blocks of items it occurs in and its greatest impact there
        self.blocks, self.maxima = [], []
        for docs, impacts in zip(self.docs, self.impacts):
            best: dict[int, float] = {}
            for at, x in zip(docs, impacts):
                best[at // BLOCK] = max(x, best.get(at // BLOCK, 0.0))
            self.blocks.append(np.fromiter(best, np.int64)), self.maxima.append(np.fromiter(best.values(), np.float64))
        self.n_blocks = len(self.ids) // BLOCK + 1
        # the same as rows of a table, with one column for each of up to 64 runs of blocks; the last row is a word of no item
        self.run = -(-self.n_blocks // 64)
        self.table = np.zeros((len(self.docs) + 1, -(-self.n_blocks // self.run)))
        for t, (blocks, maxima) in enumerate(zip(self.blocks, self.maxima)):
            np.maximum.at(self.table[t], blocks // self.run, maxima)

    def retrieve(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All (item position, score) with a score of at least ``threshold``: block-max WAND over the distinct ``terms``.

        Blocks whose maxima do not add up to the threshold are skipped whole; in the others the cursors move
        by the maxima of that block.
        """
        slack = threshold - 1e-9
        if not terms:
            return []
        bounds = np.bincount(np.concatenate([self.blocks[t] for t in terms]), np.concatenate([self.maxima[t] for t in terms]), self.n_blocks)
        found: list[tuple[int, float]] = []
        for block in np.flatnonzero(bounds >= slack).tolist():
            self._in_block(block, terms, slack, found)
        return found

    def _in_block(self, block: int, terms: list[int], slack: float, found: list) -> None:
        first, end = block * BLOCK, (block + 1) * BLOCK
        cursors = []  # [item, position in the term's postings, term, greatest impact in the block]
        for t in terms:
            docs = self.docs[t]
            at = bisect_left(docs, first)
            if at < len(docs) and docs[at] < end:
                cursors.append([docs[at], at, t, float(self.maxima[t][np.searchsorted(self.blocks[t], block)])])
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += c[3]
                if bound >= slack:
                    pivot = i
                    break
            if pivot < 0:
                return
            item = cursors[pivot][0]
            if cursors[0][0] == item:
                score = sum(self.impacts[c[2]][c[1]] for c in cursors if c[0] == item)
                if score >= slack:
                    found.append((item, score))
                item += 1
            live = []
            for c in cursors:
                docs, at = self.docs[c[2]], c[1]
                while at < len(docs) and docs[at] < item:
                    at += 1
                if at < len(docs) and docs[at] < end:
                    c[0], c[1] = docs[at], at
                    live.append(c)
            cursors = live

    def leaks(self, data: bytes, threshold: float, item_share: float, answer_share: float) -> dict:
        """item id -> greatest share of its shingles in one passage, of the items that are verified."""
        words = words_of(data)
        if not words or not self.ids:
            return {}
        width, stride = len(self.terms), self.longest
        codes = np.fromiter(map(self.terms.get, words, repeat(width)), np.int64, len(words))
        # passage k holds the words from k * stride on, two strides long; one number for each passage and distinct term
        last = max(0, -(-len(words) // stride) - 2)
        at = np.flatnonzero(codes < width)
        if not len(at):
            return {}
        own, code = at // stride, codes[at]
        both = np.unique(np.r_[np.minimum(own, last) * width + code, (own[own > 0] - 1) * width + code[own > 0]])
        passages, terms_of = both // width, both % width
        cuts = np.flatnonzero(np.r_[True, passages[1:] != passages[:-1]])
        bounds = np.add.reduceat(self.table[terms_of], cuts).max(1)
        cuts = np.r_[cuts, len(both)]
        out: dict[int, float] = {}
        for p in np.flatnonzero(bounds >= threshold - 1e-6).tolist():
            a = int(passages[cuts[p]]) * stride
            b = a + 2 * stride
            terms = terms_of[cuts[p] : cuts[p + 1]].tolist()
            passage = None
            for at, _ in self.retrieve(terms, threshold):
                passage = passage or shingles(words[a:b])
                own = self.shingles[at]
                if len(next(iter(own))) < 5:  # a short item: its words in a row
                    k = len(next(iter(own)))
                    share = float(next(iter(own)) in shingles(words[a:b], k))
                else:
                    share = len(own & passage) / len(own)
                answer = self.answers[at]
                there = set(words[a:b])
                if sum(w in there for w in answer) >= answer_share * len(answer) and (share >= item_share or changed(self.words[at], words[a:b])):
                    out[self.ids[at]] = max(share, out.get(self.ids[at], 0.0))
        return out


def item_blocks(items: DataFrame, block_bytes: int, id_col: str, text_col: str):
    """The number of blocks, then an index for each. Blocks are hashes of id and text, about ``block_bytes`` each."""
    clean = items.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("data"))
    tokens = clean.select("id", "data", F.split(F.trim(F.regexp_replace(F.translate(F.col("data").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), " ").alias("w")).filter("w[0] <> ''")
    size = clean.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("b")).first().b
    total, average = tokens.agg(F.count("*"), F.avg(F.size("w"))).first()
    blocks = max(1, math.ceil(size / block_bytes))
    yield blocks
    df = tokens.select(F.explode(F.array_distinct("w")).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    which = F.pmod(F.xxhash64("id", "data"), F.lit(blocks))
    for k in range(blocks):
        own = clean.filter(which == k)
        terms = tokens.filter(which == k).select(F.explode("w").alias("w")).distinct().join(df, "w")
        yield ItemIndex([(r.id, bytes(r.data)) for r in own.orderBy("id", "data").collect()], {r.w.encode(): r.df for r in terms.collect()}, total, average or 1.0)


def _searched(at: int, held, kind: pa.DataType, threshold: float, item_share: float, answer_share: float, hits_only: bool):
    """Batches with a text in column ``at`` -> the same with the items found and the best share at their end; ``hits_only``: rows that hold an item, without the text."""

    def run(batches):
        for batch in batches:
            found = [held.value.leaks(t or b"", threshold, item_share, answer_share) for t in batch.column(at).cast(pa.binary()).to_pylist()]
            ids = pa.array([sorted(f, key=lambda x: (x is None, x)) for f in found], pa.list_(kind))
            shares = pa.array([max(f.values(), default=0.0) for f in found], pa.float64())
            names = [n for n in batch.schema.names if not (hits_only and n == batch.schema.names[at])]
            out = pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), ids, shares], names=[*names, "_ax_items", "_ax_share"])
            yield out.filter(pa.array([bool(f) for f in found], pa.bool_())) if hits_only else out

    return run


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.6, item_share: float = 0.7, answer_share: float = 0.7, block_bytes: int = 16_000_000, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` with ``_ax_items`` (sorted array of item ids) and ``_ax_share`` double, all their columns kept."""
    spark = docs.sparkSession
    of_item = items.schema[item_id_col].dataType
    limits = to_arrow_type(of_item), threshold, item_share, answer_share
    parts = item_blocks(items, block_bytes, item_id_col, item_text_col)
    added = [StructField("_ax_items", ArrayType(of_item)), StructField("_ax_share", DoubleType())]
    if next(parts) == 1:
        held = spark.sparkContext.broadcast(next(parts))  # at most block_bytes of item text
        return docs.mapInArrow(_searched(docs.columns.index(text_col), held, *limits, False), StructType([*docs.schema.fields, *added]))
    hits = None
    rows = docs.select(F.col(id_col).alias("_ax_id"), text_key(text_col).alias("_ax_key"), text_col)
    for index in parts:
        held = spark.sparkContext.broadcast(index)
        got = written(rows.mapInArrow(_searched(2, held, *limits, True), StructType([*rows.schema.fields[:2], *added])))
        hits = got if hits is None else hits.unionByName(got)
        held.destroy()
    hits = hits.groupBy("_ax_id", "_ax_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_ax_items")))).alias("_ax_items"), F.max("_ax_share").alias("_ax_share"))
    keyed = docs.withColumn("_ax_row", F.col(id_col)).withColumn("_ax_text", text_key(text_col))
    joined = keyed.join(hits, keyed["_ax_row"].eqNullSafe(hits["_ax_id"]) & (keyed["_ax_text"] == hits["_ax_key"]), "left")
    none = F.array().cast(ArrayType(of_item))
    return joined.withColumn("_ax_items", F.coalesce("_ax_items", none)).withColumn("_ax_share", F.coalesce("_ax_share", F.lit(0.0))).drop("_ax_row", "_ax_text", "_ax_id", "_ax_key")


def leak_result(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids, best_share, kept of every row."""
    found = find_leaks(docs.select("doc_id", "text"), items)
    hit = F.size("_ax_items") > 0
    return found.select("doc_id", hit.alias("contaminated"), F.size("_ax_items").cast("long").alias("n_items"), F.col("_ax_items").alias("item_ids"), F.round("_ax_share", 6).alias("best_share"), (~hit).alias("kept"))


def keep_clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their own columns."""
    return find_leaks(docs, items, **options).filter(F.size("_ax_items") == 0).drop("_ax_items", "_ax_share")
