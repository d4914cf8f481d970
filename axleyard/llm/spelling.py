"""Spelling variant grouping (operator 13): permuterm rotations.

1. Words are counted: maximal runs of letters of whole texts, A-Z in lower case; a run whose CRC with its document's id
   says so loses a letter first.
2. Every word, marked with a terminator, is rotated to each of its places, and all rotations are sorted. A rotation's last
   character is the one an edit may touch: rotations that share all but it are replacements of each other, and the one
   that ends there is the word without that character. A scan with a stack of open prefixes reads these groups off
   the order. A group has at most one rotation for each letter of the alphabet; for each of its words the scan gives
   the number of near words and the most frequent one, so no pairs are written.
3. Rotations are dealt to tasks by range of their beginning. How long that beginning is depends on the length of the shared
   prefix alone (half of it at least), so a group is always in one task, and common beginnings of long words spread.
4. Words of more than ``longest`` letters would have more letters in rotations than is sensible; the groups of their rotations are found by
   a 128-bit digest of the shared prefix instead.
5. A word's form is its most frequent near word, where that is frequent enough; forms are followed by doubling.

A pair that differs by one inserted letter is in a group for every letter of a run of equal ones; only the first of the
run counts. Two words that differ by a replacement share one group.

Defined results: null and empty texts have no words; a null id counts as the text ''. Rows that repeat an id count each
time. A very long text or word is read whole. An empty table gives no rows. Other columns are not read, so their names may clash.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_or_empty

END = "$"
NEAR = "word string, near long, best_n long, best string"


def _word_counts(least_length: int, every: int, limit: int = 300_000):
    """(id as text, text) -> (word, n): see 1."""
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{least_length},}}").findall
    crc = zlib.crc32

    def out(counts):
        batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        counts.clear()
        return batch

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = crc(f"{doc}:".encode())
                words = runs(text.lower().decode())
                for k, word in enumerate(words):
                    h = crc(word.encode(), at)
                    if h % every == 0:
                        i = h % len(word)
                        words[k] = word[:i] + word[i + 1 :]
                counts.update(words)
                if len(counts) > limit:
                    yield out(counts)
        yield out(counts)

    return run


def _scan():
    """Rows (tier, rot, n, longer, ends) in order, one partition -> NEAR: for each word of each group, its near words there.

    ``longer``: the rotation counts for the group of all but its last character; ``ends``: for the group that ends with it.
    """

    def run(batches):
        open_: list[tuple[str, list]] = []  # prefix, [(rotation, n), ...]; the word that ends there first
        rows: list[tuple] = []
        tier = None

        def word(rot: str) -> str:
            i = rot.index(END)
            return rot[i + 1 :] + rot[:i]

        def close():
            prefix, members = open_.pop()
            if len(members) < 2:
                return
            named = [(n, word(rot), len(rot) == len(prefix)) for rot, n in members]
            again = [not ended and rot[-1] == prefix[-1] for (rot, _), (_, _, ended) in zip(members, named)]
            best = sorted(named, key=lambda m: (-m[0], m[1]))
            for (n, w, ended), repeats in zip(named, again):
                # the shorter word is near those that do not repeat the letter before
                skip = {x[1] for x, r in zip(named, again) if r} if ended else {x[1] for x in named if x[2]} if repeats else ()
                near = len(members) - 1 - len(skip)
                if near:
                    top = next(b for b in best if b[1] != w and b[1] not in skip)
                    rows.append((w, near, top[0], top[1]))

        def out():
            cols = list(zip(*rows)) or [()] * 4
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "near", "best_n", "best"])

        for batch in batches:
            for t, rot, n, longer, ends in zip(*(c.to_pylist() for c in batch.columns)):
                if t != tier:
                    tier = t
                    while open_:
                        close()
                while open_ and not rot.startswith(open_[-1][0]):
                    close()
                if longer:
                    if not (open_ and len(open_[-1][0]) == len(rot) - 1):
                        open_.append((rot[:-1], []))
                    open_[-1][1].append((rot, n))
                if ends:
                    open_.append((rot, [(rot, n)]))
            yield out()
        while open_:
            close()
        yield out()

    return run


def _digests(longest: int):
    """Long words (word, n) -> (key, wid, n, last, plain): key is a digest of each shared prefix; last is null for the word that ends there; plain: it does not repeat the letter before."""

    def run(batches):
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ring, size, wid = (word + END).encode("utf-32-le") * 2, len(word), digest(word.encode())
                for a in range(0, size + 1, 10_000):
                    at = range(a, min(a + 10_000, size + 1))
                    keys = [digest(ring[4 * i : 4 * (i + size + 1)]) for i in at]
                    last, plain = [None] * len(keys), [True] * len(keys)
                    if size > longest:
                        skips = [i for i in at if i < size]
                        keys += [digest(ring[4 * (i + 1) : 4 * (i + 1 + size)]) for i in skips]
                        last += [ord(word[i]) for i in skips]
                        plain += [i == 0 or word[i] != word[i - 1] for i in skips]
                    m = len(keys)
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([wid] * m, pa.binary()), pa.array([n] * m, pa.int64()), pa.array(last, pa.int32()), pa.array(plain, pa.bool_())], names=["key", "wid", "n", "last", "plain"])

    return run


def _near_long(words: DataFrame, longest: int, keep: Scratch) -> DataFrame | None:
    """NEAR of the groups whose shared prefix is longer than ``longest``; a group has one word for each letter at most."""
    own = keep.written(words.filter(F.length("word") >= longest))
    if not own.limit(1).count():
        return None
    rows = own.select("word", "n").mapInArrow(_digests(longest), "key binary, wid binary, n long, last int, plain boolean")
    groups = rows.groupBy("key").agg(F.collect_list(F.struct("n", "wid", "last", "plain")).alias("all")).filter(F.size("all") > 1)
    one = groups.select(F.explode("all").alias("m"), "all")
    other = lambda x: (x["wid"] != F.col("m.wid")) & ((x["last"].isNotNull() | F.col("m.plain")) & (F.col("m.last").isNotNull() | x["plain"]))
    met = one.select("m.wid", F.explode(F.filter("all", other)).alias("x")).select("wid", F.col("x.n").alias("n"), F.col("x.wid").alias("best_wid"))
    names = keep.written(own.select("word").mapInArrow(_named, "wid binary, word string"))
    met = met.join(names, "wid").join(names.select(F.col("wid").alias("best_wid"), F.col("word").alias("best")), "best_wid")
    return met.select("word", F.lit(1).cast("long").alias("near"), F.col("n").alias("best_n"), "best")


def _named(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(w.encode()) for w in batch.column(0).to_pylist()], pa.binary()), batch.column(0)], names=["wid", "word"])


def _tiers(least: int, longest: int) -> list[int]:
    """Lengths of shared prefixes from which on a longer beginning deals rotations out: each about a third above the one before."""
    tiers = [least]
    while tiers[-1] < longest:
        tiers.append(4 * tiers[-1] // 3 + 1)
    return tiers


def _tier(length: str, tiers: list[int]) -> str:
    """SQL: the largest tier up to ``length``."""
    return "CASE " + " ".join(f"WHEN {length} >= {t} THEN {t}" for t in reversed(tiers)) + " END"


def near_words(words: DataFrame, keep: Scratch, least_length: int = 7, longest: int = 64, task_rows: int = 200_000) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n) that have near ones: how many, and the most frequent (ties: the smallest)."""
    size = words.filter(F.length("word") <= longest)
    total = size.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    marked = size.select("n", F.length("word").alias("size"), F.concat("word", F.lit(END)).alias("marked"))
    rotated = marked.select("n", "size", F.explode(F.transform(F.sequence(F.lit(0), F.col("size")), lambda i: F.concat(F.substring(F.col("marked"), i + 1, F.col("size") + 1), F.substring(F.col("marked"), F.lit(1), i)))).alias("rot"))
    tiers = _tiers(least_length, longest)
    longer, ends = F.expr(_tier("size", tiers)), F.expr(_tier("size + 1", tiers))
    last = ~F.endswith("rot", F.lit(END))
    # where the two groups of a rotation are dealt by different lengths it goes to both places
    role = lambda tier, a, b: F.struct(tier.cast("int").alias("tier"), a.alias("longer"), b.alias("ends"))
    no, yes = F.lit(False), F.lit(True)
    roles = F.when(longer == ends, F.array(role(longer, last, yes))).when(last, F.array(role(longer, yes, no), role(ends, no, yes))).otherwise(F.array(role(ends, no, yes)))
    rows = rotated.select("rot", "n", F.explode(roles).alias("role")).select("role.tier", "rot", "n", "role.longer", "role.ends")
    parts = math.ceil(total / task_rows) or 1
    dealt = rows.repartitionByRange(parts, "tier", F.expr("substring(rot, 1, tier)")).sortWithinPartitions("tier", "rot")
    near = dealt.mapInArrow(_scan(), NEAR)
    far = _near_long(words, longest, keep)
    near = near if far is None else near.unionByName(far)
    first = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("top")
    return near.groupBy("word").agg(F.sum("near").alias("n_near"), first).select("word", "n_near", (-F.col("top.n")).alias("best_n"), F.col("top.word").alias("best"))


def followed(forms: DataFrame, keep: Scratch) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last. Each round doubles the steps; forms grow more frequent, so they end."""
    at = keep.written(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at_ = keep.written(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = at_.select("word", "root")
        if not at_.filter("moved").limit(1).count():
            return at


def variants(docs: DataFrame, least_length: int = 7, least: int = 2, ratio: int = 10, every: int = 31, longest: int = 64, id_col: str = "doc_id", text_col: str = "text", task_rows: int = 200_000) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``least_length`` letters and ``least`` occurrences.

    A form is ``ratio`` times as frequent as its word. One run in ``every`` loses a letter. ``longest`` and ``task_rows`` size the work; they change no result.
    """
    keep = Scratch(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    counted = texts.mapInArrow(_word_counts(least_length, every), "word string, n long")
    counts = counted.groupBy("word").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) & (F.length("word") >= least_length))
    words = keep.written(counts)
    near = words.join(near_words(words, keep, least_length, longest, task_rows), "word", "left")
    near = keep.written(near.withColumn("form", F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best"))))
    root = followed(near.filter("form IS NOT NULL"), keep)
    out = near.join(root, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("form").isNotNull(), F.col("best_n")).alias("form_n")
    )
    out = keep.written(out)
    keep.clear(but=out)
    return out


def variants_result(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n."""
    return variants(docs)
