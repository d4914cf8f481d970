"""Phrase collocation mining (operator 11): count streams in prefix and in suffix order, merged in lockstep.

1. Words are counted per language. A fixed-size bitmap of the words with ``least`` occurrences tells tasks which
   positions can belong to a phrase: a phrase with that many consists of words with as many. Bits that collide only
   let more through; counts are of the words themselves.
2. Pairs are counted at such positions. Where both pairs of three words have a fifth of ``least`` occurrences, triples are
   counted by a hash, which bounds their counts from above; where all triples of a phrase may have ``least``, phrases of 3 to
   ``longest`` words are counted. Both steps go by bitmaps of fixed size. (Pairs much rarer than ``least`` still let
   triples through, since near that count the number of pairs grows far faster than the text does.)
   Phrases with ``least`` occurrences and the words form one stream of counts.
3. The stream is sorted twice, by words from the front (prefix order) and from the back (suffix order). In
   either order a phrase follows its own beginnings (ends), so one pass with a stack of at most ``longest`` open
   entries reads all orders in lockstep: what is open when a phrase comes are its left (right) parts, and what it
   is pushed upon learns of an extension. The stream is split by range; entries that are open where a range begins
   are carried into it, so no key need fit one task. The two orders meet in a merge join.
4. Every cut is scored in exact decimals; the lowest counts. A phrase goes if a longer candidate around it has
   ``share`` percent of its occurrences. Its extensions by one word decide that: what is longer still is no more frequent.

Defined results: null texts are empty, a null language is 'und'. Repeated rows and ids count each time. Empty
tables give no rows. A text is cut at its piece ends while it is read, so only a piece must fit memory.
Other columns are not read, so their names may clash.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MIX_A, Scratch, mixed, text_or_empty

#: A-Z to a-z, piece ends to a line feed, tab to a blank.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
#: Stands between pieces; no byte of UTF-8.
_END = b"\xff"
_U = np.uint64


class _Hasher(dict):
    """word -> XXH64 with seed 42, as Spark's xxhash64 has it (signed there); 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word, 42) or 1
        return value

    def hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self) > 200_000:
            self.clear()
        self[_END] = 0
        return np.fromiter(map(self.__getitem__, words), _U, len(words))


_HASHER = _Hasher()


def _slices(batches, most: int = 1_000_000):
    """Batches (lang, text) -> (lang, words with _END between pieces): about ``most`` bytes each, cut between pieces."""
    for batch in (b.slice(k, 500) for b in batches for k in range(0, b.num_rows, 500)):
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(langs, texts):
            by.setdefault(lang, []).append(text)
        for lang, own in by.items():
            text = b"\n".join(own).translate(_PLAIN)
            at = 0
            while at < len(text):
                end = text.rfind(b"\n", at, at + most) + 1 if len(text) - at > most else len(text)
                end = end or (text.find(b"\n", at) + 1) or len(text)
                words = text[at:end].replace(b"\n", b" \xff ").split()
                if words:
                    yield lang, words
                at = end


def _counted(counts: dict[str, Counter], name: str):
    """A batch (lang, name, c) of all counters, which are emptied."""
    rows = [(lang, own) for lang, own in counts.items() if own]
    langs = pa.array([lang for lang, own in rows for _ in range(len(own))], pa.string())
    out = pa.RecordBatch.from_arrays([langs, pa.array([w for _, own in rows for w in own], pa.binary()), pa.array([c for _, own in rows for c in own.values()], pa.int64())], names=["lang", name, "c"])
    counts.clear()
    return out


def _sliced(batch: pa.RecordBatch, rows: int = 50_000):
    """Small batches: Spark holds each whole, outside its heap."""
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def _word_counts(limit: int = 200_000):
    """(lang, text) -> (lang, word, c); the empty word counts all words of the language."""

    def run(batches):
        counts: dict[str, Counter] = {}
        for lang, words in _slices(batches):
            own = counts.setdefault(lang, Counter())
            own.update(words)
            own[b""] += len(words) - own.pop(_END, 0)
            if sum(map(len, counts.values())) > limit:
                yield from _sliced(_counted(counts, "word"))
        yield from _sliced(_counted(counts, "word"))

    return run


def _lang_hash(lang: str) -> np.uint64:
    return _U(xxhash.xxh64_intdigest(lang.encode(), 42))


def _has(bitmap: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = key & _U(64 * len(bitmap) - 1)
    return (bitmap[(at >> _U(6)).astype(np.int64)] >> (at & _U(63)) & _U(1)).astype(bool)


def _keys(lang: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(a key for each word, whether it is one)."""
    h = _HASHER.hashes(words)
    return h ^ _lang_hash(lang), h != 0


def _pairs(lang: str, words: list[bytes], bitmap: np.ndarray) -> np.ndarray:
    """Where two words in a row, in one piece, may both be frequent."""
    key, ok = _keys(lang, words)
    ok &= _has(bitmap, key)
    return ok[:-1] & ok[1:]


def _grams(lang: str, words: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where ``size`` words in a row are in one piece, and a key of 40 bits of each."""
    key, ok = _keys(lang, words)
    n = max(len(words) - size + 1, 0)
    ok, out, all_ = ok[:n].copy(), key[:n].copy(), ok
    for j in range(1, size):
        ok &= all_[j : j + n]
        out *= MIX_A
        out += key[j : j + n]
    at = np.flatnonzero(ok)
    return at, mixed(out[at]) >> _U(24)


def _pair_counts(frequent, limit: int = 400_000):
    """(lang, text) -> (lang, phrase, c): pairs of words that may be frequent."""

    def run(batches):
        bitmap = np.frombuffer(frequent.value, _U)
        counts: dict[str, Counter] = {}
        for lang, words in _slices(batches):
            own = counts.setdefault(lang, Counter())
            own.update([words[i] + b" " + words[i + 1] for i in np.flatnonzero(_pairs(lang, words, bitmap)).tolist()])
            if sum(map(len, counts.values())) > limit:
                yield from _sliced(_counted(counts, "phrase"))
        yield from _sliced(_counted(counts, "phrase"))

    return run


def _pair_keys(batches):
    """Pairs (lang, phrase) -> (key)."""
    for batch in batches:
        keys = [_grams(lang, phrase.split(b" "), 2)[1] for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*keys, np.empty(0, _U)]).view(np.int64))], names=["key"])


def _triple_counts(pairs, limit: int = 1_000_000):
    """(lang, text) -> (key, c): hashed triples both of whose pairs may be frequent."""

    def out(keys):
        key, count = np.unique(np.concatenate(keys), return_counts=True)
        keys.clear()
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count.astype(np.int32))], names=["key", "c"])

    def run(batches):
        bitmap, keys = np.frombuffer(pairs.value, _U), []
        for lang, words in _slices(batches):
            two = np.zeros(len(words), bool)
            at, key = _grams(lang, words, 2)
            two[at] = _has(bitmap, key)
            at, key = _grams(lang, words, 3)
            keys.append(key[two[at] & two[at + 1]])
            if sum(map(len, keys)) > limit:
                yield from _sliced(out(keys))
        if keys:
            yield from _sliced(out(keys))

    return run


def _long_counts(triples, longest: int, limit: int = 200_000):
    """(lang, text) -> (lang, phrase, c): phrases of 3 to ``longest`` words all of whose triples may be frequent."""

    def run(batches):
        bitmap = np.frombuffer(triples.value, _U)
        counts: dict[str, Counter] = {}
        for lang, words in _slices(batches):
            all_ = np.zeros(len(words), bool)
            at, key = _grams(lang, words, 3)
            all_[at] = _has(bitmap, key)
            here, own = all_, counts.setdefault(lang, Counter())
            for k in range(3, longest + 1):
                if k > 3:
                    here = here[:-1] & all_[k - 3 :]
                own.update([b" ".join(words[i : i + k]) for i in np.flatnonzero(here).tolist()])
            if sum(map(len, counts.values())) > limit:
                yield from _sliced(_counted(counts, "phrase"))
        yield from _sliced(_counted(counts, "phrase"))

    return run


def bitmap_of(keys: DataFrame, bits: int):
    """A bitmap of 2**bits bits with those of ``keys`` (key) set, on the driver and sent to all tasks: its size is fixed, whatever the keys."""
    at = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    bit = F.expr("shiftleft(1L, cast(key & 63 as int))")
    cells = keys.select(F.shiftright(at, 6).cast("int").alias("cell"), bit.alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[cells.column("cell").to_numpy()] = cells.column("bit").to_numpy()
    return keys.sparkSession.sparkContext.broadcast(out.tobytes())


def _lockstep():
    """Rows (pid, lang, words, f, carried) in order -> (lang, words, f, parts, longer): counts of the entry's proper beginnings, and the largest count of an entry one word longer.

    Carried entries give only what they learn here of longer ones.
    """

    def run(batches):
        open_: list[list] = []  # words, f, counts of beginnings, largest longer count or None, carried
        rows: list[tuple] = []
        at = None

        def close(depth: int):
            while len(open_) > depth:
                words, f, parts, longer, carried = open_.pop()
                if open_:
                    open_[-1][3] = max(f, open_[-1][3] or 0)
                if not carried:
                    rows.append((at[1], words, f, parts, longer))
                elif longer is not None:
                    rows.append((at[1], words, None, None, longer))

        def out():
            cols = list(zip(*rows)) or [()] * 5
            rows.clear()
            kinds = (pa.string(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.int64()), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["lang", "words", "f", "parts", "longer"])

        for batch in batches:
            for pid, lang, words, f, carried in zip(*(c.to_pylist() for c in batch.columns)):
                if (pid, lang) != at:
                    close(0)
                    at = pid, lang
                depth = 0
                while depth < len(open_) and len(words) > depth + 1 and open_[depth][0] == words[: depth + 1]:
                    depth += 1
                close(depth)
                open_.append([words, f, [x[1] for x in open_], None, carried])
            yield out()
        close(0)
        yield out()

    return run


def in_order(stream: DataFrame, keep: Scratch, range_rows: int = 100_000) -> DataFrame:
    """(lang, words, f, parts, longer) of each entry of ``stream`` (lang, words, f), which holds all beginnings of its entries: see _lockstep.

    Ranges of about ``range_rows`` entries; where one begins inside an entry's extensions, that entry is carried into it.
    """
    ranges = math.ceil(stream.count() / range_rows) or 1
    placed = keep.written(stream.repartitionByRange(ranges, "lang", "words").select("lang", "words", "f", F.spark_partition_id().alias("pid")))
    # a few rows for each range: its first entry's beginnings
    first = placed.groupBy("pid").agg(F.min(F.struct("lang", "words")).alias("s")).select("pid", "s.lang", "s.words")
    starts = first.filter(F.size("words") > 1).select("pid", "lang", F.explode(F.expr("transform(sequence(1, size(words) - 1), i -> slice(words, 1, i))")).alias("words"))
    # told, as the stream compresses so well that it seems small enough to be sent whole
    carried = stream.join(F.broadcast(starts), ["lang", "words"]).select("pid", "lang", "words", "f", F.lit(True).alias("carried"))
    both = placed.select("pid", "lang", "words", "f", F.lit(False).alias("carried")).unionByName(carried)
    # the beginnings of a range's first entry lie before the range, so no entry is in it twice
    rows = both.repartition(ranges, "pid").sortWithinPartitions("pid", "lang", "words")
    out = rows.mapInArrow(_lockstep(), "lang string, words array<string>, f long, parts array<long>, longer long")
    return out.groupBy("lang", "words").agg(F.max("f").alias("f"), F.max("parts").alias("parts"), F.max("longer").alias("longer"))


def _score(a: Column, n: Column, l: Column, r: Column) -> Column:
    d = lambda c, digits=18: c.cast(f"decimal({digits},0)")
    # products stay below 38 digits up to 10**17 words
    return F.call_function("div", d(a) * d(n) * d(F.lit(1000), 4), d(l) * d(r))


def phrase_counts(docs: DataFrame, keep: Scratch, least: int = 100, longest: int = 5, bits: int = 27, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(words, phrases): (lang, word, f) with the empty word for all words of a language, and (lang, phrase, f) of 2 to ``longest`` words; f is ``least`` at least."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text_col).cast("binary").alias("text"))
    counted = texts.mapInArrow(_word_counts(), "lang string, word binary, c long")
    words = counted.groupBy("lang", F.col("word").cast("string").alias("word")).agg(F.sum("c").alias("f"))
    words = keep.written(words.filter((F.col("f") >= least) | (F.col("word") == "")))
    key = F.xxhash64("word").bitwiseXOR(F.xxhash64("lang")).alias("key")
    frequent = bitmap_of(words.filter("word <> ''").select(key), bits)
    kind = "lang string, phrase binary, c long"
    # tasks have summed what they could: no second sum before the exchange, which would only hold memory
    short = texts.mapInArrow(_pair_counts(frequent), kind).repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("c").alias("f"))
    short = keep.written(short.filter(F.col("f") >= max(least // 5, 1)))
    pairs = bitmap_of(short.select("lang", "phrase").mapInArrow(_pair_keys, "key long"), bits)
    counted = texts.mapInArrow(_triple_counts(pairs), "key long, c int").repartition("key").groupBy("key").agg(F.sum("c").alias("f"))
    triples = bitmap_of(counted.filter(F.col("f") >= least).select("key"), bits)
    long = texts.mapInArrow(_long_counts(triples, longest), kind).groupBy("lang", "phrase").agg(F.sum("c").alias("f"))
    phrases = keep.written(short.unionByName(long).filter(F.col("f") >= least))
    for sent in (frequent, pairs, triples):
        sent.destroy()
    return words, phrases.select("lang", F.col("phrase").cast("string").alias("phrase"), "f")


def collocations(
    docs: DataFrame, least: int = 100, longest: int = 5, share: int = 100, top: int = 2000, bits: int = 27, text_col: str = "text", lang_col: str = "lang", range_rows: int = 100_000, salts: int = 64,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language by their lowest-scoring cut.

    ``share``: a phrase goes if a longer candidate around it has this percentage of its occurrences. ``bits`` sizes the
    two bitmaps (16 MB each with 27), ``range_rows`` and ``salts`` the tasks; none of the three changes a result.
    """
    keep = Scratch(docs.sparkSession)
    words, phrases = phrase_counts(docs, keep, least, longest, bits, text_col, lang_col)
    total = words.filter("word = ''").select("lang", F.col("f").alias("n"))
    entries = words.filter("word <> ''").select("lang", F.array("word").alias("words"), "f").unionByName(phrases.select("lang", F.split("phrase", " ").alias("words"), "f"))
    front = in_order(entries, keep, range_rows)
    back = in_order(entries.withColumn("words", F.reverse("words")), keep, range_rows)
    front = front.filter(F.size("words") > 1).select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), F.col("parts").alias("left"), F.col("longer").alias("after"))
    back = back.filter(F.size("words") > 1).select("lang", F.array_join(F.reverse("words"), " ").alias("phrase"), F.col("parts").alias("right"), F.col("longer").alias("before"))
    both = front.join(back.hint("merge"), ["lang", "phrase"]).join(total, "lang")
    return _ranked(both, keep, share, top, salts)


def _ranked(both: DataFrame, keep: Scratch, share: int, top: int, salts: int) -> DataFrame:
    longer = F.greatest("after", "before")
    alone = both.filter(longer.isNull() | (100 * longer < share * F.col("a")))
    l, r = (lambda k: F.element_at("left", k)), (lambda k: F.element_at("right", F.size("right") - k + 1))
    cuts = F.transform(F.sequence(F.lit(1), F.size("left")), lambda k: F.struct(_score(F.col("a"), F.col("n"), l(k), r(k)).alias("score"), k.alias("k"), l(k).alias("l"), r(k).alias("r")))
    scored = alone.withColumn("cut", F.array_min(cuts)).select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first of each language are among the first of its parts
    part = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    first = part.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("_rank") <= top).drop("_rank", "_part")
    out = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    out = keep.written(out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    keep.clear(but=out)
    return out


#: The same rows in DuckDB, from all phrases of all documents.
SQL = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
  w AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
  g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 6) t(k) WHERE len(ws) >= k),
  f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100), n AS MATERIALIZED (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
  c AS MATERIALIZED (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
  longer AS (SELECT lang, phrase, max(a) AS m FROM (SELECT lang, array_to_string(ws[1:k - 1], ' ') AS phrase, a FROM c UNION ALL SELECT lang, array_to_string(ws[2:k], ' '), a FROM c) x GROUP BY ALL),
  cuts AS (SELECT c.lang, c.phrase, c.a, j, x.a AS l, y.a AS r, n.n, (1000::hugeint * c.a * n.n) // (x.a::hugeint * y.a) AS score FROM c, range(1, 5) t(j), f x, f y, n
    WHERE j < c.k AND n.lang = c.lang AND x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:j], ' ') AND y.lang = c.lang AND y.phrase = array_to_string(c.ws[j + 1:c.k], ' ')),
  best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, cast(n AS bigint) AS n, cast(score AS bigint) AS score FROM best LEFT JOIN longer USING (lang, phrase) WHERE m IS NULL OR m < a
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000"""
