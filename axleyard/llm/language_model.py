"""LM scoring (operator 7): a weighted backoff automaton over smoothed n-grams.

The model interpolates n-grams with Dirichlet weights: p(w|h) = (c(hw) + m p(w|h')) / (c(h) + m), down to
the unigram (c(w) + 0.1) / (N + 0.1 (V + 1)). Seen n-grams are arcs, and the failure arc of a state h
weighs m / (c(h) + m), so one left-to-right traversal that follows failure arcs adds up the exact model.

Texts are dealt to blocks of bounded bytes by a hash of id, text and input partition, so that repeated rows spread
too. A block sends its distinct n-grams with its training counts to shards of the n-gram space, one row for each
shard that it has n-grams of, so rows never outnumber n-grams; a shard adds the counts of all blocks up and answers
each block with the totals of what it sent. The block builds the automaton of the n-grams that its own texts can meet
and traverses them all in step. So no task, and not the driver, holds the corpus' model, and what is shuffled grows
with the distinct n-grams per block. Words have 64-bit keys; longer n-grams have as many bits as number the corpus' bytes
and 18 more (63 at most), so that at every size up to 32 TB fewer than one in 250,000 shares its key with another and
has their counts added up; past that, one in 80,000 at 100 TB. Two numbers alone, N and V, are of the whole corpus: each shard
sums up its own words, and the sums of all shards are sent to the blocks with the answers.

Defined results: a null text is an empty one: it holds the end token only. Null ids hash as ''. Each row in
gives one row out, repeated rows too (and each counts as training text). With no training text at all
every token has the weight of an unseen one; an empty table gives no rows. A very long text is a row of its block
and traversed in segments. Other columns are not read, so their names may clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import MIX_A, MIX_B, WordHasher, crc_bucket, mixed, slices, text_or_empty

#: Hashes of the end and begin marks: white space is in no word.
END, BEGIN = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b" ", b"\t"))
ALPHA = 0.1
#: Bits of an n-gram's key beyond those that number the corpus' bytes.
KEY_BITS = 18
_WORDS = WordHasher()
_SEGMENT = 512
_MASK = (1 << 64) - 1


class BlockTokens:
    """The tokens of a block's texts: ``flat`` codes (texts end with the end mark), and the hash of each code."""

    def __init__(self, texts: list[bytes]):
        hashes, lengths = [], []
        for a, b in slices([len(t) for t in texts], 2_000_000):
            for t in texts[a:b]:
                words = t.lower().split()
                hashes += [_WORDS.hashes(words), np.array([END])]
                lengths.append(len(words) + 1)
        self.lengths = np.array(lengths, np.int64)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        stream = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.words, self.flat = np.unique(np.r_[stream, [END, BEGIN]], return_inverse=True)
        self.end, self.begin = self.flat[-2:]
        self.flat = self.flat[:-2]

    def grams(self, order: int, bits: int = 63) -> list[np.ndarray]:
        """For k = 1 to ``order``: the key of the k-gram that ends at each position.

        Words have odd 64-bit keys; longer ones have ``bits`` (at most 63) leading bits, and zeros after them.
        Texts are preceded by a begin mark; k-grams that would reach before it are missing (key 0).
        """
        one = np.uint64(1 << 64 - bits)
        n = len(self.flat)
        back = np.arange(n) - np.repeat(self.starts, self.lengths)
        out = []
        h = self.words[self.flat]
        for k in range(1, order + 1):
            if k > 1:
                prior = np.empty(n, np.uint64)
                d = k - 1
                prior[d:] = self.words[self.flat[:-d]] if n > d else prior[d:]
                prior[back == d - 1] = BEGIN
                h = h + mixed(prior + np.uint64(int(MIX_A) * d & _MASK))
            if k == 1:
                out.append(mixed(h) | np.uint64(1))
            else:
                key = np.maximum(mixed(h + np.uint64(int(MIX_B) * k & _MASK)) & ~(one - np.uint64(1)), one)
                out.append(np.where(back >= k - 2, key, np.uint64(0)))
        return out


def distinct_grams(tokens: BlockTokens, grams: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What ``distinct`` gives for each of ``grams``. Words are numbered already, so only different ones are sorted again."""
    at = np.full(len(tokens.words), -1)
    at[tokens.flat] = np.arange(len(tokens.flat))
    used = at[at >= 0]
    uniq, inverse, first = distinct(grams[0][used])
    place = np.empty(len(at), np.int64)
    place[tokens.flat[used]] = inverse
    return [(uniq, place[tokens.flat], used[first]), *map(distinct, grams[1:])]


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct keys, the place of each key among them, a position of each)."""
    at = np.argsort(keys)
    ordered = keys[at]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    inverse = np.empty(len(keys), np.int64)
    inverse[at] = np.cumsum(new) - 1
    return ordered[new], inverse, at[new]


def _packed_counts(counts: np.ndarray) -> bytes:
    """Counts as single bytes; those of 255 and more follow in full."""
    body = np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.uint64).tobytes()
    return len(counts).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(body)


def _unpacked_counts(data: bytes) -> np.ndarray:
    n, body = int.from_bytes(data[:8], "little"), zstandard.ZstdDecompressor().decompress(data[8:])
    counts = np.frombuffer(body, np.uint8, n).astype(np.uint64)
    counts[counts == 255] = np.frombuffer(body[n:], np.uint64)
    return counts


def _packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences, byte by byte of all: high bytes are zeros."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpacked_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1), dtype=np.uint64)


def _compressed(batches):
    """Texts travel to their block compressed, each by itself."""
    pack = zstandard.ZstdCompressor(level=3, write_checksum=False)
    for batch in batches:
        texts = pa.array([pack.compress(t) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=batch.schema.names)


def _read(table: pa.Table):
    ids, held, texts = (table.column(c).to_pylist() for c in ("_ax_id", "_ax_held", "text"))
    unpack = zstandard.ZstdDecompressor()
    texts = [unpack.decompress(t) for t in texts]
    order = sorted(range(len(texts)), key=lambda i: (texts[i], held[i], str(ids[i])))  # any order of arrival gives the same block
    pick = lambda x: [x[i] for i in order]
    return pick(ids), np.array(pick(held), bool), pick(texts)


def _asked(order: int, shards: int, bits: int):
    """A block -> one row for each shard it has n-grams of: their sorted distinct keys and their counts in its training texts."""

    def run(table: pa.Table) -> pa.Table:
        block = table.column("_ax_block")[0].as_py()
        _, held, texts = _read(table)
        tokens = BlockTokens(texts)
        train = np.repeat(~held, tokens.lengths)
        keys, counts = [], []
        for uniq, inverse, _ in distinct_grams(tokens, tokens.grams(order, bits)):
            n = np.bincount(inverse[train], minlength=len(uniq))
            keys.append(uniq[uniq > 0]), counts.append(n[uniq > 0])
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        at = np.argsort(keys, kind="stable")  # merges sorted runs
        keys, counts = keys[at], counts[at]
        cuts = np.searchsorted(_shard_of(keys, shards), np.arange(shards + 1))
        rows = [(s, block, _packed_keys(keys[a:b]), _packed_counts(counts[a:b])) for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        return pa.table(dict(zip(("shard", "_ax_block", "keys", "counts"), zip(*rows))), pa.schema([("shard", pa.int32()), ("_ax_block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]))

    return run


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _answered(table: pa.Table) -> pa.Table:
    """A shard -> one row for each block: totals in the order of the keys it sent. The first row has the shard's training tokens and how many distinct words they are."""
    keys = [_unpacked_keys(x) for x in table.column("keys").to_pylist()]
    counts = [_unpacked_counts(x) for x in table.column("counts").to_pylist()]
    uniq, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(uniq)).astype(np.int64)
    cuts = np.cumsum([0, *map(len, keys)])
    words = totals[uniq & np.uint64(1) == 1]
    once = lambda x: pa.array([int(x)] + [0] * (len(keys) - 1), pa.int64())
    return pa.table({
        "_ax_block": table.column("_ax_block"), "shard": table.column("shard"), "totals": pa.array([_packed_counts(totals[inverse[a:b]]) for a, b in zip(cuts, cuts[1:])], pa.binary()), "n": once(words.sum()), "v": once(np.count_nonzero(words)),
    })


def _sums(batches):
    """Answers -> their n and v. Whole rows are read, so that the plan reads the answers' one exchange here too."""
    for batch in batches:
        yield batch.select(["n", "v"])


class Automaton:
    """States are contexts; arcs are sorted (state, word) numbers; state 0 is the empty context."""

    def __init__(self, tokens: BlockTokens, order: int, grams: list, totals: list[np.ndarray], n: int, v: int, mass: tuple[float, ...]):
        """``grams``: what ``distinct`` gives for the k-grams at each position, k = 1 to ``order``; ``totals``: the counts of the distinct ones."""
        self.width = len(tokens.words)
        log = np.log10
        w = tokens.flat
        c1 = np.zeros(self.width)
        c1[w[grams[0][2]]] = totals[0]
        p = (c1 + ALPHA) / (n + ALPHA * (v + 1))
        self.unigram, self.count = log(p), c1
        # a word's own state is its code + 1; the begin mark has one too
        self.depth = np.ones(self.width + 1, np.int64)
        self.depth[0] = 0
        context = c1.copy()
        context[tokens.begin] = c1[tokens.end]  # as many texts begin as end
        context[tokens.end] = 0
        self.fail = np.zeros(self.width + 1, np.int64)
        self.fail_weight = np.r_[0.0, log(mass[0] / (context + mass[0]))] if order > 1 else np.zeros(self.width + 1)
        self.next1 = np.arange(self.width) + 1 if order > 1 else np.zeros(self.width, np.int64)
        self.start = tokens.begin + 1 if order > 1 else 0
        self.keys, self.weights, self.next = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        back = np.arange(len(w)) - np.repeat(tokens.starts, tokens.lengths)
        state = np.where(back == 0, self.start, np.r_[0, w[:-1]] + 1) if len(w) else w  # the state before each position
        after = w + 1  # the state after each position
        below = p[w]  # the model's probability one order down, at each position
        held = np.r_[0.0, context]
        for k in range(2, order + 1):
            _, place, first = grams[k - 1]
            total, m = totals[k - 1][place], mass[k - 2]
            seen = totals[k - 1] > 0
            mine = (total + m * below) / (held[state] + m)
            at = first[seen]
            key = state[at] * self.width + w[at]
            self.keys, self.weights = np.r_[self.keys, key], np.r_[self.weights, log(mine[at])]
            if k < order:
                # each seen k-gram is a state; after the end mark no text goes on
                base = len(self.fail)
                self.next = np.r_[self.next, base + np.arange(len(key))]
                self.fail = np.r_[self.fail, w[at] + 1]
                self.fail_weight = np.r_[self.fail_weight, log(mass[k - 1] / (total[at] + mass[k - 1]))]
                held = np.r_[held, total[at]]
                after = np.where(seen[place], base + (np.cumsum(seen) - 1)[place], w + 1)
                state = np.where(back == 0, self.start, np.r_[0, after[:-1]])
                below = mine
            else:
                self.next = np.r_[self.next, after[at]]
        at = np.argsort(self.keys)
        self.keys, self.weights, self.next = self.keys[at], self.weights[at], self.next[at]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weights, next states) of reading ``word`` in ``state``, by failure arcs where no arc fits."""
        weight, after = np.zeros(len(word)), np.empty(len(word), np.int64)
        todo = np.arange(len(word))
        state = state.copy()
        while len(todo):
            s, w = state[todo], word[todo]
            root = s == 0
            hit = root.copy()
            weight[todo[root]] += self.unigram[w[root]]
            after[todo[root]] = self.next1[w[root]]
            if len(self.keys) and not root.all():
                key = s * self.width + w
                by = np.argsort(key)  # in order, neighbours in the table are met together
                at = np.empty(len(key), np.int64)
                at[by] = np.minimum(np.searchsorted(self.keys, key[by]), len(self.keys) - 1)
                arc = (self.keys[at] == key) & ~root
                weight[todo[arc]] += self.weights[at[arc]]
                after[todo[arc]] = self.next[at[arc]]
                hit |= arc
            todo = todo[~hit]
            weight[todo] += self.fail_weight[state[todo]]
            state[todo] = self.fail[state[todo]]
        return weight, after

    def score(self, tokens: BlockTokens, order: int) -> np.ndarray:
        """The log10 probability of each text. Long texts go in segments, each entered in the state that the words before it leave."""
        begin, doc = [], []
        for i, (a, b) in enumerate(zip(tokens.starts.tolist(), tokens.ends.tolist())):
            cuts = range(a, b, _SEGMENT)
            begin += cuts
            doc += [i] * len(cuts)
        begin, doc = np.array(begin, np.int64), np.array(doc, np.int64)
        length = np.minimum(tokens.ends[doc] - begin, _SEGMENT) if len(doc) else begin
        state = np.full(len(begin), self.start)
        inner = begin > tokens.starts[doc] if len(doc) else np.zeros(0, bool)
        state[inner] = 0
        for k in range(order - 1, 0, -1):  # a state is what the last order - 1 words leave
            if inner.any():
                _, state[inner] = self.step(state[inner], tokens.flat[begin[inner] - k])
        by = np.argsort(-length, kind="stable")
        begin, doc, length, state = begin[by], doc[by], length[by], state[by]
        total = np.zeros(len(begin))
        for t in range(int(length[0]) if len(length) else 0):
            m = int(np.searchsorted(-length, -t, "left"))  # the segments that have a token at t
            weight, state[:m] = self.step(state[:m], tokens.flat[begin[:m] + t])
            total[:m] += weight
        return np.bincount(doc, weights=total, minlength=len(tokens.lengths))


def _scored(order: int, mass: tuple[float, ...], bits: int, kind: pa.DataType):
    """(a block's texts, its answers with the corpus' sums) -> scores."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, held, texts = _read(left)
        n, v = (right.column(c)[0].as_py() for c in ("all_n", "all_v"))  # each block has an end token, so an answer
        tokens = BlockTokens(texts)
        grams = distinct_grams(tokens, tokens.grams(order, bits))
        keys = np.concatenate([uniq for uniq, *_ in grams])
        answers = sorted(zip(right.column("shard").to_pylist(), right.column("totals").to_pylist()))
        counts = np.zeros(len(keys))
        at = np.argsort(keys, kind="stable")  # merges sorted runs
        at = at[np.count_nonzero(keys == 0) :]  # n-grams that no shard was asked for come first
        counts[at] = np.concatenate([_unpacked_counts(x) for _, x in answers])
        totals = np.split(counts, np.cumsum([len(uniq) for uniq, *_ in grams])[:-1])
        auto = Automaton(tokens, order, grams, totals, n, v, mass)
        per = lambda x: np.add.reduceat(x, tokens.starts) if len(tokens.starts) else x[:0]
        base = per(auto.unigram[tokens.flat])
        known = per((auto.count[tokens.flat] > 0).astype(np.int64))
        return pa.table({
            "_ax_id": pa.array(ids, kind), "held_out": pa.array(held), "n_tokens": pa.array(tokens.lengths), "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(ids), n)), "base_score": pa.array(base), "score": pa.array(auto.score(tokens, order)),
        })

    return run


def score_texts(docs: DataFrame, order: int = 3, mass: tuple[float, ...] = (200.0, 20.0), block_bytes: int = 5_000_000, id_col: str = "doc_id", text_col: str = "text", hold_out: int = 10) -> DataFrame:
    """One row per row of ``docs``: _ax_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    ``order`` is 1 to 3; ``mass`` are the Dirichlet weights of orders 2 and 3. Blocks and shards follow the
    corpus' bytes, so a task's share stays the same at any size.
    """
    text = text_or_empty(text_col).cast("binary")
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first().b
    blocks = max(1, math.ceil(size / block_bytes))
    bits = min(63, max(1, size).bit_length() + KEY_BITS)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.spark_partition_id()), F.lit(blocks)).alias("_ax_block"), F.col(id_col).alias("_ax_id"), (crc_bucket(id_col, hold_out) == 0).alias("_ax_held"), text.alias("text"))
    packed = rows.mapInArrow(_compressed, f"_ax_block long, _ax_id {kind}, _ax_held boolean, text binary")
    asked = packed.groupBy("_ax_block").applyInArrow(_asked(order, blocks, bits), "shard int, _ax_block long, keys binary, counts binary")
    answers = asked.groupBy("shard").applyInArrow(_answered, "_ax_block long, shard int, totals binary, n long, v long").repartition("_ax_block")
    sums = answers.mapInArrow(_sums, "n long, v long").agg(F.sum("n").alias("all_n"), F.sum("v").alias("all_v"))
    told = answers.crossJoin(F.broadcast(sums))
    schema = f"_ax_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return packed.groupBy("_ax_block").cogroup(told.groupBy("_ax_block")).applyInArrow(_scored(order, mass, bits, to_arrow_type(docs.schema[id_col].dataType)), schema)


def score_result(docs: DataFrame) -> DataFrame:
    return score_texts(docs).select(F.col("_ax_id").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"))
