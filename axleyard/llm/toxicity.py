"""Toxicity (operator 8): a bidirectional gated recurrent network with attention pooling.

A word's input is its own vector (words seen in enough training texts; others have none) beside the mean
vector of its character trigrams. Two gated recurrent layers read each window from both ends, attention
pools their states, and the pooled state is scored. Windows of ``WINDOW`` words start every ``STRIDE``
words, so all of a text is scored and every word but the outer ones twice; a text's score is a logistic
function of its highest window.

The network is trained here, in numpy, on at most ``max_train_rows`` labelled rows of at most
``max_train_bytes`` each (both are parameters), by windows: each training text takes part with its
highest-scoring windows, chosen anew every round; labels that the network comes to contradict firmly are left out of a round. All texts are scored whole.

Defined results: a null text is an empty one; an empty text is one window of padding. Each row in gives one
row out, whatever its id; null ids hash as ''. A very long text is scored whole, by 4,096 windows at a time; a score
of exactly 0.5 is predicted toxic. Other columns are not read, so their names may clash; an empty table gives no rows. Without training rows of both labels every score is the
share of label 1 (0 where there are none). Labels that are null or belong to no row are not used.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, slices, text_or_empty

WINDOW, STRIDE = 32, 16
WORD_DIM, CHAR_DIM, STATE = 6, 6, 6
CHAR_BUCKETS = 1 << 14
_F = np.float32
_SPACED = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256)).lower()


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_SPACED).split()


def trigram_buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(flat bucket numbers, start of each word) of the byte trigrams of <word>."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    flat = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    code = flat[:-2] * np.uint32(0x9E3779B1) + flat[1:-1] * np.uint32(0x85EBCA6B) + flat[2:] * np.uint32(0xC2B2AE35)
    code ^= code >> np.uint32(15)
    bucket = (code * np.uint32(0x2C1B3C6D) >> np.uint32(18)).astype(np.int64)
    ends = np.cumsum(lengths)
    keep = np.ones(len(flat), bool)
    keep[ends - 1] = keep[ends - 2] = False
    return bucket[keep[: len(bucket)]], np.r_[0, np.cumsum(lengths - 2)[:-1]]


def windows_of(n: int) -> np.ndarray:
    """Starts of the windows over ``n`` words; the last window reaches the end."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """The parameters by name, and what reads them."""

    def __init__(self, vocab: dict[bytes, int], seed: int = 7):
        r = np.random.default_rng(seed)
        self.vocab = vocab
        d, h = WORD_DIM + CHAR_DIM, STATE
        init = lambda *shape, s=0.3: r.normal(0, s, shape).astype(_F)
        # the last word vector is that of all unknown words; it stays zero
        self.p = {"word": init(len(vocab) + 1, WORD_DIM, s=0.1), "char": init(CHAR_BUCKETS, CHAR_DIM, s=0.05), "att": init(2 * h), "out": init(2 * h), "bias": np.zeros(1, _F)}
        self.p["word"][-1] = 0
        for side in "fb":
            self.p |= {f"w{side}": init(d, 3 * h), f"u{side}": init(h, 3 * h), f"c{side}": np.zeros(3 * h, _F)}
        self.scale, self.shift = 1.0, 0.0

    def vectors(self, words: list[bytes]) -> np.ndarray:
        """Input vectors of distinct words, and a last one, zero, for padding."""
        out = np.zeros((len(words) + 1, WORD_DIM + CHAR_DIM), _F)
        if words:
            get, unknown = self.vocab.get, len(self.vocab)
            out[:-1, :WORD_DIM] = self.p["word"][np.fromiter((get(w, unknown) for w in words), np.int64, len(words))]
            buckets, starts = trigram_buckets(words)
            counts = np.diff(np.r_[starts, len(buckets)])
            out[:-1, WORD_DIM:] = np.add.reduceat(self.p["char"][buckets], starts) / counts[:, None]
        return out

    def _read(self, side: str, gates: np.ndarray, codes: np.ndarray, pad: int, keep: bool):
        """States (T, B, h) of one direction; ``gates``: input part of the three gates for each distinct word."""
        h, u = STATE, self.p[f"u{side}"]
        steps = range(len(codes)) if side == "f" else range(len(codes) - 1, -1, -1)
        state = np.zeros((codes.shape[1], h), _F)
        states, saved = np.empty((*codes.shape, h), _F), {}
        for t in steps:
            g, r = gates[codes[t]], state @ u
            zr = _sigmoid(g[:, : 2 * h] + r[:, : 2 * h])
            z, reset, inner = zr[:, :h], zr[:, h:], r[:, 2 * h :]
            new = np.tanh(g[:, 2 * h :] + reset * inner)
            z = np.where((codes[t] == pad)[:, None], _F(1), z)
            if keep:
                saved[t] = (state, z, reset, inner, new)
            state = new + z * (state - new)
            states[t] = state
        return states, saved

    def forward(self, codes: np.ndarray, vectors: np.ndarray, keep: bool = False):
        """Logits of windows: ``codes`` (T, B) into ``vectors``, whose last row is padding."""
        pad = len(vectors) - 1
        sides = {s: self._read(s, vectors @ self.p[f"w{s}"] + self.p[f"c{s}"], codes, pad, keep) for s in "fb"}
        states = np.concatenate([sides["f"][0], sides["b"][0]], 2)
        e = states @ self.p["att"]
        e[(codes == pad) & (codes != pad).any(0)] = -1e9
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tb,tbh->bh", a, states)
        return pooled @ self.p["out"] + self.p["bias"][0], (sides, states, a, pooled)

    def gradients(self, codes, vectors, y):
        """Gradients of the mean logistic loss: of the parameters, and of ``vectors``."""
        h, pad = STATE, len(vectors) - 1
        logit, (sides, states, a, pooled) = self.forward(codes, vectors, True)
        d = ((1 / (1 + np.exp(-logit)) - y) / len(y)).astype(_F)
        g = {"out": pooled.T @ d, "bias": np.array([d.sum()], _F)}
        d_pooled = d[:, None] * self.p["out"]
        d_a = np.einsum("tbh,bh->tb", states, d_pooled)
        d_e = a * (d_a - (a * d_a).sum(0))
        g["att"] = np.einsum("tb,tbh->h", d_e, states)
        d_states = a[:, :, None] * d_pooled + d_e[:, :, None] * self.p["att"]
        d_vectors = np.zeros_like(vectors)
        for k, side in enumerate("fb"):
            w, u = self.p[f"w{side}"], self.p[f"u{side}"]
            saved, d_out = sides[side][1], d_states[:, :, k * h : (k + 1) * h]
            g_u, d_gates = np.zeros_like(u), np.zeros((len(vectors), 3 * h), _F)
            carry = np.zeros_like(d_pooled[:, :h])
            for t in reversed(list(saved)):
                state, z, reset, inner, new = saved[t]
                d_h = d_out[t] + carry
                d_new = d_h * (1 - z) * (1 - new * new)
                live = (codes[t] != pad)[:, None]
                d_z = np.where(live, d_h * (state - new) * z * (1 - z), 0)
                d_r = d_new * inner * reset * (1 - reset)
                d_in = np.concatenate([d_z, d_r, d_new], 1)
                d_rec = np.concatenate([d_z, d_r, d_new * reset], 1)
                g_u += state.T @ d_rec
                carry = d_h * z + d_rec @ u.T
                np.add.at(d_gates, codes[t], d_in)
            d_gates[pad] = 0
            g |= {f"u{side}": g_u, f"w{side}": vectors.T @ d_gates, f"c{side}": d_gates.sum(0)}
            d_vectors += d_gates @ w.T
        return g, d_vectors

    def window_logits(self, texts: list[bytes]) -> list[np.ndarray]:
        """The logits of all windows of each text."""
        index: dict[bytes, int] = {}
        streams = [np.fromiter((index.setdefault(w, len(index)) for w in words_of(t)), np.int64) for t in texts]
        vectors = self.vectors(list(index))
        pad = len(index)
        starts = [windows_of(len(s)) for s in streams]
        offsets = np.cumsum([0, *(len(s) + WINDOW for s in streams)])
        flat = np.full(int(offsets[-1]), pad, np.int64)
        for s, o in zip(streams, offsets):
            flat[o : o + len(s)] = s
        at = np.concatenate([x + o for x, o in zip(starts, offsets)]) if texts else np.zeros(0, np.int64)
        logits = np.empty(len(at), _F)
        for a in range(0, len(at), 4096):
            logits[a : a + 4096] = self.forward(flat[at[a : a + 4096] + np.arange(WINDOW)[:, None]], vectors)[0]
        return np.split(logits, np.cumsum([len(x) for x in starts])[:-1]) if texts else []

    def scores(self, texts: list[bytes]) -> np.ndarray:
        top = np.array([x.max() for x in self.window_logits(texts)], np.float64)
        return 1 / (1 + np.exp(-np.clip(self.scale * top + self.shift, -30, 30)))


def train(texts: list[bytes], y: np.ndarray, rounds: int = 12, batch: int = 64, rate: float = 0.02, min_texts: int = 4, seed: int = 7) -> Network:
    """Fits a network: Adam on each text's highest-scoring windows; the last step fits the logistic of the highest window."""
    rng = np.random.default_rng(seed)
    token_lists = [words_of(t) for t in texts]
    df = [Counter(w for t, label in zip(token_lists, y) if label == k for w in set(t)) for k in (0, 1)]
    words = sorted(w for w in df[0] | df[1] if df[0][w] + df[1][w] >= min_texts)
    net = Network({w: i for i, w in enumerate(words)}, seed)
    n0, n1 = max(1, int((y == 0).sum())), max(1, int((y == 1).sum()))
    odds = np.array([math.log((df[1][w] + 0.5) / (n1 + 1)) - math.log((df[0][w] + 0.5) / (n0 + 1)) for w in words] + [0.0])
    net.p["word"][:, 0] += 0.2 * odds.astype(_F)
    net.p["word"][-1] = 0
    index: dict[bytes, int] = {}
    streams = [np.array([index.setdefault(w, len(index)) for w in t], np.int64) for t in token_lists]
    names = list(index)
    pad = len(names)
    buckets, starts = trigram_buckets(names)
    counts = np.diff(np.r_[starts, len(buckets)])
    of_word = np.array([net.vocab.get(w, len(words)) for w in names], np.int64)
    own_odds = np.r_[odds[of_word], 0.0]
    padded = [np.r_[s, np.full(WINDOW, pad)] for s in streams]
    spans = [windows_of(len(s)) for s in streams]
    cut = lambda i, a: padded[i][a : a + WINDOW]
    lexical = [np.array([own_odds[cut(i, a)].max() for a in spans[i]]) for i in range(len(texts))]
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    for round_ in range(rounds):
        score = lexical if round_ < 3 else net.window_logits(texts)
        # after a start, labels that the network firmly contradicts are left out: some labels are wrong
        doubt = [round_ >= 3 and abs(x.max()) > 2 and (x.max() > 0) != bool(label) for x, label in zip(score, y)]
        picks = [(i, int(spans[i][k]), y[i]) for i in range(len(texts)) if not doubt[i] for k in {int(score[i].argmax()), int(rng.integers(len(spans[i]))) if not y[i] else int(score[i].argmax())}]
        rng.shuffle(picks)
        lr = rate * (1 - 0.9 * round_ / rounds)
        for a in range(0, len(picks), batch):
            part = picks[a : a + batch]
            grid = np.array([cut(i, s) for i, s, _ in part]).T
            used, codes = np.unique(np.r_[grid.ravel(), pad], return_inverse=True)
            vectors = np.zeros((len(used), WORD_DIM + CHAR_DIM), _F)
            real = used[:-1]
            vectors[:-1, :WORD_DIM] = net.p["word"][of_word[real]]
            flat = np.concatenate([buckets[starts[w] : starts[w] + counts[w]] for w in real]) if len(real) else np.zeros(0, np.int64)
            first = np.r_[0, np.cumsum(counts[real])[:-1]]
            if len(real):
                vectors[:-1, WORD_DIM:] = np.add.reduceat(net.p["char"][flat], first) / counts[real][:, None]
            g, d_vectors = net.gradients(codes[:-1].reshape(grid.shape), vectors, np.array([label for *_, label in part], _F))
            g["word"], g["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
            np.add.at(g["word"], of_word[real], d_vectors[:-1, :WORD_DIM])
            g["word"][-1] = 0
            np.add.at(g["char"], flat, np.repeat(d_vectors[:-1, WORD_DIM:] / counts[real][:, None], counts[real], axis=0))
            step += 1
            for k, v in net.p.items():
                m, s = moment[k]
                grad = np.clip(g[k], -1, 1) + (1e-5 * v if k in ("word", "char") else 0)
                m += 0.1 * (grad - m)
                s += 0.01 * (grad * grad - s)
                v -= lr * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    top = np.array([x.max() for x in net.window_logits(texts)], np.float64)
    z, w = np.c_[top, np.ones(len(top))], np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.clip(np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag([0.1, 0.01]), z.T @ (y - p) - np.array([0.1, 0.01]) * (w - [1, 0])), -2, 2)
    net.scale, net.shift = float(w[0]), float(w[1])
    return net


def training_rows(docs: DataFrame, labels: DataFrame, max_train_rows: int, max_train_bytes: int, id_col: str, text_col: str, label_col: str, hold_out: int) -> DataFrame:
    """(text, y): up to half of ``max_train_rows`` of each label, by a hash of the id, without the held-out bucket."""
    usable = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (crc_bucket(id_col, hold_out) != 0)).select(F.col(id_col).alias("_ax_id"), F.col(label_col).cast("int").alias("y"))
    part = lambda k: usable.filter(F.col("y") == k).orderBy(F.xxhash64("_ax_id"), "_ax_id").limit(max_train_rows // 2)
    some = part(0).unionByName(part(1))
    texts = docs.filter(F.octet_length(text_or_empty(text_col)) <= max_train_bytes).select(F.col(id_col).alias("_ax_id"), text_or_empty(text_col).cast("binary").alias("text"))
    # at most max_train_rows rows of two numbers; of rows that repeat an id the least text
    return texts.join(F.broadcast(some), "_ax_id").groupBy("_ax_id", "y").agg(F.min("text").alias("text"))


def score_toxicity(docs: DataFrame, labels: DataFrame, max_train_rows: int = 2400, max_train_bytes: int = 8_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", hold_out: int = 5) -> DataFrame:
    """One row per row of ``docs``: the id, ``held_out`` and ``score``. The score reads the text alone."""
    rows = sorted(training_rows(docs, labels, max_train_rows, max_train_bytes, id_col, text_col, label_col, hold_out).collect(), key=lambda r: (r._ax_id, bytes(r.text), r.y))
    y = np.array([r.y for r in rows])
    net = train([bytes(r.text) for r in rows], y) if len(y) and 0 < y.sum() < len(y) else None
    share = float(y.mean()) if len(y) else 0.0
    held = docs.sparkSession.sparkContext.broadcast(net)  # bounded by the training rows

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            scores = np.full(len(texts), share)
            if held.value:
                for a, b in slices([len(t) for t in texts], 1_000_000):
                    scores[a:b] = held.value.scores(texts[a:b])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores)], names=[id_col, "held_out", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, (crc_bucket(id_col, hold_out) == 0).alias("held_out"), text_or_empty(text_col).cast("binary").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double")


def toxicity_result(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    s = score_toxicity(docs, labels)
    return s.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
