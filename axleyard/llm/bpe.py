"""BPE encoding and decoding (operator 2): batched numpy merge rounds.

The words of a batch stand in one flat array of symbols. A round looks every adjacent pair up by binary
search in the sorted pair keys, takes each word's lowest rank and merges that pair wherever it stands in
the word, from left to right; words without a pair left are done. A merge only uses symbols that earlier
merges made, so merging all places of the lowest pair at once gives what one merge at a time gives.

Defined results: a null text is an empty one; an empty text has no ids and decodes to ''. Repeated rows
and rows with null or repeated ids are encoded one by one. Of equal pairs in a word the leftmost merges first. A very
long text is encoded whole, some at a time. Columns besides id and text are not read, so their names may clash; an
empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty

#: White space as the tokenizer's patterns see it (Unicode White_Space).
_WS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: str.split() also splits at these, which the tokenizer takes for symbols.
_NOT_WS = re.compile("[\x1c-\x1f]")
_SPLIT = re.compile(f"[^{_WS}]+")
#: Letters that Unicode 16 added, which the tokenizer's library knows. Fixed values.
_NEW_LETTERS = "1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b-1138b 1138e-1138e 11390-113b5 113b7-113b7 113d1-113d1 113d3-113d3 11bc0-11be0 13460-143fa 16100-1611d 16d40-16d6c 18cff-18cff 1e5d0-1e5ed 1e5f0-1e5f0"
_IS_NEW = re.compile("[" + "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in _NEW_LETTERS.split()) + "]")
_COMMON = re.compile("[^\u0250-\U0010ffff]*")
_NONE = 1 << 30


def _byte_chars() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, spare = {b: chr(b) for b in plain}, itertools.count(256)
    return [table.get(b) or chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for a word-end BPE file (NFC, lower case, white space dropped)."""

    def __init__(self, path: str, limit: int = 400_000):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"]
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in [*vocab.items(), *added.items()]:
            self.tokens[i] = token
        self.added = added
        self.added_pattern = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", _WS))
        chars = _byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + end] for c in chars], np.int64)
        self.base = len(self.tokens)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], np.arange(len(keys))[order]
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.limit = limit
        self.cache: dict[str, tuple[int, ...]] = {}

    def merged(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each word (not empty), by merge rounds over all of them at once."""
        if not words:
            return []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths)
        symbols = self.inner[flat]
        symbols[ends - 1] = self.final[flat[ends - 1]]
        owner = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_owner = [], []
        while True:
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            key = symbols[:-1] * self.base + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(len(symbols), _NONE, np.int64)
            hit = (self.keys[at] == key) & (owner[1:] == owner[:-1])
            rank[:-1][hit] = self.ranks[at[hit]]
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(symbols)])
            low = np.repeat(least, sizes)
            over = low == _NONE
            if over.any():
                done_symbols.append(symbols[over])
                done_owner.append(owner[over])
                if over.all():
                    break
                live = ~over
                symbols, owner, rank, low = symbols[live], owner[live], rank[live], low[live]
            at = np.flatnonzero(rank == low)
            # of places that overlap (a pair of equal symbols in a run), every other one from the left
            fresh = np.r_[True, np.diff(at) != 1]
            at = at[(np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))) % 2 == 0]
            symbols = symbols.copy()
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        ids = symbols[order].tolist()
        cuts = np.cumsum(np.bincount(owner, minlength=len(words))).tolist()
        return [tuple(ids[a:b]) for a, b in zip([0, *cuts], cuts)]

    def _chunks(self, text: str) -> list[str]:
        return _SPLIT.findall(text) if _NOT_WS.search(text) else text.split()

    def _pieces(self, low: str) -> list[str]:
        odd = set() if _COMMON.fullmatch(low) else {c for c in low if unicodedata.category(c) == "Cn" and not _IS_NEW.match(c)}
        if not odd:
            return self.pieces.findall(low)
        # code points that Unicode 16 has not assigned are symbols
        shown = "".join("\ue000" if c in odd else c for c in low)
        return [low[m.start() : m.end()] for m in self.pieces.finditer(shown)]

    def _learn(self, chunks: set[str]) -> None:
        """Puts the ids of chunks (runs without white space) into the cache."""
        pieces = {}
        for chunk in chunks:
            # lower case a character at a time: a sigma at a word's end is no special case
            low = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
            pieces[chunk] = self._pieces(low)
        words = list({p for own in pieces.values() for p in own})
        ids = dict(zip(words, self.merged([w.encode("utf-8", "replace") for w in words])))
        for chunk, own in pieces.items():
            self.cache[chunk] = tuple(itertools.chain.from_iterable(map(ids.__getitem__, own)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Special strings in a text become their own ids."""
        if len(self.cache) > self.limit:
            self.cache.clear()
        parts: list[list] = []
        for text in texts:
            found = self.added_pattern.split(text) if self.added_pattern and any(a in text for a in self.added) else [text]
            parts.append([self.added[p] if i % 2 else self._chunks(p) for i, p in enumerate(found)])
        seen: set[str] = set()
        for own in parts:
            for p in own:
                if not isinstance(p, int):
                    seen.update(p)
        self._learn(seen - self.cache.keys())
        get = self.cache.__getitem__
        out = []
        for own in parts:
            streams = [(p,) if isinstance(p, int) else itertools.chain.from_iterable(map(get, p)) for p in own]
            out.append(np.fromiter(itertools.chain.from_iterable(streams), np.int32))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The file names no decoder: the tokens joined by blanks."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordBpe:
    return WordBpe(path)


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 2_000_000) -> DataFrame:
    """One row per row of ``docs``: the id, ``ids`` array<int>, and ``decoded``, the text of those ids.

    A narrow map over the scan: no shuffle; a task holds a slice of about ``slice_bytes`` of text at a time.
    """

    def run(batches):
        bpe = encoder(tokenizer_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices([len(t) for t in texts], slice_bytes):
                ids = bpe.encode(texts[a:b])
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                offsets = np.cumsum([0, *map(len, ids)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(flat, pa.int32())).cast(pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.string())],
                    names=[id_col, "ids", "decoded"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_or_empty(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string")


def encoded_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    e = encode_documents(docs, tokenizer_path)
    return e.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
