import hashlib

import public_tokenizers
from tokenizers import Tokenizer

from axleyard.llm import bpe, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(texts):
    t = Tokenizer.from_file(PATH)
    t.no_truncation(), t.no_padding()
    out = []
    for x in texts:
        ids = t.encode(x or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    return out


def test_equals_library(sample):
    rows = sample.collect()
    want = sorted((r.doc_id, *e) for r, e in zip(rows, expected([r.text for r in rows])))
    assert sorted(map(tuple, bpe.encoded_digests(sample, PATH).collect())) == want


def test_awkward(awkward, nothing):
    rows = awkward.collect()
    want = sorted(((r.doc_id or -1), *e) for r, e in zip(rows, expected([r.text for r in rows])))
    got = bpe.encoded_digests(awkward, PATH).collect()
    assert sorted((r[0] or -1, *r[1:]) for r in got) == want
    assert bpe.encoded_digests(nothing, PATH).count() == 0


def test_merge_rounds_keep_order():
    b = bpe.WordBpe(PATH)
    t = Tokenizer.from_file(PATH)
    for word in ["aaaaaaaaaaaaaaa", "banana" * 40, "ababababa", "x", "lllllllllllllll", "the" * 99]:
        assert list(b.merged([word.encode()])[0]) == t.encode(word, add_special_tokens=False).ids


def test_counts_and_cache(spark, awkward, nothing, sample, tmp_path):
    cache = f"file://{tmp_path}/cache"
    want = sorted((r.doc_id or -1, e[0]) for r, e in zip(awkward.collect(), expected([r.text for r in awkward.collect()])))
    got = lambda: sorted((r.doc_id or -1, r.n_tokens) for r in token_counts.count_tokens(awkward, PATH, cache).collect())
    assert got() == want
    held = spark.read.parquet(cache).count()
    assert held == spark.read.parquet(cache).select("digest").distinct().count()
    assert got() == want and spark.read.parquet(cache).count() == held  # all found the second time
    assert token_counts.count_tokens(nothing, PATH, cache).count() == 0
    r = token_counts.counts_result(sample, PATH).collect()
    assert all(x.over_limit == (x.n_tokens > 2048) for x in r) and len(r) == sample.count()
    texts = {x.doc_id: x.text for x in sample.collect()}
    assert [x.n_tokens for x in r] == [e[0] for e in expected([texts[x.doc_id] for x in r])]


def test_cached_count_is_used(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    docs = spark.createDataFrame([(1, "hello  world")], "doc_id long, text string")
    token_counts.count_tokens(docs, PATH, cache).collect()
    stored = spark.read.parquet(cache).collect()[0]
    other = f"file://{tmp_path}/other"
    spark.createDataFrame([(stored.tokenizer, bytes(stored.digest), 77)], token_counts.CACHE_SCHEMA).write.parquet(other)
    assert token_counts.count_tokens(docs, PATH, other).first().n_tokens == 77


def test_parts_of_a_query_meet_what_earlier_ones_stored(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(token_counts, "shared_dir", lambda _: f"file://{tmp_path}/cache")
    rows = [(i, f"text number {i % 7}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    once = sorted(map(tuple, token_counts.counts_result(docs, PATH, parts=1).collect()))
    monkeypatch.setattr(token_counts, "shared_dir", lambda _: f"file://{tmp_path}/cache4")
    assert sorted(map(tuple, token_counts.counts_result(docs, PATH, parts=4).collect())) == once and len(once) == 60
    stored = spark.read.parquet(f"file://{tmp_path}/cache4")
    assert not [r for r in once if r[2] is None]
    # every part holds most texts, yet each was encoded and stored once
    assert stored.count() == stored.select("digest").distinct().count() == 7
