import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import functions as F

from axleyard.llm import language_model, quality_model, toxicity


def brute_lm(rows, order, mass):
    tokens = lambda t: ["B", *(w.decode() for w in (t or "").encode().lower().split()), "E"]
    c, c2, c3 = Counter(), Counter(), Counter()
    for i, t in rows:
        if zlib.crc32(str(i if i is not None else "").encode()) % 10:
            w = tokens(t)
            c.update(w[1:]), c2.update(zip(w, w[1:])), c3.update(zip(w, w[1:], w[2:]))
    n, v = sum(c.values()), len(c)
    context = c | Counter({"B": c["E"]})
    out = []
    for i, t in rows:
        w, base, score = tokens(t), 0.0, 0.0
        for k in range(1, len(w)):
            p = (c[w[k]] + 0.1) / (n + 0.1 * (v + 1))
            base += math.log10(p)
            if order > 1:
                p = (c2[w[k - 1], w[k]] + mass[0] * p) / (context[w[k - 1]] + mass[0])
            if order > 2 and k > 1:
                p = (c3[w[k - 2], w[k - 1], w[k]] + mass[1] * p) / (c2[w[k - 2], w[k - 1]] + mass[1])
            score += math.log10(p)
        out.append((i if i is not None else -1, len(w) - 1, sum(c[x] > 0 for x in w[1:]), n, base, score))
    return sorted(out)


def test_language_model(awkward, nothing, sample):
    mass = (200.0, 20.0)
    for docs, order, size in ((awkward, 2, 100_000), (sample, 3, 60_000), (sample, 1, 10**9)):
        want = brute_lm([(r.doc_id, r.text) for r in docs.collect()], order, mass)
        got = sorted((r._ax_id if r._ax_id is not None else -1, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in language_model.score_texts(docs, order, mass, size).collect())
        assert [g[:4] for g in got] == [w[:4] for w in want]
        assert np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-9)
    assert language_model.score_result(nothing).count() == 0


def test_keys_are_packed():
    rng = np.random.default_rng(2)
    for n in (0, 1, 1000):
        keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        packed = language_model._packed_keys(keys)
        assert (language_model._unpacked_keys(packed) == keys).all() and (n < 1000 or len(packed) < 7.5 * n)
    for n in (0, 1, 5000):
        counts = (rng.pareto(0.5, n) * 3).astype(np.int64)  # some far beyond a byte
        packed = language_model._packed_counts(counts)
        assert (language_model._unpacked_counts(packed) == counts).all()
    assert (language_model._unpacked_counts(language_model._packed_counts(np.array([255, 254, 0, 256, 1 << 40]))) == [255, 254, 0, 256, 1 << 40]).all()


def test_keys_of_ngrams_have_the_bits_asked_for():
    tokens = language_model.BlockTokens([b"a b c a b", b"", b"c"])
    full, short = tokens.grams(3), tokens.grams(3, 40)
    assert (full[0] == short[0]).all() and (full[0] % 2 == 1).all()
    for a, b in zip(full[1:], short[1:]):
        assert (b % (1 << 24) == 0).all() and ((a == 0) == (b == 0)).all() and (b >> 24 == a >> 24).all()
        assert len(set(a.tolist())) == len(set(b.tolist()))


def test_rows_of_the_exchange(spark):
    # far more shards than n-grams: rows follow the n-grams, and one repeated row spreads over blocks
    rows = spark.createDataFrame([(1, "a b c d e f g h")] * 400, "doc_id long, text string").repartition(8)
    got = language_model.score_texts(rows, 2, block_bytes=16).collect()
    assert len(got) == 400 and len({round(r.score, 9) for r in got}) == 1 and got[0].train_tokens == 3600
    blocks = rows.select((F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(200))).alias("b")).distinct().count()
    assert blocks > 4


def test_shards_sum_up_the_words(spark, sample):
    docs = [(r.doc_id, (r.text or "").encode()) for r in sample.limit(40).collect()]
    train = Counter(w for i, t in docs if zlib.crc32(str(i).encode()) % 10 for w in [*t.lower().split(), b" "])
    blocks = [[d for d in docs if d[0] % 3 == b] for b in range(3)]
    pack = zstandard.ZstdCompressor().compress
    tables = [pa.table({"_ax_block": [b] * len(x), "_ax_id": [i for i, _ in x], "_ax_held": [zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in x], "text": [pack(t) for _, t in x]}) for b, x in enumerate(blocks)]
    asked = pa.concat_tables([language_model._asked(3, 5, 40)(t) for t in tables])
    answers = [language_model._answered(asked.filter(pa.compute.equal(asked["shard"], s))) for s in range(5)]
    assert sum(sum(a["n"].to_pylist()) for a in answers) == sum(train.values())
    assert sum(sum(a["v"].to_pylist()) for a in answers) == len(train)


def test_texts_and_answers_are_exchanged_once(spark):
    df = language_model.score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), block_bytes=600_000)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan") == 1 and plan.count("ReusedExchange") == 2 and plan.count("_answered") == 1


def test_model_beats_base(sample):
    r = [x for x in language_model.score_result(sample).collect() if x.held_out]
    assert r and sum(x.score for x in r) > sum(x.base_score for x in r)


def test_quality(spark, awkward, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality_model.quality_result(docs, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    assert sum(x.kept == (x.quality == 1) for x in got) >= 0.97 * len(got)
    assert quality_model.quality_result(docs, labels).count() == docs.count()
    assert quality_model.quality_result(awkward, labels).count() == awkward.count()
    assert quality_model.quality_result(nothing, labels).count() == 0
    assert all(x.kept for x in quality_model.quality_result(docs.limit(9), labels.limit(0)).collect())
    kept = quality_model.keep_quality(docs, labels, F.col("source"), F.col("lang"))
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_sparse_sites_shrink(spark):
    rows = [("big", "big/a", 0.9)] * 400 + [("big", "big/b", 0.1)] * 400 + [("small", "small/a", 0.0)]
    got = {r._ax_path: r for r in quality_model.site_posteriors(spark.createDataFrame(rows, "_ax_host string, _ax_path string, p double")).collect()}
    assert abs(got["small/a"].parent - 0.5) < 0.3 and got["small/a"].n == 1  # one row moves a host little


def test_posteriors_against_brute_force(spark):
    rng = np.random.default_rng(4)
    docs = [(i, f"w{i} " * int(rng.integers(1, 40)), f"h{i % 3 if i % 7 else 9}", f"p{i % 5}") for i in range(200)] + [(None, None, None, None), (7, "again " * 5, "h1", "p2")]
    frame_ = spark.createDataFrame(docs, "doc_id long, text string, host string, path string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 200, 2)], "doc_id long, quality int")
    got = quality_model.score_quality(frame_, labels, F.col("host"), F.concat_ws("/", F.coalesce("host", F.lit("")), F.coalesce("path", F.lit("")))).collect()
    scored = quality_model.evidence(frame_, quality_model.fit_logistic(*sample_of(frame_, labels)), F.col("host"), F.concat_ws("/", F.coalesce("host", F.lit("")), F.coalesce("path", F.lit("")))).collect()
    p = np.array([r.p for r in scored])
    hosts, paths = ([getattr(r, c) for r in scored] for c in ("_ax_host", "_ax_path"))
    mu = p.mean()

    def strength(groups, mean):
        n, s, ss = (np.array([f(p[[i for i, x in enumerate(groups) if x == g]]) for g in sorted(set(groups))]) for f in (len, np.sum, lambda x: (x * x).sum()))
        centre = np.array([mean[g] for g in sorted(set(groups))])
        spread, noise, m = (n * (s / n - centre) ** 2).sum() / n.sum(), (np.maximum(ss - s * s / n, 0) / n).sum() / n.sum(), centre.mean()
        return min(max(m * (1 - m) / max(spread - noise, 1e-6) - 1, 1.0), 1e4)

    of = lambda groups, g: p[[i for i, x in enumerate(groups) if x == g]]
    k = strength(hosts, dict.fromkeys(hosts, mu))
    parent = {g: (of(hosts, g).sum() + k * mu) / (len(of(hosts, g)) + k) for g in set(hosts)}
    k = strength(paths, {b: parent[a] for a, b in zip(hosts, paths)})
    logit = lambda x: np.log(x / (1 - x))
    want = []
    for i in range(len(p)):
        own = of(paths, paths[i])
        site = (own.sum() - p[i] + k * parent[hosts[i]]) / (len(own) - 1 + k)
        site, q = min(max(site, 1e-4), 1 - 1e-4), min(max(p[i], 1e-6), 1 - 1e-6)
        want.append((p[i], site, 1 / (1 + np.exp(-(logit(q) + logit(site) - logit(mu))))))
    assert np.allclose(sorted(want), sorted((r.p_document, r.p_path, r.score) for r in got), atol=1e-9)


def sample_of(docs, labels):
    rows = quality_model.labelled_sample(docs, labels, 4000, "doc_id", "text", "quality").collect()
    assert len(rows) == 100  # an id that repeats counts once
    return np.array([r.x for r in rows]), np.array([r.y for r in rows])


def test_bad_site_changes_verdicts(spark, sample):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    alone = quality_model.score_quality(docs, labels, F.lit("one"), F.lit("one")).cache()
    middling = [r.doc_id for r in alone.filter("p_document between 0.5 and 0.99").collect()]
    junk = [r.doc_id for r in alone.filter("p_document < 0.1").collect()]
    assert middling and len(junk) > 20
    # one host that holds all junk, and with it some middling documents
    host = F.when(F.col("doc_id").isin(middling + junk), "bad").otherwise("good")
    got = quality_model.score_quality(docs, labels, host, host).filter(F.col("doc_id").isin(middling)).collect()
    assert got and all(r.score < r.p_document for r in got) and sum(r.kept for r in got) < len(got)


def test_network_against_brute_force():
    rng = np.random.default_rng(3)
    net = toxicity.Network({w: i for i, w in enumerate([b"alpha", b"beta", b"gamma"])}, seed=5)
    words = [b"alpha", b"beta", b"gamma", b"delta", b"other"]
    texts = [b"", b"alpha", b" ".join(rng.choice(words, 33)), b" ".join(rng.choice(words, 100))]
    sig = lambda x: 1 / (1 + np.exp(-x))
    h = toxicity.STATE

    def gru(side, xs):
        p, state, out = net.p, np.zeros(h), {}
        for t in range(len(xs)) if side == "f" else reversed(range(len(xs))):
            if xs[t] is not None:
                g, r = xs[t] @ p[f"w{side}"] + p[f"c{side}"], state @ p[f"u{side}"]
                z, reset = sig(g[:h] + r[:h]), sig(g[h : 2 * h] + r[h : 2 * h])
                state = z * state + (1 - z) * np.tanh(g[2 * h :] + reset * r[2 * h :])
            out[t] = state
        return [out[t] for t in range(len(xs))]

    for text, got in zip(texts, net.scores(texts)):
        ws, top = text.split(), -np.inf
        for a in range(0, max(1, len(ws) - 16), 16):
            part = ws[a : a + 32]
            xs = [net.vectors([w])[0].astype(float) for w in part] + [None] * (32 - len(part))
            states = np.concatenate([gru("f", xs), gru("b", xs)], 1)
            e = states @ net.p["att"]
            keep = np.array([x is not None or not part for x in xs])
            a_ = np.where(keep, np.exp(e - e[keep].max()), 0)
            top = max(top, (a_ / a_.sum()) @ states @ net.p["out"] + net.p["bias"][0])
        assert abs(sig(net.scale * top + net.shift) - got) < 1e-5


def test_toxicity_gradients():
    net = toxicity.Network({b"a": 0, b"b": 1})
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    vectors, codes, y = net.vectors([b"a", b"b", b"cc"]).astype(float), np.array([[0, 1], [2, 3], [1, 3]]), np.array([1.0, 0.0])
    grads, of_vectors = net.gradients(codes, vectors, y)
    net.p["vectors"], grads["vectors"] = vectors, of_vectors

    def loss():
        z = net.forward(codes, vectors)[0]
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    # word and character vectors learn through the input vectors
    for k in ("wf", "wb", "uf", "ub", "cf", "cb", "att", "out", "bias", "vectors"):
        flat = net.p[k].reshape(-1)
        for j in range(0, flat.size - (k == "vectors") * vectors.shape[1], 5):
            old = flat[j]
            flat[j] = old + 1e-3
            up = loss()
            flat[j] = old - 1e-3
            down = loss()
            flat[j] = old
            assert abs((up - down) / 2e-3 - grads[k].reshape(-1)[j]) < 2e-5, k


def test_toxicity_held_out(spark, awkward, nothing):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity_result(docs, labels).cache()
    j = got.join(labels, "doc_id").filter("held_out").collect()
    assert sum(x.predicted == x.toxic for x in j) >= 0.93 * len(j)
    assert got.count() == docs.count() and got.filter("score < 0 or score > 1 or score is null").count() == 0
    assert toxicity.toxicity_result(awkward, labels.limit(0)).count() == awkward.count()
    assert toxicity.toxicity_result(nothing, labels).count() == 0


def test_every_word_is_in_a_window():
    for n in (0, 1, 31, 32, 33, 48, 49, 1000):
        s = toxicity.windows_of(n)
        assert {w for a in s for w in range(a, min(n, a + toxicity.WINDOW))} == set(range(n))


def test_the_order_of_words_decides():
    """Two words that are as frequent in either class: only their order tells the classes apart."""

    def planted(seed, n):
        r, texts, y = random.Random(seed), [], []
        for k in range(n):
            words = [f"w{r.randrange(60)}" for _ in range(r.randrange(20, 60))]
            a = r.randrange(len(words) - 2)
            words[a : a + 2] = ["kill", "time"] if k % 3 == 0 else ["time", "kill"]
            texts.append(" ".join(words).encode()), y.append(int(k % 3 == 0))
        return texts, np.array(y)

    held, z = planted(2, 300)
    scores = toxicity.train(*planted(1, 900)).scores(held)
    assert ((scores >= 0.5) == z).mean() > 0.97
