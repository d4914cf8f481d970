import random

import numpy as np
import xxhash

from axleyard.llm import simhash
from axleyard.llm.common import Scratch
from axleyard.llm.queries import op12_simhash

from .conftest import frame


def print_of(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def classes(values, distance=2):
    """The smallest index that each value reaches."""
    label = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= distance and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def brute(rows, distance=2):
    fps = [print_of(t) for _, t in rows]
    label = classes(fps, distance)
    low = {}
    for k, (d, _) in zip(label, rows):
        if d is not None:
            low[k] = min(d, low.get(k, d))
    return sorted((d if d is not None else -1, f"{fp:016x}", low.get(k, -1)) for (d, _), fp, k in zip(rows, fps, label))


def got(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id if r.component_id is not None else -1) for r in df.collect())


def texts(rng):
    base = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(1, 120))) for _ in range(12)]
    out = []
    for t in base:
        for _ in range(6):
            w = t.split()
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice("xyz")
            out.append(" ".join(w))
    return out


def test_equals_brute_force(spark, awkward):
    rng = random.Random(3)
    rows = list(enumerate(texts(rng))) + [(500, None), (501, ""), (None, "x y z w"), (502, "X  y\tz w"), (None, "lonely words without id"), (0, "x y"), (503, "x y " * 70_000)]
    rng.shuffle(rows)
    assert got(simhash.simhash_result(frame(spark, rows))) == brute(rows)
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    assert got(simhash.simhash_result(awkward)) == brute(rows)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op12_simhash(spark, sf)) == brute(rows)


def test_dense_balls_at_every_distance_and_block(spark):
    rng = random.Random(5)
    values = set()
    for _ in range(5):
        center = rng.getrandbits(64)
        for _ in range(60):
            x = center
            for _ in range(rng.randrange(7)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    values = sorted(values)
    table = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp long")
    for distance, block in ((0, 50_000), (1, 50_000), (2, 50_000), (2, 2), (3, 3), (1, 1)):
        keep = Scratch(spark)
        edges = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(table, distance, keep, block).collect()]
        label = {v: v for v in values}
        for a, b in edges:
            x, y = sorted((label[a], label[b]))
            label = {k: x if v == y else v for k, v in label.items()}
        want = classes(values, distance)
        assert [values.index(label[v]) for v in values] == want, (distance, block)
        keep.clear()


def test_joined_in_blocks():
    rng = random.Random(9)
    fp = np.array(sorted({rng.getrandbits(12) for _ in range(3000)}), np.uint64)
    at, want = {int(x): k for k, x in enumerate(fp)}, [-1] * len(fp)
    for first in range(len(fp)):
        todo = [first] if want[first] < 0 else []
        while todo:
            k = todo.pop()
            if want[k] < 0:
                want[k] = first
                todo += [at[y] for b in range(12) if (y := int(fp[k]) ^ 1 << b) in at]
    assert simhash.joined(fp, 1).tolist() == want
    few = np.array([1, 2, 4, 1 << 40, (1 << 40) + 7, 1 << 50], np.uint64)
    assert simhash.joined(few, 2).tolist() == classes(few.tolist())


def test_empty_table(spark, nothing):
    assert simhash.simhash_result(nothing).collect() == []
