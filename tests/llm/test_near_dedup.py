import random
from collections import defaultdict

import numpy as np

from axleyard.llm import components, near_dedup
from axleyard.llm.common import Scratch

from .conftest import frame


def brute(rows, width, num=80, den=100):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(zip(*(w[i:] for i in range(width)))) if len(w) >= width else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b:
                both = len(a & b)
                if den * both >= num * (len(a) + len(b) - both):
                    parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [x for x in groups[find(i)] if x is not None]
        out.append((d if d is not None else -1, len(sets[i]), min(ids) if ids else -1))
    return sorted(out)


def result(docs, width, **sizes):
    got = near_dedup.near_duplicates(docs, width=width, **sizes).collect()
    assert all(r.kept == (r._ax_id == r.component_id) for r in got)
    return sorted((r._ax_id if r._ax_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in got)


def test_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([3, 12, 60, 200]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 8])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows) + 100, " ".join(copy)))
    rows += [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (None, "one"), (None, "lonely words without an id"), (rows[0][0], rows[0][1]), (rows[0][0], "another text under the same id")]
    assert result(frame(spark, rows), 2) == brute(rows, 2)
    # many tasks with rows at their ends, shuffled joins, regions in blocks
    assert result(frame(spark, rows), 2, task_rows=500, small_rows=0, block=300, task_shingles=2_000) == brute(rows, 2)


def test_large_group_and_nothing(spark, nothing):
    rng = random.Random(6)
    base = [f"x{i}" for i in range(120)]
    rows = []
    for i in range(400):
        copy = list(base)
        copy[rng.randrange(120)] = f"y{i}"
        rows.append((i, " ".join(copy)))
    assert {c for *_, c in result(frame(spark, rows + [(900, "apart from all others here")]), 2)} == {0, 900}
    assert near_dedup.near_result(nothing).count() == 0


def test_keep_one(spark):
    docs = frame(spark, [(1, "a b c d e f g"), (2, "a b c d e f g"), (1, "a b c d e f g"), (3, None), (4, "")])
    kept = near_dedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    want = {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert {r.node: r.label for r in components.connected_components(edges, Scratch(spark)).collect()} == want
    # edges of many tasks, in no order
    spread = edges.orderBy((edges.a * 7919) % 61).repartition(9)
    assert {r.node: r.label for r in components.connected_components(spread, Scratch(spark)).collect()} == want
    few = {r.node: r.label for r in components.connected_components(spread, Scratch(spark), steps=1).collect()}
    assert few.keys() == want.keys() and all(want[x] == want[y] and y <= x for x, y in few.items())


def far_apart(seed):
    rng = random.Random(seed)
    base = [f"z{i}" for i in range(150)]
    rows = []
    for i in range(300):
        copy = list(base)
        for k in rng.sample(range(150), 8):
            copy[k] = f"y{i}_{k}"
        rows.append((i, " ".join(copy)))
        if i % 3 == 0:
            copy[rng.randrange(150)] = f"v{i}"
            rows.append((1000 + i, " ".join(copy)))
    return rows


def test_links_beyond_the_window(spark):
    rows = far_apart(8)
    # a window that finds next to nothing leaves all links to the second search
    for sizes in ({}, {"block": 10_000, "task_shingles": 20_000, "task_rows": 500}):
        got = near_dedup.near_duplicates(frame(spark, rows), width=2, window=1, agree=80, **sizes).collect()
        assert sorted((r._ax_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 2)


def test_joining_pairs_of_a_block_and_of_two():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.choice(60, rng.integers(30, 50), replace=False)).astype(np.uint64) for _ in range(60)]
    starts, flat = np.cumsum([0, *(len(x) for x in sets[:-1])]), np.concatenate(sets)
    near = lambda i, j: 100 * (both := len(np.intersect1d(sets[i], sets[j]))) >= 62 * (len(sets[i]) + len(sets[j]) - both)
    for own in (np.zeros(60, int), np.repeat([0, 3], 30)):
        label = np.sort(np.arange(60) % 25) if own[-1] == 0 else np.r_[np.arange(30), np.arange(30)]
        pairs = [(i, j) for i in range(60) for j in range(i + 1, 60) if label[i] != label[j] and near(i, j) and (own[-1] == 0 or own[i] != own[j])]

        def root(x, parent):
            while parent[x] != x:
                x = parent[x]
            return x

        def classes(links):
            parent = {x: x for x in label.tolist()}
            for i, j in links:
                parent[root(label[i], parent)] = root(label[j], parent)
            return {frozenset(y for y in parent if root(y, parent) == root(x, parent)) for x in parent}

        got = near_dedup.joining(label, own, starts, flat, (62, 100))
        assert set(got) <= set(pairs) and classes(got) == classes(pairs) and len(got) == len(set(label.tolist())) - len(classes(pairs)) and pairs


def test_keep_one_of_null_and_repeated_ids(spark):
    base = [f"q{i}" for i in range(60)]
    docs = frame(spark, [(None, " ".join(base)), (None, " ".join([*base, "end"])), (5, " ".join(x + "z" for x in base)), (5, " ".join([*(x + "z" for x in base), "end"])), (None, None)])
    assert sorted(str(r.doc_id) for r in near_dedup.keep_one_of_each(docs).collect()) == ["5", "None", "None"]


def test_kept_means_the_id_is_the_components(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text + " more"), (2, text + " more"), (3, "something else"), (None, text)]
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in near_dedup.near_result(frame(spark, rows)).collect())
    assert got == [(0, 1, False), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
