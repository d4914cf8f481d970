import random

import corpus_pipeline
from axleyard.llm import decontaminate

from .conftest import frame


def brute_leaks(docs, items, share=0.7):
    out = []
    for d, text in docs:
        words = decontaminate.words_of((text or "").encode())
        have = decontaminate.shingles(words)
        hits = []
        for i, item in items:
            own = decontaminate.shingles(decontaminate.words_of((item or "").encode()))
            if own and len(next(iter(own))) < 5:
                k = len(next(iter(own)))
                hits += [i] if own <= decontaminate.shingles(words, k) and len(words) >= k else []
            elif own and len(own & have) >= share * len(own):
                hits.append(i)
        out.append((d if d is not None else -1, sorted(hits)))
    return sorted(out, key=str)


def test_against_brute_force(spark, awkward, nothing):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, f"{say(20)}. {say(10)}.") for i in range(60)] + [(100, "odd three words"), (101, None), (102, "..."), (103, "")]
    docs = [(i, say(rng.choice([5, 100, 700]))) for i in range(80)]
    for k in range(0, 40, 2):
        t = docs[k][1].split()
        at = rng.randrange(len(t))
        docs[k] = (k, " ".join(t[:at] + [items[k][1].upper()] + t[at:]))
    docs += [(500, "here odd, three words!"), (501, None), (502, ""), (None, items[3][1])]
    frame_items = spark.createDataFrame(items, "item_id long, text string")
    for size in (16_000_000, 3_000):  # one block of items, several blocks
        got = decontaminate.find_leaks(frame(spark, docs), frame_items, block_bytes=size).collect()
        assert sorted(((r.doc_id if r.doc_id is not None else -1, r._ax_items) for r in got), key=str) == brute_leaks(docs, items)
    assert decontaminate.leak_result(awkward, frame_items).count() == awkward.count()
    assert decontaminate.leak_result(nothing, frame_items).count() == 0
    assert decontaminate.keep_clean(awkward, frame_items.limit(0)).count() == awkward.count()


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], old + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_words_in_order():
    rng = random.Random(11)
    for _ in range(300):
        a, b = ([rng.choice(b"a b c d e f".split()) for _ in range(rng.randrange(0, 30))] for _ in range(2))
        assert decontaminate.in_order(a, b) == lcs(a, b)


def test_items_with_changed_words(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(500)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    items, docs = [], []
    for i, n in enumerate([12, 15, 20, 25, 30, 37, 60] * 3):
        item = say(n)
        items.append((f"set-{i}", " ".join(item)))
        for k, changes in enumerate((0, 1, 2)):
            if changes <= n // 10:
                copy = list(item)
                for at in rng.sample(range(n), changes):
                    copy[at] = f"other{at}"
                docs.append((10 * i + k, " ".join(say(40) + copy + say(30))))
        docs.append((10 * i + 9, " ".join(say(30) + item[: n // 2] + say(30))))  # half of it is no leak
    items.append((None, "an item without any id of its own that counts too"))
    docs.append((9999, "here an item without any id of its own that counts too there"))
    frame_items = spark.createDataFrame(items, "item_id string, text string")
    for size in (16_000_000, 1_500):
        got = {r.doc_id: list(r._ax_items) for r in decontaminate.find_leaks(frame(spark, docs), frame_items, block_bytes=size).collect()}
        assert got == {d: [] if d % 10 == 9 and d != 9999 else [None] if d == 9999 else [f"set-{d // 10}"] for d, _ in docs}


def test_wand_retrieves_all_above_threshold():
    rng = random.Random(4)
    items = [(i, " ".join(f"t{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.choice([4, 15, 40]))).encode()) for i in range(90)]
    df: dict = {}
    for _, t in items:
        for w in set(t.split()):
            df[w] = df.get(w, 0) + 1
    index = decontaminate.ItemIndex(items, df, len(items), 18.0)
    for _ in range(60):
        terms = rng.sample(range(len(index.terms)), min(len(index.terms), rng.choice([1, 5, 25])))
        for threshold in (0.1, 0.4, 0.8):
            want = {}
            for t in terms:
                for d, x in zip(index.docs[t], index.impacts[t]):
                    want[d] = want.get(d, 0) + x
            assert {d for d, _ in index.retrieve(terms, threshold)} == {d for d, x in want.items() if x >= threshold - 1e-9}


def test_stages_on_awkward_rows(spark, awkward, nothing):
    sf = "/root/testdata/sf0.001"
    for docs in (awkward, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf).cache()
            n = out.count()
            assert n <= docs.count()
            if name == "bpe":
                assert n == docs.count()
            else:
                assert out.columns == docs.columns
                left = {r.doc_id for r in out.select("doc_id").collect()}
                if docs is awkward and name in ("line_dedup", "decontaminate"):
                    assert n == docs.count() and left == {r.doc_id for r in docs.select("doc_id").collect()}
                if docs is awkward and name == "near_dedup":
                    # exact repeats and near copies under one id: one of each group; texts without words all stay
                    assert left >= {1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, None} and n < docs.count()


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf).cache()
        sizes.append(out.count())
        if name != "bpe":
            assert out.columns == docs.columns
        docs = out
    assert sizes == sorted(sizes, reverse=True) and sizes[1] < sizes[0] and sizes[-1] > 0
    assert corpus_pipeline.run(spark, sf).count() == sizes[-1]
