import random
import re
import zlib
from collections import Counter

from axleyard.llm import spelling
from axleyard.llm.queries import op13_spelling_variants

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, least_length=7, least=2, ratio=10, every=31):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(LOW)):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    words = sorted(w for w, c in n.items() if len(w) >= least_length and c >= least)
    keys = {}
    for w in words:
        for i in range(len(w)):
            keys.setdefault((i, w[:i], w[i + 1 :]), []).append(w)
    known, about = set(words), {w: set() for w in words}
    for (i, a, b), group in keys.items():
        for w in group:
            about[w].update(x for x in group if x != w)
            if a + b in known:
                about[w].add(a + b), about[a + b].add(w)
    form = {}
    for w in words:
        if about[w]:
            best = min(about[w], key=lambda x: (-n[x], x))
            if n[best] >= ratio * n[w]:
                form[w] = best
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(about[w]), n[form[w]] if w in form else None))
    return out


def got(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def edited(rng, w, letters):
    for _ in range(rng.randrange(3)):
        i = rng.randrange(len(w) + 1)
        w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]])
    return w


def rows_of(rng, letters, least, most, docs=60):
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(least, most))) for _ in range(25)]
    words = [w if rng.random() < 0.7 else edited(rng, w, letters) for w in rng.choices(base, k=4000)]
    words = [w.upper() if rng.random() < 0.1 else w for w in words]
    return [(k, rng.choice([" ", "-", "1", "\n"]).join(words[k::docs])) for k in range(docs)]


def test_brute_force_near_means_one_edit():
    rng = random.Random(1)
    words = {"".join(rng.choice("ab") for _ in range(rng.randrange(3, 6))) for _ in range(40)}
    rows = [(1, " ".join(words)), (2, " ".join(words))]
    table = {r[0]: r[4] for r in brute(rows, 3, 1, 10, 10**9)}
    assert table == {w: sum(near(w, x) for x in words) for w in words}


def test_equals_brute_force(spark):
    rng = random.Random(2)
    for letters, least, most, options in (("abcé", 6, 12, {}), ("ab", 3, 9, {"least_length": 3, "ratio": 2}), ("abc", 5, 30, {"longest": 9, "ratio": 3, "every": 5}), ("ab", 7, 14, {"task_rows": 50, "least": 1, "longest": 12, "every": 3})):
        rows = [*rows_of(rng, letters, least, most), (None, "abcabcabc abcabcabc"), (None, None), (3, ""), (7, "×÷×÷×÷× ×÷×÷×÷× ÀÀÀÀÀÀÀÀ")]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert got(spelling.variants(docs, **options)) == brute(rows, **{k: v for k, v in options.items() if k not in ("longest", "task_rows")})


def test_forms_are_followed_to_the_last(spark):
    chain = ["aaaaaaaa", "aaaaaaab", "aaaaaabb", "aaaaabbb", "aaaabbbb"]
    rows = [(k, " ".join([w] * 2 * 3**i)) for i, w in enumerate(chain) for k in [i]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.word: r.root for r in spelling.variants(docs, ratio=3, every=10**9).collect()}
    assert set(out.values()) == {chain[-1]} and len(out) == 5


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op13_spelling_variants(spark, sf)) == brute(rows)


def test_awkward_long_and_empty(spark, awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    assert got(spelling.variants(awkward)) == brute(rows)
    assert got(spelling.variants(nothing)) == []
    rows = [(1, "x" * 20_000), (2, "x" * 20_000), (3, "x" * 20_001), (4, "x" * 20_001), (5, "x" * 9_000 + "y" + "x" * 11_000), (6, "x" * 9_000 + "y" + "x" * 11_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [(len(r[0]), r[4]) for r in got(spelling.variants(docs, every=10**9))] == [(20_000, 2), (20_001, 2), (20_001, 2)]
