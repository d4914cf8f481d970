import random
import re
from collections import Counter, defaultdict

import duckdb
import xxhash
from pyspark.sql import functions as F

from axleyard.llm import collocations
from axleyard.llm.collocations import in_order
from axleyard.llm.common import Scratch
from axleyard.llm.queries import op11_collocations

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, least=100, longest=5, share=100, top=2000):
    """rows: (text, lang)."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if a >= least and len(p) > 1}
        inside = Counter()
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        rank = []
        for p, a in cand.items():
            if p in inside and 100 * inside[p] >= share * a:
                continue
            score, _, l, r = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rank.append((-score, -a, " ".join(p).encode(), l, r))
        for k, (s, a, p, l, r) in enumerate(sorted(rank)[:top], 1):
            out.append((lang, k, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def phrases(rng, n):
    words = [*(f"w{i}" for i in range(12)), "Été", "x\x01", "x", "\x1cy", "ÀB", "#"]
    fixed = ["new york city hall park", "Of the", "in spite of", "a a a a a a"]
    for _ in range(n):
        yield "".join((rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words)) + rng.choice([" ", " ", "  ", "\t", " ", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randrange(30)))


def test_equals_brute_force_and_any_ranges(spark):
    rng = random.Random(7)
    rows = [(t, rng.choice(["en", "en", "en", "de", None, "und"])) for t in phrases(rng, 400)] + [(None, "en"), ("", None), ("word", "zz")]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    want = brute(rows, 5)
    assert len(want) > 100
    assert got(collocations.collocations(docs, 5)) == want
    # a range for every few entries: beginnings are carried, ties at the cut, colliding bits
    assert got(collocations.collocations(docs, 5, range_rows=7, bits=8, top=40, salts=3)) == brute(rows, 5, top=40)
    assert got(collocations.collocations(docs, 5, share=60, longest=4, range_rows=50)) == brute(rows, 5, 4, 60)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang").collect()]
    want = brute(rows)
    assert want and got(op11_collocations(spark, sf)) == want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(con.sql(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({collocations.SQL})").fetchall()) == want


def test_awkward_and_empty_tables(spark, awkward, nothing):
    rows = [tuple(r) for r in awkward.select("text", "lang").collect()]
    assert got(collocations.collocations(awkward, 2)) == brute(rows, 2)
    assert got(collocations.collocations(nothing)) == []


def test_long_texts_are_cut_between_pieces_only(spark):
    text = "alpha beta gamma, " * 150_000
    out = got(collocations.collocations(spark.createDataFrame([(text, "en")], "text string, lang string")))
    assert out == [("en", 1, "alpha beta gamma", 150_000, 150_000, 150_000, 450_000, 3000)]


def test_hashes_agree_with_spark(spark):
    words = ["a", "Été", "x" * 50, "日本語"]
    there = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()]
    assert [x % 2**64 for x in there] == [xxhash.xxh64_intdigest(w, 42) for w in words]


def test_scores_are_exact(spark):
    a, n, l, r = 123_456_789_012, 9_999_999_999_999_999, 123_456_789_013, 223_456_789_011
    x = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long")
    assert x.select(collocations._score(*(F.col(c) for c in "anlr"))).first()[0] == 1000 * a * n // (l * r)


def test_ranges_send_their_beginnings_and_not_the_stream(spark):
    """However small its files are, the stream of counts is not sent whole through the driver."""
    keep = Scratch(spark)
    rows = [("x", [f"w{i % 50}", f"w{i % 7}"][: 1 + i % 2], i) for i in range(700)]
    one, two = (keep.written(spark.createDataFrame(part, "lang string, words array<string>, f long")) for part in (rows[:350], rows[350:]))
    text = in_order(one.unionByName(two), keep, 50)._jdf.queryExecution().executedPlan().toString()
    before, sent = text.split("BroadcastExchange")
    assert "Generate explode" in sent.split("Scan")[0] and "Union" in before and "Generate explode" not in before
    keep.clear()
