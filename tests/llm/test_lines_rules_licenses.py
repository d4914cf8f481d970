import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

from axleyard.llm import licenses, line_dedup, quality_rules

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def brute_lines(rows):
    key = lambda l: re.sub(r"[A-Z]+", lambda m: m[0].lower(), l.strip(" \t\n\r\x0b\x0c"))
    holders = defaultdict(set)
    for i, t in rows:
        if i is not None:
            for l in (t or "").split("\n"):
                if len(key(l)) >= 20:
                    holders[key(l)].add(i)
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [l for l in ls if i is None or len(holders[key(l)]) < 3 or i == max(holders[key(l)])] if i is not None else ls
        out.append((i or -1, len(ls), len(ls) - len(kept), sha("\n".join(kept))))
    return sorted(out)


def test_line_dedup(awkward, nothing, sample):
    for docs in (awkward, sample):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        assert sorted((r[0] or -1, *r[1:]) for r in line_dedup.line_digests(docs).collect()) == brute_lines(rows)
    assert line_dedup.line_digests(nothing).count() == 0
    assert {"label", "hash", "pos"} <= set(line_dedup.dedup_lines(awkward).columns)


def brute_rules(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    wins = list(zip(words, words[1:], words[2:]))
    c = Counter(wins)
    hit = {j for i, w in enumerate(wins) if c[w] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), failed


def test_quality_rules(awkward, nothing, sample):
    for docs in (awkward, sample):
        want = sorted((r.doc_id or -1, *brute_rules(r.text)) for r in docs.collect())
        got = quality_rules.rules_result(docs).collect()
        assert sorted((r.doc_id or -1, *r[1:7]) for r in got) == want
        assert not any(r.kept and r.base_failed for r in got)
    assert quality_rules.rules_result(nothing).count() == 0


def test_ratios_and_verdicts(sample):
    import math

    import zstandard

    bands, packed = quality_rules.WHOLE_BANDS, lambda d: len(d) / len(zstandard.compress(d, 3)) if d else 1.0

    def low(size):
        k = max(i for i, b in enumerate(bands) if b[0] <= size)
        if k == 0 or k + 1 == len(bands):
            return bands[k][1]
        (a, x, _), (b, y, _) = bands[k : k + 2]
        return x + (y - x) * (math.log(size) - math.log(a)) / (math.log(b) - math.log(a))

    got = {r.doc_id: r for r in quality_rules.rules_result(sample).collect()}
    rejected = 0
    for r in sample.collect():
        data = (r.text or "").encode()
        starts = [a for a in range(0, len(data), 4096) if a == 0 or len(data) - a >= 512]
        pieces = [data[a:b] for a, b in zip(starts, [*starts[1:], len(data)])] if data else []
        ratios = [packed(p) for p in pieces]
        high = next(b[2] for b in reversed(bands) if b[0] <= len(data))
        outside = sum(not low(len(p)) <= x <= 8.0 for p, x in zip(pieces, ratios))
        good = low(len(data)) <= packed(data) <= high and outside <= 0.2 * len(pieces)
        g = got[r.doc_id]
        assert g.kept == (good and not g.base_failed)
        assert abs(g.zstd_ratio - packed(data)) < 1e-5 and abs(g.chunk_ratio_min - min(ratios, default=packed(data))) < 1e-5 and abs(g.chunk_ratio_max - max(ratios, default=packed(data))) < 1e-5
        rejected += not good
    assert rejected


def test_bands():
    noise = b"".join(hashlib.sha256(bytes([i, j])).digest() for i in range(30) for j in range(30))
    m = quality_rules.measured(b" ".join(noise[i : i + 7].hex().encode() for i in range(0, 6000, 7)))
    assert m["zstd_ratio"] < 2
    assert not quality_rules.in_bands(noise, quality_rules.ratio(noise), [quality_rules.ratio(noise[:4096])])
    assert not quality_rules.in_bands(b"ab " * 9000, quality_rules.ratio(b"ab " * 9000), [])


def test_noise_is_not_kept():
    rng = random.Random(1)
    noise = {
        "base64": lambda: base64.b64encode(rng.randbytes(6)), "letters and digits": lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=7)).encode(),
        "letters": lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))).encode(), "hex": lambda: rng.randbytes(4).hex().encode(),
    }
    for name, word in noise.items():
        for size in (1024, 3072, 16_000, 20_000, 140_000):
            m = quality_rules.measured(b" ".join(word() for _ in range(size))[:size])
            # hex of 1 KB compresses like prose of that length
            assert not m["base_failed"] and (m["kept"] == (name == "hex" and size == 1024)), (name, size)


def test_chunks_cover_the_text(sample):
    prose = next(r.text.encode() for r in sample.collect() if r.text and len(r.text) > 9000 and quality_rules.measured(r.text.encode())["kept"])[:6000]
    noise = base64.b64encode(random.Random(2).randbytes(1500))
    assert quality_rules.measured(prose)["kept"] and not quality_rules.measured(prose + b" " + noise)["kept"]
    for size in (0, 1, 511, 4096, 4600, 4608, 20_000):
        ends = quality_rules.chunk_ends(size)
        assert b"".join(bytes(b - a) for a, b in ends) == bytes(size) and all(b - a >= min(512, size) for a, b in ends)


def test_licenses(spark, awkward, nothing):
    mit = licenses._MIT
    docs = spark.createDataFrame([
        (1, "Copyright (c) 2020 Somebody\n\n" + mit), (2, mit.upper().replace(",", " ,")), (3, "prose\nReleased under the MIT licence!\nprose"), (4, "Released under the MIT License if you like it"),
        (5, "Some notes.\n\n" + licenses._ISC + "\n\nMore."), (6, None), (7, "Licensed under the Apache License, version 2.0\nLicensed under CC BY-NC 4.0."),
    ], "doc_id long, text string")
    got = {r.doc_id: (r.licenses, r.whole_text) for r in licenses.license_result(docs).collect()}
    assert got == {1: ("MIT", True), 2: ("MIT", True), 3: ("MIT", False), 4: ("", False), 5: ("ISC", False), 6: ("", False), 7: ("Apache-2.0,CC-BY-NC-4.0", False)}
    assert licenses.license_result(awkward).count() == awkward.count()
    assert licenses.license_result(nothing).count() == 0


def test_licenses_among_other_text(spark):
    names = {}
    for k, (name, body) in enumerate(licenses.KNOWN):
        if "\n\n" in body:
            names[k] = (name, f"Some notes about this file.\n\n{body.strip()}\n\nMore of them.")
    assert {"MIT", "ISC", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "Unlicense"} == {n for n, _ in names.values()}
    spaced = "\n\n".join([licenses._BSD_START, *(f"{k}. {c}" for k, c in enumerate(licenses._BSD_CLAUSES, 1)), licenses._BSD_END])
    docs = spark.createDataFrame([(k, t) for k, (_, t) in names.items()] + [(1000, "Notes\n\n" + spaced), (1001, "Notes\n\nSPDX-License-Identifier: AGPL-3.0-only")], "doc_id long, text string")
    got = {r.doc_id: (r.licenses, r.whole_text) for r in licenses.license_result(docs).collect()}
    # the first line of BSD terms names the family alone
    assert got == {k: (("BSD," if n.startswith("BSD") else "") + n, False) for k, (n, _) in names.items()} | {1000: ("BSD,BSD-3-Clause", False), 1001: ("AGPL-3.0", False)}


def test_license_sql_on_whole_families(spark):
    import duckdb
    import pandas as pd

    texts = [b for _, b in licenses.KNOWN] + [f"Notes\n\n{b}\n\nMore" for _, b in licenses.KNOWN]
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    want = sorted(duckdb.sql(licenses.sql()).fetchall())
    assert len(documents) == len(want)
    assert sorted(map(tuple, licenses.license_result(spark.createDataFrame(documents)).collect())) == want
