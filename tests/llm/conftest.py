import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns with names that the operators use themselves.
CLASHING = {"n_tokens": "1", "kept": "true", "_ax_extra": "'x'", "label": "0", "hash": "'h'", "pos": "1", "n": "2", "score": "0.5", "key": "'k'", "ids": "3", "digest": "'d'"}
CLASHING |= {k: "4" for k in "dropped region node sig shingles own lo hi other keeper p x y n_bytes host path items share kind pid a b u v est unit licenses words w df shard block totals keys n_chunks p_path major last item_id".split()}


def frame(spark, rows):
    full = [(i, t, "en", f"src{(i or 0) % 3}", None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).selectExpr("*", *(f"{v} AS {k}" for k, v in CLASHING.items()))


AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (None, "a text without an id, of a few words"), (None, None), (4, "one"), (5, "word " * 30_000), (6, "x" * 50_000),
    (7, "the same line of more than twenty characters\nsecond line that is also quite long here\n"), (8, "the same line of more than twenty characters\nother"),
    (8, "the same line of more than twenty characters\nother"), (9, "  THE same line of more than twenty characters\t\n"), (9, "another text under the same id"), (10, "\n\n\n"), (11, "Ünïcödé 日本語 \U0001f600 <|endoftext|> '''"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    return frame(spark, AWKWARD).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, []).cache()


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()
