import random

import pytest

#: Names that operators use inside; none may clash with a column of the input.
CLASH = ("row", "s", "words", "lines", "text_", "fp", "key", "g", "m", "inv", "id", "spans", "rest", "f", "score", "kept", "distance", "c", "slot", "shard", "root", "least", "n", "_n", "a", "b", "u", "v", "lo", "hi", "of")


def prose(rnd: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{rnd.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text, lang, source): nulls anywhere, empty and very long texts, repeats, ties."""
    rnd = random.Random(5)
    long = prose(rnd, 30_000, 4000)
    base = prose(rnd, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base, "en", "s"), (2, base, "en", "s"), (2, base, "en", "s"), (3, " ".join(near), None, "s"), (4, None, "en", None), (5, "", "en", "s"),
        (6, " \n\t ", None, None), (None, base, "en", "s"), (None, None, None, None), (7, long, "de", "t"), (8, "one", "en", "s"), (9, "a b c", "en", "s"),
        (10, "<|endoftext|> don't   STOP\x0bé 日本 \x1c!", "fr", "s"), (11, "same line here\n" * 40, "en", "s"), (12, prose(rnd, 90), "en", "s"),
    ]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *["x"] * len(CLASH)) for r in edge_rows], schema)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


@pytest.fixture(scope="session")
def big_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
