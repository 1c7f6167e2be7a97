import random

import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, term string, component long, copies long, shard_of string"


def prose(seed, n, words=("stone", "river", "winter", "letter", "garden", "silver", "window", "market", "morning", "shadow", "bridge", "candle")):
    r = random.Random(seed)
    return " ".join(r.choice(words) + str(r.randrange(40) or "") for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, equal texts."""
    a, b = prose(1, 60), prose(2, 60)
    long = prose(3, 40_000)
    rows = [
        (1, a, "en", "s0"), (2, a, "en", "s0"), (3, a + " end", "en", "s1"), (4, b, None, "s1"), (4, b, None, "s1"), (5, None, "en", "s0"), (6, "", "en", None), (None, b, "de", "s0"),
        (None, None, None, None), (7, long, "en", "s2"), (8, long + " tail", "en", "s2"), (9, "one", "fr", "s2"), (10, "one", "fr", "s2"), (11, "!!! 123 ???", "es", "s0"), (12, "two words", None, None),
        (13, "日本語 текст 中文 \U0001f600 é́ \x00 end", "en", "s0"), (14, "   \n\t ", "en", "s0"),
    ]
    return [(i, t, la, s, None if t is None else len(t), 5, "t", 1, 99, "x") for i, t, la, s in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (4, 1, 0), (4, 0, 1), (7, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
