import pytest


@pytest.fixture
def docs(spark):
    """documents with nulls everywhere, empty and long texts, repeats, and extra columns whose names clash."""
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta eta", "en", "a"),
        (2, "Alpha beta gamma delta epsilon zeta eta", "en", "b"),
        (2, "Alpha beta gamma delta epsilon zeta eta", "en", "b"),
        (3, None, None, None),
        (4, "", "en", "a"),
        (5, " \t\n", None, "c"),
        (None, "no id here", "en", None),
        (6, "xyz " * 30_000, "en", "c"),
        (7, "z" * 50_000, None, "a"),
        (8, "Ünïcode ﬁ İ <|endoftext|> 日本 😀", "de", "a"),
    ]
    return spark.createDataFrame([(*r, 9, "x") for r in rows], "doc_id long, text string, lang string, source string, size int, shard string")


@pytest.fixture
def no_docs(docs):
    return docs.where("false")
