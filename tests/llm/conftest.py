import pytest

#: Columns of documents, and others whose names the operators use inside.
DDL = "doc_id long, text string, lang string, source string, n_chars long, key string, n long, bits string, bucket int, label string, block long"


def with_more(rows):
    """(doc_id, text, lang, source) with the other columns."""
    return [(d, t, lang, source, None if t is None else len(t), "k", 1, None, 3, "x", 9) for d, t, lang, source in rows]


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: spark.createDataFrame(with_more(rows), DDL)


LONG = "".join(f"word{k % 977} " + ("\n" if k % 40 == 39 else "") for k in range(30_000))

#: Nulls in each column, empty and blank texts, repeated rows and ids, a very long text.
ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, "a"), (4, "One two three four five six seven.", "en", None), (None, "One two three four five six seven.", "en", "a"),
    (5, "same row", "fr", "b"), (5, "same row", "fr", "b"), (6, "other text of that id", "fr", "b"), (6, "and another text", "fr", "b"), (7, LONG, "de", "a"),
    (8, "éè 中文 \U0001f600 é İ ΣΣ \x1c\x85\xa0z", "es", "a"),
]


@pytest.fixture(scope="session")
def odd(make):
    return make(ODD)
