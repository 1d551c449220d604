import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents of (doc_id, text[, lang, source]) tuples, in several partitions."""

    def make(rows, partitions=3):
        full = [(r[0], r[1], *(r[2:] if len(r) > 2 else ("en", "s")), None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def odd(spark):
    """``docs`` with more columns, named like those that the operators use inside."""

    def make(docs):
        names = ("h", "k", "fp", "other", "size", "key", "score", "predicted", "features", "prediction", "probability", "row", "chunk",
                 "words", "votes", "n_words", "target", "whole", "copies", "id", "label", "part", "payload")
        from pyspark.sql import functions as F

        return docs.withColumns({n: F.lit("x") for n in names})

    return make


ODD_ROWS = [
    (1, None, None, None), (2, "", "en", "s"), (3, " \n\t ", "en", "s"), (4, "one", "en", None), (4, "one", "en", None),
    (None, "a null id has a text too", "fr", "s"), (5, "Été    ça\n\nva 123's  <|endoftext|> 語語 \U0001f600", "fr", "t"),
    (6, "long " * 3000, "en", "t"), (7, "long " * 3000 + "end", "en", "t"), (8, "one", "en", "s"),
]


@pytest.fixture(scope="session")
def odd_rows():
    return ODD_ROWS
