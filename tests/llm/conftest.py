import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, id long, size long"


def doc(i, text, lang="en", source="a"):
    return (i, text, lang, source, None if text is None else len(text), 0.5, True, -1, 7)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, columns of clashing names."""
    long = "lorem ipsum dolor sit amet " * 30_000
    rows = [
        doc(1, "One two three four five six seven. It's fine!"), doc(1, "One two three four five six seven. It's fine!"),
        doc(2, None, None, None), doc(3, ""), doc(4, " \t\n\x0b\x0c\r "), doc(5, long, "la", "b"), doc(None, "no id at all here", None, None), doc(6, "日本語 é́ \U0001f600 'll", "ja", ""),
        doc(7, "One two three four five six seven. It's fine!"), doc(8, "x" * 200_000, "en", None), doc(9, "\x00\x1c\x85 ", None, "b"),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
