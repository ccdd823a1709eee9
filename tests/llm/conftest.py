import pytest


@pytest.fixture(scope="session")
def rows_of(spark):
    """rows_of(texts): a table of documents with odd extra columns."""

    def make(texts, **columns):
        data = [(i, t, None if i % 4 == 3 else f"s{i % 3}", "en", i) for i, t in enumerate(texts)]
        return spark.createDataFrame(data, "doc_id long, text string, source string, lang string, n_chars long").repartition(3).sortWithinPartitions("doc_id")

    return make


#: Nulls, blanks, one word, many lines, long, letters beyond the first plane, copies.
ODD = [None, "", "   \n\t ", "word", "A b. C d! " * 5, "é ß 漢字 😀 ﬁ", "x" * 70_000, "same text of some words here " * 3, "same text of some words here " * 3, "<|endoftext|> and <|startoftext|>!", "don't we're  I'd\r\n\x1c\x85 end", "1234567890 " * 3000]


@pytest.fixture(scope="session")
def odd():
    return list(ODD)
