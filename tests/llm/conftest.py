import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, k1 long, size int, row string, score string, copies int"


@pytest.fixture(scope="session")
def text_spark(spark):
    from flowweft.llm.common import prepare

    return prepare(spark)


@pytest.fixture(scope="session")
def make_docs(text_spark):
    """(doc_id, text[, lang[, source]]) with further columns whose names the operators use themselves."""

    def make(rows):
        full = [(*r, *[None] * (4 - len(r)), None if r[1] is None else len(r[1]), 1, 2, "x", "y", 3) for r in rows]
        return text_spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, repeated rows and repeated ids."""
    return [
        (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "a"),
        (2, None, "en", "a"), (3, "", None, None), (4, "   \n\t ", "de", "b"), (None, "no id at all, but some words here", "en", "b"),
        (6, "twice the same row, word for word, in every column", "en", None), (6, "twice the same row, word for word, in every column", "en", None),
        (6, "the id of another row with another text altogether", "fr", "c"), (8, "word " * 60_000, "en", "a"), (9, "x" * 300_000, None, "c"),
        (10, "*** 123 --- 456 !!!", "es", "a"), (11, "naïve café — “quoted”   text with　spaces 中文字  é", "fr", "a"),
        (-5, "negative", "en", ""),
    ]
