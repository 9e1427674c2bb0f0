"""Small documents with the cases that every operator must stand: nulls, empty and long texts, repeats, other columns."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, node long, key string"


@pytest.fixture(scope="session")
def frame(spark):
    """A function from (doc_id, text) pairs to a documents frame with extra columns of clashing names."""

    def make(rows, lang="en", source="a"):
        return spark.createDataFrame([(i, t, lang, source, len(t or ""), "x", 1, "k") for i, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd(frame):
    """Null id, null text, empty text, white space, a repeated row, a long text."""
    long = " ".join(f"word{k % 977}" for k in range(60_000))
    return frame([(1, "hello there world"), (2, None), (3, ""), (4, " \n\t "), (5, "hello there world"), (5, "hello there world"), (None, "no id here"), (6, long)])


@pytest.fixture(scope="session")
def empty(frame, odd):
    return odd.limit(0)
