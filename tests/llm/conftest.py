import pytest

from cohortline.llm.common import ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def shipped(spark):
    ship(spark)
    return spark


@pytest.fixture
def documents(shipped):
    """Documents of (doc_id, text, source), with columns whose names operators use inside."""

    def make(rows):
        full = [(i, t, "en", s, len(t or ""), 7, "x", 1.5) for i, t, s in rows]
        return shipped.createDataFrame(full, SCHEMA + ", id long, key string, target double")

    return make


@pytest.fixture
def odd_rows():
    """Nulls, empty and long texts, repeated rows."""
    return [
        (1, "one two three four", "a"),
        (2, None, "a"),
        (3, "", None),
        (4, "word " * 30_000, "b"),
        (5, "one two three four", "b"),
        (5, "one two three four", "b"),
        (None, "password = hunter2secret one", None),
        (7, " \n\t ", ""),
    ]
