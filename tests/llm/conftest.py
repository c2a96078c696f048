import pytest

ODD = "doc_id long, text string, lang string, source string, n_chars long, removed string, score double, label string, n_words long, __t string, __w int, lang_pred string, places int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and repeated rows, a long text, and further columns whose names clash with the operators' own."""
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "the cat sat on the mat " * 3000, "en", "a"), (3, "the cat sat on the mat " * 3000, "en", "a"), (4, "one two three four five six seven", "en", None), (5, "one two three four five six seven", "de", "b"), (None, "a lonely text without an id", "en", "b"), (6, "12 34 !!", None, "b")]
    return spark.createDataFrame([(i, t, la, s, None if t is None else len(t), "x", 1.0, "y", 7, "t", 8, "l", 9) for i, t, la, s in rows], ODD)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
