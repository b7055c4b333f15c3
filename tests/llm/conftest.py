import pytest

HARD = [
    (1, "Aa bb  cc\tdd. mail a.b@c.org now", "x"),
    (2, "aa BB cc dd. mail a.b@c.org now", "y"),
    (3, None, "x"),
    (4, "", None),
    (5, " \n\t ", "x"),
    (6, "word " * 9000 + "end", "x"),
    (7, "word " * 9000 + "end", "x"),
    (7, "word " * 9000 + "end", "x"),
    (None, "lonely text without an id here", "z"),
]


@pytest.fixture
def hard(spark):
    """Nulls, empty and long texts, repeats, a missing id, and columns with clashing names."""
    rows = [(*r, 5, True) for r in HARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int, kept boolean")


@pytest.fixture
def empty(hard):
    return hard.where("false")
