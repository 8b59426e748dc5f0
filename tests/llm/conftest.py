import pytest

EDGES = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "!!! ??? 123"),
    (5, "One short text."),
    (5, "One short text."),
    (None, "a row without an id"),
    (6, "Überraschung: naïve café 日本語 \x00 \U0001f600 ends"),
    (7, "word " * 40_000),
    (8, "x" * 150_000),
    (9, " " * 90_000 + "end"),
]


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, blanks, marks only, repeated rows, a null id, other scripts, very long texts; columns whose names clash."""
    rows = [(i, t, "en" if t else None, "s", 0, 0.5, "x", 1) for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, h int")


@pytest.fixture(scope="session")
def empty(edges):
    return edges.limit(0)


@pytest.fixture(scope="session")
def edge_rows():
    return EDGES
