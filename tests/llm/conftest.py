import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))


@pytest.fixture()
def odd(spark):
    """Nulls in any column, empty and very long texts, ties and repeated rows, extra columns whose names clash with inner ones."""
    texts = [(1, "One two three four five six seven"), (2, None), (3, ""), (4, "one two three four FIVE six seven"), (5, LONG), (6, LONG + " end"), (7, "short"), (7, "short"), (None, "no id here at all, is there"), (None, None), (8, "  "), (9, "ONE two three four five six seven")]
    rows = [(i, t, None if k % 4 == 0 else "en", None if k % 3 == 0 else f"s{k % 2}", None if t is None else len(t), k, "x", b"y", 2.5, "z") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA + ", id long, key string, digest binary, size double, cls string")


@pytest.fixture()
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
