import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, hash long, size string, words string"


@pytest.fixture()
def odd(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, and columns whose names operators use."""
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, base, "en", "a"), (1, base, "en", "a"), (2, base, "en", "a"), (3, None, None, None), (4, "", "en", "b"), (None, base + " x", "fr", "b"), (5, "word " * 40_000, "fr", None), (6, "  \n\n ", None, "a"), (7, "123 456 !!", "en", "b"), (8, "élan Ünicode ñandú 文字", "fr", "a")]
    return spark.createDataFrame([(i, t, la, s, None, 0.5, 7, "s", "w") for i, t, la, s in rows], SCHEMA)


@pytest.fixture()
def none(spark):
    return spark.createDataFrame([], SCHEMA)
