import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and
    columns whose names an operator might use."""
    words = " ".join(f"w{i % 997}x{i * 7919 % 10007}" for i in range(30_000))
    rows = [(1, "Alpha beta gamma delta epsilon zeta.", "en", "a", 36, "x"),
            (1, "Alpha beta gamma delta epsilon zeta.", "en", "a", 36, "x"),
            (2, None, "en", "a", None, None), (3, "", None, None, 0, "y"), (None, "null id here", "en", "a", 12, "z"),
            (None, None, None, None, None, None), (4, "123 456 !!!", "en", "b", 11, "x"), (5, words, "en", "b", len(words), ""),
            (6, "  two  blanks \n\tand others ", "de", "b", 10, "x"), (7, "ok", "de", "\U0001F600", 2, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n string") \
        .selectExpr("*", "1 as size", "2 as bucket", "'q' as key", "0 as length", "0 as root")
