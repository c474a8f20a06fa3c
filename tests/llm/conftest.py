import pytest

LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, equal rows, extra columns with clashing names."""
    rows = [
        (1, "", "en", "a"), (2, None, None, None), (None, f"no id {PASSAGE} end", "en", "a"), (4, LONG, "de", None),
        (5, "one two three", "en", "b"), (5, "one two three", "en", "b"), (6, f"start {PASSAGE} tail one", "en", "b"),
        (7, f"other {PASSAGE} tail two", None, "b"), (8, "a a a a " * 30, "en", "c"), (9, " \t\n ", "fr", ""),
        (10, "Ünïcode   text line 日本 " * 20, "ja", "日"), (11, LONG, "de", "a"), (None, None, None, None),
    ]
    rows = [(*r, len(r[1] or ""), i, "x", 0) for i, r in enumerate(rows)]
    return spark.createDataFrame(
        rows,
        "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, kept string, fp int",
    )


@pytest.fixture(scope="session")
def sf_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
