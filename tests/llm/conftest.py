import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and wordless texts, a long one, repeated rows, columns that clash with any in use."""
    long = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
    base = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, base, "en", "a", 1),
        (1, base, "en", "a", 1),
        (2, base + " tail", "en", None, None),
        (3, None, None, "b", 0),
        (4, "", "en", "b", 0),
        (5, " \t\n ", "en", "c", 4),
        (None, base, "en", "c", 5),
        (None, None, None, None, None),
        (8, long, "de", "c", len(long)),
        (9, "One", "en", "a", 3),
        (10, "naïve ☃ 𝒳 café " * 5, "fr", "a", 9),
    ]
    wide = [(*r, 7, "x", 0.5, b"k", "y", 1) for r in rows]
    df = spark.createDataFrame(wide, f"{COLUMNS}, a int, b string, c double, d binary, e string, f int")
    return df.toDF("doc_id", "text", "lang", "source", "n_chars", "score", "TEXT", "row", "key", "Doc_ID", "component_id")


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"
