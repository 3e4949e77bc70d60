import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, size string, row int"
BASE = "The quick brown fox jumps over the lazy dog and runs far away from the old red barn by the river "


def rows():
    """Nulls in every column, empty, blank and very long texts, copies, near copies, repeated rows, a hot source, clashing names."""
    long_text = " ".join(f"word{i % 977} of line {i}" for i in range(6000))
    out = [
        (1, BASE * 4, "en", "a", 1, "x", "y", 7), (2, BASE * 4, "en", "a", 1, None, None, None), (3, BASE * 4 + "indeed", "en", "b", 1, "x", "y", 7),
        (4, "", "en", "a", 0, "x", "y", 7), (5, None, "en", "a", None, "x", "y", 7), (6, " \t\n ", None, None, 3, "x", "y", 7),
        (7, long_text, "en", "a", 1, "x", "y", 7), (8, "Der schnelle Fuchs springt über den Hund. " * 9, "de", None, 1, "x", "y", 7),
        (8, "Der schnelle Fuchs springt über den Hund. " * 9, "de", None, 1, "x", "y", 7), (None, BASE * 4, None, "c", 1, "x", "y", 7),
        (None, "only here " * 3, None, "c", 1, "x", "y", 7), (9, "12345 %% ##", None, "a", 1, "x", "y", 7), (10, "x" * 40_000, None, "b", 1, "x", "y", 7),
        (11, "THE BIG\nTHE BIG\nfox\n\n", "en", "z", 1, "x", "y", 7),
    ]
    return out + [(100 + i, f"{BASE} number {i} is here, {i * i} times", "en", "a", 1, "x", "y", 7) for i in range(20)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
